"""File sources and sinks: JSON arrays, JSON lines, CSV, XML, HTML pages,
versioned generations, and snapshots with checksums."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of files that hold one JSON array each; a file that is no JSON fails
    the query, elements that are no objects are left out."""
    names = spark.createDataFrame([], schema).columns
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.where(F.coalesce(*[F.col(f"`{n}`").isNotNull().cast("int") for n in names]) >= 0).dropna("all")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """JSON lines with a unique key: blank lines are skipped; a malformed line or a
    repeated key fails the query and names the value."""
    text = spark.read.text(path).where(F.trim("value") != "")
    parsed = text.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    bad = F.col("r").isNull() | F.col(f"r.{key}").isNull()
    checked = parsed.select(F.when(bad, F.raise_error(F.concat(F.lit("malformed line: "), "value")).cast(schema)).otherwise(F.col("r")).alias("r")).select("r.*")
    twice = checked.groupBy(key).agg(F.count("*").alias("__n"))
    told = twice.withColumn(key, F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.col(key).cast("string"))).cast(schema[key].dataType)).otherwise(F.col(key)))
    return checked.join(told.select(key), key)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def read_xml_sections(spark: SparkSession, path: str) -> DataFrame:
    """(title, paragraphs) of files with one XML section a line; entities other
    than the built-in ones are not resolved, a malformed line has nulls."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    x = lines.select(F.from_xml("value", "title string, p array<string>", {"rowTag": "sec"}).alias("x"))
    return x.select(F.col("x.title").alias("title"), F.col("x.p").alias("paragraphs"))


class _Articles(HTMLParser):
    """Collects the title, links and paragraphs of every ``article`` element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done: list[dict] = []
        self.now: dict | None = None
        self.into: str | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.now = {"title": "", "links": [], "paragraphs": []}
        elif self.now is not None:
            if tag in ("h1", "h2", "h3"):
                self.into = "title"
            elif tag == "p":
                self.now["paragraphs"].append("")
                self.into = "p"
            elif tag == "a" and dict(attrs).get("href"):
                self.now["links"].append(dict(attrs)["href"])

    def handle_endtag(self, tag):
        if tag == "article" and self.now is not None:
            self.done.append(self.now)
            self.now = self.into = None
        elif tag in ("h1", "h2", "h3", "p"):
            self.into = None

    def handle_data(self, data):
        if self.now is not None and self.into == "title":
            self.now["title"] += data
        elif self.now is not None and self.into == "p":
            self.now["paragraphs"][-1] += data


PAGE_ROWS = "page string, nth int, title string, links array<string>, authors string, year int"


def parse_pages(pages: DataFrame, page: str, body: str) -> DataFrame:
    """Publications on archive pages: one row an article, first of equal titles or
    of any equal link on the page; the author line is the first paragraph, the
    year the first 19xx or 20xx of the others.  Rows are parsed on their own."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for p, b in zip(part[page], part[body]):
                parser = _Articles()
                parser.feed(b or "")
                titles, urls, n = set(), set(), 0
                for a in parser.done:
                    title = " ".join(a["title"].split())
                    key = re.sub(r"[^a-z0-9]+", " ", title.lower()).strip()
                    if not key or key in titles or urls.intersection(a["links"]):
                        continue
                    titles.add(key)
                    urls.update(a["links"])
                    n += 1
                    text = [" ".join(x.split()) for x in a["paragraphs"]]
                    years = [m for x in text[1:] for m in re.findall(r"\b(?:19|20)\d{2}\b", x)]
                    rows.append((p, n, title, a["links"], text[0] if text else None, int(years[0]) if years else None))
            yield pd.DataFrame(rows, columns=["page", "nth", "title", "links", "authors", "year"]).astype({"year": "Int32"})

    return pages.select(page, body).mapInPandas(run, PAGE_ROWS)


def link_kind(text, href):
    """``pdf`` for links named download or ending in .pdf, ``source`` for links to
    other hosts, else ``other``."""
    path = F.lower(F.coalesce(F.regexp_extract(href, r"^[^?#]*", 0), F.lit("")))
    return F.when(F.contains(F.lower(text), F.lit("download")) | path.endswith(".pdf"), "pdf").when(path.rlike("^https?://"), "source").otherwise("other")


def escape(text: str) -> str:
    return html.escape(text, quote=True)


def write_generation(df: DataFrame, root: str, name: str) -> str:
    """Write an immutable generation and move the pointer to it.

    The generation's folder is named by a fingerprint of its rows, which is part
    of the pointer; readers check it.  A generation that exists is not written
    again."""
    print_ = fingerprint(df)
    path = f"{root}/{name}/{print_}"
    df.write.mode("ignore").parquet(path)
    spark = df.sparkSession
    spark.createDataFrame([(name, print_, path)], "name string, fingerprint string, path string").coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}-current")
    return path


def read_generation(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The current generation; fails if its rows do not match the pointer."""
    at = spark.read.parquet(f"{root}/{name}-current").first()
    df = spark.read.parquet(at["path"])
    if fingerprint(df) != at["fingerprint"]:
        raise ValueError(f"generation {at['path']} does not match its pointer")
    return df


def fingerprint(df: DataFrame) -> str:
    """Order-free: count and two sums of row hashes, as hex."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    h = lambda at: F.conv(F.substring(F.sha2(row, 256), at, 12), 16, 10).cast("decimal(38,0)")
    n, a, b = df.agg(F.count("*"), F.coalesce(F.sum(h(1)), F.lit(0)), F.coalesce(F.sum(h(13)), F.lit(0))).first()
    return f"{n:x}-{int(a) % (1 << 64):x}-{int(b) % (1 << 64):x}"


def export_snapshot(tables: dict[str, DataFrame], root: str) -> DataFrame:
    """Write every table as JSON lines; returns (name, rows, fingerprint)."""
    rows, spark = [], None
    for name, df in tables.items():
        spark = df.sparkSession
        df.write.mode("overwrite").json(f"{root}/{name}")
        rows.append((name, df.count(), fingerprint(df)))
    return spark.createDataFrame(rows, "name string, rows long, fingerprint string")


def import_snapshot(spark: SparkSession, root: str, schemas: dict[str, T.StructType], manifest: DataFrame) -> dict[str, DataFrame]:
    """Read the tables back; fails where a count or fingerprint differs."""
    want = {r["name"]: (r["rows"], r["fingerprint"]) for r in manifest.collect()}
    out = {}
    for name, schema in schemas.items():
        df = spark.read.schema(schema).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").json(f"{root}/{name}")
        if (df.count(), fingerprint(df)) != want[name]:
            raise ValueError(f"table {name} does not match the manifest")
        out[name] = df
    return out


def evolve(df: DataFrame, schema: T.StructType, defaults: dict[str, object]) -> DataFrame:
    """Add the columns of ``schema`` that ``df`` lacks, with their defaults."""
    missing = {f.name: F.lit(defaults.get(f.name)).cast(f.dataType) for f in schema.fields if f.name not in df.columns}
    return df.withColumns(missing).select(*[f.name for f in schema.fields])
