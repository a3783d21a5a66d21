"""A persisted inverted index: written once, searched by many batches of queries.

An index is a folder with three tables: ``postings`` (term, key, tf, size) and
``terms`` (term, df, cf), both partitioned by a hash of the term so that a batch
reads the parts of its terms only, and ``totals`` of one row.  The file
``COMPLETE`` is made last; a folder without it is built again.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import relational as R
from lectern.operators import search as S
from lectern.session import shared_folder

PARTS = 32


@dataclass(frozen=True)
class Index:
    key: str
    postings: DataFrame
    terms: DataFrame
    totals: DataFrame


def _part(term: str) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def version(docs: DataFrame) -> str:
    """What the files behind ``docs`` are: their names, sizes and times, hashed."""
    seen = []
    for name in sorted(docs.inputFiles()):
        path, files = _files(docs.sparkSession, name)
        status = files.getFileStatus(path)
        seen.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()[:24]


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> None:
    """Write the index of ``docs``; rows of a null key take no part."""
    spark = docs.sparkSession
    rows = docs.where(F.col(key).isNotNull())
    # rebalanced by size: a part with a term that most texts have becomes several files
    postings = S.postings(rows, key, text).withColumn("part", _part("term")).hint("rebalance", "part")
    postings.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/postings")
    kind = docs.schema[key].dataType.simpleString()
    kept = _table(spark, folder, "postings", key, kind)
    terms = kept.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).withColumn("part", _part("term"))
    terms.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/terms")
    terms = _table(spark, folder, "terms", key, kind)
    number = rows.agg(F.count("*").alias("docs"))
    sizes = terms.agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("tokens"))
    number.crossJoin(sizes).select("docs", F.try_divide("tokens", "docs").alias("mean")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/totals")
    path, files = _files(spark, f"{folder}/COMPLETE")
    files.create(path).close()


def _table(spark: SparkSession, folder: str, name: str, key: str, kind: str) -> DataFrame:
    forms = {"postings": f"term string, `{key}` {kind}, size int, tf long, part int", "terms": "term string, df long, cf long, part int", "totals": "docs long, mean double"}
    return spark.read.schema(forms[name]).parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, key: str = "doc_id", kind: str = "bigint") -> Index:
    """The index in ``folder``, whose ``key`` is of the type ``kind``."""
    path, files = _files(spark, f"{folder}/COMPLETE")
    if not files.exists(path):
        raise ValueError(f"no complete index in {folder}")
    return Index(key, *(_table(spark, folder, name, key, kind) for name in ("postings", "terms", "totals")))


def of(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None) -> Index:
    """The index of ``docs``, a table of files: the one in the shared folder if the
    files are those it was made of, else a new one beside it."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/index-{key}-{text}-{version(docs)}"
    path, files = _files(spark, f"{folder}/COMPLETE")
    if not files.exists(path):
        write(docs, folder, key, text)
    return load(spark, folder, key, docs.schema[key].dataType.simpleString())


def bm25(index: Index, queries: DataFrame, k: int | None, among: DataFrame | None = None, small: int = 10_000, **weights: float) -> DataFrame:
    """(query_id, key, score, rank) as :func:`lectern.operators.search.bm25`, from
    the index.  ``among`` (key) restricts what may be found before ranks are
    given; a term's rarity is still that in all texts.  The terms of at most
    ``small`` are broadcast, larger batches are joined by a shuffle."""
    terms = S.query_terms(queries).withColumn("part", _part("term"))
    of = F.broadcast if terms.limit(small + 1).count() <= small else lambda df: df
    wanted = of(terms.select("part", "term").distinct())
    tf = index.postings.join(wanted, ["part", "term"])
    if among is not None:
        tf = tf.join(among.select(index.key).distinct(), index.key, "left_semi")
    df = index.terms.join(wanted, ["part", "term"]).select("term", "df")
    scored = S.weigh(tf.join(of(df), "term"), index.totals, of(terms.drop("part")), index.key, **weights)
    return scored if k is None else R.top_k(scored, ["query_id"], [F.desc("score"), F.col(index.key)], k)
