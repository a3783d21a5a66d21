"""Streams and file round trips over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.plans.catalog import PAPERS, papers
from lectern.session import new_path, table
from lectern.sources import files as S
from lectern.streaming import events as E


def _utc(df, column="start"):
    return df.withColumn(column, F.col(column).cast("timestamp_ntz"))


def stream_tumbling(spark, d):
    return _utc(E.run_to_table(E.tumbling(E.event_stream(spark, d), "1 hour"), "tumbling"))


def stream_sliding(spark, d):
    return _utc(E.run_to_table(E.sliding(E.event_stream(spark, d), "12 hours", "6 hours"), "sliding"))


def stream_sessions(spark, d):
    return _utc(E.run_to_table(E.sessions(E.event_stream(spark, d), "4 hours"), "sessions"))


def stream_distinct(spark, d):
    return E.run_to_table(E.distinct(E.event_stream(spark, d), ["event_id"]), "distinct", "append").select("event_id", "event_type")


def stream_limiter(spark, d):
    return E.run_to_table(E.limiter(E.event_stream(spark, d), 2, 6 * 3600), "limiter", "append")


def json_lines(spark, d):
    path = new_path(spark, "lines")
    p = papers(spark, d).select("paper_id", "title", "pub_year", "topics")
    p.write.json(path)
    return S.read_json_lines(spark, path, p.schema, "paper_id").select("paper_id", "title", "pub_year", F.size("topics").alias("topics"))


def csv_table(spark, d):
    path = new_path(spark, "csv")
    S.write_csv(papers(spark, d), path, ["paper_id", "title", "venue", "pub_year"])
    return S.read_csv(spark, path, "paper_id string, title string, venue string, pub_year int")


def html_pages(spark, d):
    """Archive pages made of the papers of each year, parsed again."""
    p = papers(spark, d).where("pub_year is not null and size(authors) > 0")
    article = F.concat(F.lit("<article><h2>"), "title", F.lit("</h2><p>"), F.array_join("authors", ", "), F.lit("</p><p>"), F.coalesce("venue", F.lit("none")), F.lit("</p><p>Published "), F.col("pub_year").cast("string"), F.lit('</p><a href="https://papers.example/'), "paper_id", F.lit('">Download</a></article>'))
    pages = p.groupBy(F.concat_ws("-", F.col("pub_year").cast("string"), F.pmod(F.xxhash64("paper_id"), F.lit(16)).cast("string")).alias("page")).agg(F.concat_ws("\n", F.array_sort(F.collect_list(article))).alias("body"))
    return S.parse_pages(pages, "page", "body").select("title", F.get("links", F.lit(0)).alias("link"), "year")


def xml_sections(spark, d):
    path = new_path(spark, "xml")
    docs = table(spark, d, "documents").where("section is not null").select(F.concat(F.lit("<sec><title>"), "section", F.lit("</title><p>"), F.col("doc_id").cast("string"), F.lit("</p></sec>")).alias("value"))
    docs.write.text(path)
    return S.read_xml_sections(spark, path).select("title", F.get("paragraphs", F.lit(0)).cast("long").alias("doc_id"))


def generations(spark, d):
    """The catalogue written as a generation, found by its pointer, read again."""
    root = new_path(spark, "generations")
    S.write_generation(papers(spark, d).select("paper_id", "title").where("title is not null"), root, "papers")
    S.write_generation(papers(spark, d).select("paper_id", "title", "pub_year"), root, "papers")
    return S.read_generation(spark, root, "papers")


def snapshot(spark, d):
    root = new_path(spark, "snapshot")
    tables = {"papers": papers(spark, d).select("paper_id", "title", "pub_year", "topics"), "customer": table(spark, d, "customer"), "nation": table(spark, d, "nation")}
    manifest = S.export_snapshot(tables, root)
    back = S.import_snapshot(spark, root, {n: t.schema for n, t in tables.items()}, manifest)
    out = None
    for name, df in back.items():
        row = df.agg(F.count("*").alias("rows")).withColumn("name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def link_kinds(spark, d):
    p = papers(spark, d)
    return p.groupBy(S.link_kind(F.lit("full text"), F.col("pdf_url")).alias("kind")).agg(F.count("*").alias("n"))


QUERIES = {
    "stream_tumbling": stream_tumbling, "stream_sliding": stream_sliding, "stream_sessions": stream_sessions, "stream_distinct": stream_distinct, "stream_limiter": stream_limiter,
    "source_json_lines": json_lines, "source_csv": csv_table, "source_html_pages": html_pages, "source_xml": xml_sections, "sink_generations": generations, "sink_snapshot": snapshot, "source_link_kinds": link_kinds,
}
SQL = {
    "stream_tumbling": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sliding": """SELECT start, count(*) AS n, max(value) AS most FROM (SELECT unnest([time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOURS]) start, value FROM events) GROUP BY 1""",
    "stream_sessions": """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 14400000000 THEN 1 ELSE 0 END s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM n GROUP BY user_id, k""",
    "stream_distinct": "SELECT DISTINCT event_id, event_type FROM events",
    "source_json_lines": f"SELECT paper_id, title, pub_year, CAST(len(topics) AS INTEGER) AS topics FROM {PAPERS}",
    "source_csv": f"SELECT paper_id, title, venue, pub_year FROM {PAPERS}",
    "source_html_pages": f"SELECT title, 'https://papers.example/' || paper_id AS link, pub_year AS year FROM {PAPERS} WHERE pub_year IS NOT NULL AND len(authors) > 0",
    "source_xml": "SELECT section AS title, doc_id FROM documents WHERE section IS NOT NULL",
    "sink_generations": f"SELECT paper_id, title, pub_year FROM {PAPERS}",
    "sink_snapshot": "SELECT count(DISTINCT paper_id) AS rows, 'papers' AS name FROM papers UNION ALL SELECT count(*), 'customer' FROM customer UNION ALL SELECT count(*), 'nation' FROM nation",
    "source_link_kinds": f"SELECT CASE WHEN lower(coalesce(pdf_url, '')) LIKE '%.pdf' THEN 'pdf' WHEN lower(coalesce(pdf_url, '')) LIKE 'http%' THEN 'source' ELSE 'other' END AS kind, count(*) AS n FROM {PAPERS} GROUP BY 1",
}
