"""Snapshots, change classes, merges, and integrity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import changes as C
from lectern.operators import relational as R
from lectern.plans.catalog import PAPERS, documents, papers
from lectern.session import table


def _stored(spark, d):
    """An older snapshot: papers created before July, some fields then unknown."""
    draw = F.conv(F.substring(F.md5("paper_id"), 1, 6), 16, 10).cast("int")
    return papers(spark, d).where("created_at < timestamp_ntz'2025-07-01'").select("paper_id", F.when(draw % 3 == 0, F.upper("title")).otherwise(F.col("title")).alias("title"), F.when(draw % 5 != 0, F.col("venue")).alias("venue"), F.col("pub_year"))


def classified(spark, d):
    return C.classify(_stored(spark, d), papers(spark, d), "paper_id", ["title", "venue", "pub_year"])


def merged(spark, d):
    return C.merge(_stored(spark, d), papers(spark, d), "paper_id", ["title", "venue", "pub_year"], F.col("pub_year") < 2010)


def field_diffs(spark, d):
    return C.diffs(_stored(spark, d), papers(spark, d), "paper_id", ["title", "venue"])


def replaced(spark, d):
    """The documents after the French ones came again in upper case."""
    docs = documents(spark, d).select("doc_id", "lang", "text")
    again = docs.where("lang = 'fr'").withColumn("text", F.upper("text"))
    return C.replace_keys(docs, again, "doc_id").select("doc_id", "lang", F.md5("text").alias("text_md5"))


def reviews_reattached(spark, d):
    now = papers(spark, d).select("paper_id", F.md5(F.concat_ws("|", "title", F.coalesce("venue", F.lit("")))).alias("fingerprint"))
    old = _stored(spark, d).select("paper_id", F.md5(F.concat_ws("|", "title", F.coalesce("venue", F.lit("")))).alias("fingerprint"), F.lit("approved").alias("review"))
    return C.reattach(now, old, "paper_id", "fingerprint", "review").select("paper_id", "review")


def late_rows(spark, d):
    """How late rows arrive: days from creation to arrival, by bands."""
    q = table(spark, d, "qa_selective_response_v2").groupBy("case_id").agg(F.min("loaded_at").alias("loaded_at"), F.min("created_at").alias("created_at"), F.count("*").alias("arrivals"))
    days = F.timestamp_diff("DAY", "created_at", "loaded_at")
    band = F.when(days < 2, "0-1").when(days < 14, "2-13").otherwise("14+")
    return q.groupBy(band.alias("days")).agg(F.count("*").alias("n"), F.sum("arrivals").cast("long").alias("arrivals"))


def json_check(spark, d):
    """Malformed values and values that are no object in a JSON column."""
    e = table(spark, d, "events").select("event_id", F.try_parse_json("props").alias("v"), "props")
    kind = F.when(F.col("props").isNull(), "null").when(F.col("v").isNull(), "malformed").when(F.schema_of_variant("v").startswith("OBJECT"), "object").otherwise("other")
    return e.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def json_fields(spark, d):
    e = table(spark, d, "events").select("event_type", F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("field"))
    return e.groupBy("event_type", "field").agg(F.count("*").alias("n"))


def foreign_keys(spark, d):
    """Rows whose reference is not there, for every reference."""
    refs = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("documents", "paper_id", "papers", "paper_id"), ("ocr", "paper_id", "papers", "paper_id")]
    out = None
    for child, fk, parent, pk in refs:
        lost = table(spark, d, child).where(F.col(fk).isNotNull()).select(F.col(fk).alias("k")).join(table(spark, d, parent).select(F.col(pk).alias("k")).distinct(), "k", "left_anti")
        row = lost.agg(F.count("*").alias("orphans")).select(F.lit(f"{child}.{fk}").alias("reference"), "orphans")
        out = row if out is None else out.unionByName(row)
    return out


def vector_checks(spark, d):
    """Defects of the vector store's records, by code."""
    p = table(spark, d, "vector_store").select("build_id", "provider", "model_name", "payload.*")
    v = F.col("embedding")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    flags = R.codes(null_vector=v.isNull(), empty_vector=F.size(v) == 0, wrong_size=(F.size(v) > 0) & (F.size(v) != F.col("dimensions")), zero_vector=(F.size(v) > 0) & ~F.exists(v, lambda x: x != 0), not_unit=(F.size(v) == F.col("dimensions")) & (F.abs(norm - 1) >= 0.05) & F.exists(v, lambda x: x != 0), no_model=F.col("model_name").isNull())
    return p.select("chunk_id", F.explode(flags).alias("code")).groupBy("code").agg(F.countDistinct("chunk_id").alias("chunks"))


def index_readiness(spark, d):
    """State of each build: how many of its records are whole."""
    p = table(spark, d, "vector_store").select("build_id", F.col("payload.chunk_id").alias("chunk_id"), (F.size("payload.embedding") == F.col("payload.dimensions")).alias("whole"))
    b = p.groupBy("build_id").agg(F.countDistinct("chunk_id").alias("chunks"), F.countDistinct(F.when(F.col("whole"), F.col("chunk_id"))).alias("whole"))
    return b.select("build_id", "chunks", "whole", F.round(F.col("whole") / F.col("chunks"), 6).alias("coverage"), F.when(F.col("whole") == F.col("chunks"), "ready").when(F.col("whole") == 0, "not_built").otherwise("invalid").alias("state"))


def length_check(spark, d):
    x = documents(spark, d).select((F.length(F.coalesce("text", F.lit(""))) == F.coalesce("n_chars", F.lit(-1))).alias("right"), F.col("n_chars").isNull().alias("none"))
    return x.groupBy(F.when(F.col("right"), "right").when(F.col("none"), "missing").otherwise("wrong").alias("n_chars_state")).agg(F.count("*").alias("n"))


def unique_keys(spark, d):
    out = None
    for name, keys in (("papers", ["paper_id"]), ("qa_selective_response_v2", ["case_id"]), ("finder_proxy_profiles_v2", ["profile_id"]), ("ocr", ["paper_id", "page_number"]), ("documents", ["doc_id"]), ("lineitem", ["l_orderkey", "l_linenumber"])):
        row = table(spark, d, name).groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("repeated"), F.sum("n").cast("long").alias("rows")).withColumn("name", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


QUERIES = {
    "change_classify": classified, "change_merge": merged, "change_diffs": field_diffs, "change_replace": replaced, "change_reattach": reviews_reattached, "change_late_rows": late_rows,
    "check_json": json_check, "check_json_fields": json_fields, "check_foreign_keys": foreign_keys, "check_vectors": vector_checks, "check_readiness": index_readiness, "check_lengths": length_check, "check_unique": unique_keys,
}

_OLD = f"""(SELECT paper_id, CASE WHEN crc % 3 = 0 THEN upper(title) ELSE title END title, CASE WHEN crc % 5 <> 0 THEN venue END venue, pub_year FROM (SELECT *, CAST('0x' || substr(md5(paper_id), 1, 6) AS INTEGER) crc FROM {PAPERS}) WHERE created_at < TIMESTAMP '2025-07-01')"""
SQL = {
    "change_classify": f"SELECT n.paper_id AS paper_id, CASE WHEN o.paper_id IS NULL THEN 'new' WHEN n.title IS DISTINCT FROM o.title OR (n.venue IS NOT NULL AND n.venue IS DISTINCT FROM o.venue) OR (n.pub_year IS NOT NULL AND n.pub_year IS DISTINCT FROM o.pub_year) THEN 'changed' ELSE 'unchanged' END AS change FROM {PAPERS} n LEFT JOIN {_OLD} o ON o.paper_id = n.paper_id",
    "change_merge": f"""SELECT n.paper_id AS paper_id, CASE WHEN o.pub_year < 2010 THEN o.title ELSE coalesce(n.title, o.title) END AS title, CASE WHEN o.pub_year < 2010 THEN o.venue ELSE coalesce(n.venue, o.venue) END AS venue, CASE WHEN o.pub_year < 2010 THEN o.pub_year ELSE coalesce(n.pub_year, o.pub_year) END AS pub_year,
        CASE WHEN o.paper_id IS NULL THEN 'inserted' WHEN n.title IS DISTINCT FROM o.title OR (n.venue IS NOT NULL AND n.venue IS DISTINCT FROM o.venue) THEN CASE WHEN o.pub_year < 2010 THEN 'conflict' ELSE 'updated' END ELSE 'kept' END AS state FROM {PAPERS} n LEFT JOIN {_OLD} o ON o.paper_id = n.paper_id""",
    "change_diffs": f"""SELECT n.paper_id AS paper_id, 'title' AS field, o.title AS before, n.title AS after FROM {PAPERS} n JOIN {_OLD} o ON o.paper_id = n.paper_id WHERE n.title IS DISTINCT FROM o.title
        UNION ALL SELECT n.paper_id, 'venue', o.venue, n.venue FROM {PAPERS} n JOIN {_OLD} o ON o.paper_id = n.paper_id WHERE n.venue IS DISTINCT FROM o.venue""",
    "change_replace": "SELECT doc_id, lang, md5(CASE WHEN lang = 'fr' THEN upper(text) ELSE text END) AS text_md5 FROM documents",
    "change_reattach": f"SELECT n.paper_id AS paper_id, CASE WHEN o.paper_id IS NOT NULL AND n.title = o.title AND coalesce(n.venue, '') = coalesce(o.venue, '') THEN 'approved' ELSE 'needs_review' END AS review FROM {PAPERS} n LEFT JOIN {_OLD} o ON o.paper_id = n.paper_id",
    "change_late_rows": """WITH q AS (SELECT min(loaded_at) l, min(created_at) c, count(*) a FROM qa_selective_response_v2 GROUP BY case_id), x AS (SELECT a, (epoch_us(l) - epoch_us(c)) // 86400000000 dd FROM q)
        SELECT CASE WHEN dd < 2 THEN '0-1' WHEN dd < 14 THEN '2-13' ELSE '14+' END AS days, count(*) AS n, CAST(sum(a) AS BIGINT) AS arrivals FROM x GROUP BY 1""",
    "check_json": "SELECT CASE WHEN props IS NULL THEN 'null' WHEN NOT json_valid(props) THEN 'malformed' WHEN json_type(props) = 'OBJECT' THEN 'object' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1",
    "check_json_fields": "SELECT event_type, field, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) field FROM events) GROUP BY 1, 2",
    "check_foreign_keys": " UNION ALL ".join(f"SELECT '{c}.{f}' AS reference, count(*) AS orphans FROM {c} WHERE {f} IS NOT NULL AND {f} NOT IN (SELECT {k} FROM {p})" for c, f, p, k in (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("documents", "paper_id", "papers", "paper_id"), ("ocr", "paper_id", "papers", "paper_id"))),
    "check_vectors": """WITH p AS (SELECT payload.chunk_id c, payload.embedding v, payload.dimensions n, model_name FROM vector_store), z AS (SELECT *, len(list_filter(v, lambda x: x <> 0)) > 0 nz, sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) norm FROM p),
        f AS (SELECT c, unnest(list_filter([CASE WHEN v IS NULL THEN 'null_vector' END, CASE WHEN len(v) = 0 THEN 'empty_vector' END, CASE WHEN len(v) > 0 AND len(v) <> n THEN 'wrong_size' END, CASE WHEN len(v) > 0 AND NOT nz THEN 'zero_vector' END,
        CASE WHEN len(v) = n AND nz AND abs(norm - 1) >= 0.05 THEN 'not_unit' END, CASE WHEN model_name IS NULL THEN 'no_model' END], lambda x: x IS NOT NULL)) code FROM z) SELECT code, count(DISTINCT c) AS chunks FROM f GROUP BY 1""",
    "check_readiness": """WITH b AS (SELECT build_id, count(DISTINCT payload.chunk_id) chunks, count(DISTINCT CASE WHEN len(payload.embedding) = payload.dimensions THEN payload.chunk_id END) whole FROM vector_store GROUP BY 1)
        SELECT build_id, chunks, whole, round(whole / chunks, 6) AS coverage, CASE WHEN whole = chunks THEN 'ready' WHEN whole = 0 THEN 'not_built' ELSE 'invalid' END AS state FROM b""",
    "check_lengths": "SELECT CASE WHEN length(coalesce(text, '')) = coalesce(n_chars, -1) THEN 'right' WHEN n_chars IS NULL THEN 'missing' ELSE 'wrong' END AS n_chars_state, count(*) AS n FROM documents GROUP BY 1",
    "check_unique": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS keys, count(*) FILTER (WHERE n > 1) AS repeated, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT count(*) n FROM {t} GROUP BY {k})" for t, k in (("papers", "paper_id"), ("qa_selective_response_v2", "case_id"), ("finder_proxy_profiles_v2", "profile_id"), ("ocr", "paper_id, page_number"), ("documents", "doc_id"), ("lineitem", "l_orderkey, l_linenumber"))),
}
