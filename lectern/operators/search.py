"""Lexical and vector search over whole batches of queries.

Queries are a small DataFrame (query_id, query); postings and vectors are as
large as the corpus.  Every operator answers all queries in one plan.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import relational as R


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, key, tf, size): how often a text has a term, and its size in tokens."""
    t = docs.select(key, X.tokens(F.col(text)).alias("__t"))
    return t.select(key, F.size("__t").alias("size"), F.explode("__t").alias("term")).groupBy("term", key, "size").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(X.tokens(F.col("query")))).alias("term"))


def bm25(docs: DataFrame, queries: DataFrame, k: int | None, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, key, score, rank) by BM25 with any of the query's terms.

    Postings are restricted to the queries' terms before they are counted, so
    only those are shuffled.  The scores fall as matches get worse; ties go to
    the smaller key.  Queries without terms have no rows; without ``k`` all matches
    are given, without ranks."""
    terms = query_terms(queries)
    wanted = terms.select("term").distinct()
    t = docs.select(key, X.tokens(F.col(text)).alias("__t")).withColumn("size", F.size("__t"))
    total = t.agg(F.count("*").alias("docs"), F.avg("size").alias("mean"))
    tf = t.select(key, "size", F.explode("__t").alias("term")).join(wanted, "term").groupBy("term", key, "size").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = weigh(tf.join(df, "term"), total, terms, key, k1, b)
    return scored if k is None else R.top_k(scored, ["query_id"], [F.desc("score"), F.col(key)], k)


def weigh(tf: DataFrame, total: DataFrame, terms: DataFrame, key: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, key, score) by BM25 from postings (term, key, tf, size, df), one
    row of totals (docs, mean) and the queries' ``terms`` (query_id, term)."""
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    parts = tf.crossJoin(F.broadcast(total)).select("term", key, part.alias("part"))
    return parts.join(terms, "term").groupBy("query_id", key).agg(F.round(F.sum("part"), 6).alias("score"))


def coverage(docs: DataFrame, queries: DataFrame, k: int | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, key, score, rank) of a plain substring scorer:
    min(1, hits / max(words, 1) * 30 + share of terms found * 0.6), hits > 0;
    without ``k`` all matches are given, without ranks."""
    q = queries.select("query_id", F.array_distinct(X.tokens(F.col("query"))).alias("terms")).where(F.size("terms") > 0)
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    d = docs.select(key, low.alias("low"), F.size(F.filter(F.split(low, r"\s+"), lambda w: w != "")).alias("words"))
    x = d.crossJoin(F.broadcast(q)).select("query_id", key, "words", F.size("terms").alias("n"), F.transform("terms", lambda t: X.occurrences(F.col("low"), t)).alias("c"))
    hits = F.aggregate("c", F.lit(0), lambda a, v: a + v)
    found = F.size(F.filter("c", lambda v: v > 0))
    s = x.select("query_id", key, hits.alias("hits"), F.round(F.least(F.lit(1.0), hits / F.greatest("words", F.lit(1)) * 30.0 + found / F.col("n") * 0.6), 6).alias("score")).where("hits > 0").drop("hits")
    return s if k is None else R.top_k(s, ["query_id"], [F.desc("score"), F.col(key)], k)


def fuse(left: DataFrame, right: DataFrame, k: int, weights: tuple[float, float] = (0.42, 0.48), key: str = "doc_id") -> DataFrame:
    """Full outer fusion of two lists of scores: a missing side counts zero, the sum
    is clipped to [0, 1].  Give all matches, not the first of each side: what is
    low on one side may be first of both."""
    a = left.select("query_id", key, F.col("score").alias("a"))
    b = right.select("query_id", key, F.col("score").alias("b"))
    both = a.join(b, ["query_id", key], "full").na.fill(0.0, ["a", "b"])
    s = both.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("a") * weights[0] + F.col("b") * weights[1])), 6))
    return R.top_k(s, ["query_id"], [F.desc("score"), F.col(key)], k)


def feature_hashes(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = 256) -> DataFrame:
    """(key, bucket, weight): the sparse unit vector of each text by signed
    feature hashing; buckets whose signs cancel are left out."""
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    t = docs.select(key, F.explode(found).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    bucket, sign = X.hashed_bucket(F.col("token"), buckets)
    s = t.select(key, bucket.alias("bucket"), (sign * F.col("n")).alias("v")).groupBy(key, "bucket").agg(F.sum("v").alias("v")).where("v <> 0")
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return s.select(key, "bucket", F.round(F.col("v") / norm, 6).alias("weight"))


def hashed_nearest(hashes: DataFrame, queries: DataFrame, key: str = "doc_id", buckets: int = 256) -> DataFrame:
    """(query_id, key, score): cosines above zero of all queries with all texts by
    their :func:`feature_hashes`; texts and queries meet on common buckets."""
    q = feature_hashes(queries, "query_id", "query", buckets).select("query_id", "bucket", F.col("weight").alias("asked"))
    return hashes.join(q, "bucket").groupBy("query_id", key).agg(F.round(F.sum(F.col("weight") * F.col("asked")), 6).alias("score")).where("score > 0")


def exact_nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str, block: int = 2048) -> DataFrame:
    """(key, neighbour, cosine, rank): exact nearest vectors of a query set.

    Both sides are packed into blocks of about ``block`` rows by hash; every pair
    of blocks is one matrix product in a task of its own key, and only each
    query's best ``k`` of a block leave it.  Vectors of another length than the query's are no neighbours;
    zero, null and ragged ones are left out.  Ties go to the smaller key."""
    kind = vectors.schema[key].dataType.simpleString()

    def packed(df: DataFrame, side: str) -> DataFrame:
        good = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.exists(vector, lambda v: v != 0) & F.forall(vector, lambda v: v.isNotNull()))
        n = max(1, -(-good.count() // block))
        part = good.select(F.col(key), F.col(vector), F.size(vector).alias("dim"), F.pmod(F.xxhash64(key), F.lit(n)).alias("b"))

        def pack(table):
            x = np.asarray(table.column(vector).combine_chunks().flatten(), dtype=np.float64).reshape(table.num_rows, -1)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            return pa.table({"dim": pa.array([x.shape[1]], pa.int32()), f"{side}_keys": pa.array([table.column(key).to_pylist()]), f"{side}_data": pa.array([x.tobytes()], pa.binary())})

        return part.groupBy("dim", "b").applyInArrow(pack, f"dim int, {side}_keys array<{kind}>, {side}_data binary"), n

    (asked, _), (stored, n) = packed(queries, "q"), packed(vectors, "v")
    # every query block goes to each of the salts that the stored blocks are dealt to
    salts = min(n, 4096)
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pairs = asked.join(stored.withColumn("salt", F.pmod(F.xxhash64("v_data"), F.lit(salts)).cast("int")), ["dim", "salt"]).drop("salt")

    def product(batches):
        for batch in batches:
            for row in batch.to_pylist():
                q = np.frombuffer(row["q_data"]).reshape(-1, row["dim"])
                v = np.frombuffer(row["v_data"]).reshape(-1, row["dim"])
                names = np.asarray(row["v_keys"])
                cos = np.round(q @ v.T, 6)
                order = np.lexsort((np.broadcast_to(names, cos.shape), -cos), axis=1)[:, : k + 1]
                ids = np.repeat(np.asarray(row["q_keys"]), order.shape[1])
                near = names[order].ravel()
                best = np.take_along_axis(cos, order, 1).ravel()
                keep = ids != near
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(near[keep]), pa.array(best[keep])], [key, "neighbour", "cosine"])

    found = pairs.mapInArrow(product, f"{key} {kind}, neighbour {kind}, cosine double")
    return R.top_k(found, [key], [F.desc("cosine"), F.col("neighbour")], k)


def snippet(text, terms: list[str], window: int = 240, before: int = 80):
    """A stretch of ``window`` characters from shortly before the first term,
    white space collapsed, terms in double brackets."""
    low = F.lower(text)
    places = [F.nullif(F.regexp_instr(low, F.lit(rf"\b{re.escape(t.lower())}\b")), F.lit(0)) for t in terms]
    first = F.array_min(F.array(*places))
    start = F.greatest(F.coalesce(first - 1 - before, F.lit(0)), F.lit(0))
    out = F.trim(F.regexp_replace(F.substring(text, start + 1, F.lit(window)), r"\s+", " "))
    for t in sorted(set(terms), key=lambda t: (-len(t), t)):
        out = F.regexp_replace(out, "(?i)(?<![A-Za-z0-9])" + t + "(?![A-Za-z0-9])", "[[$0]]")
    return out
