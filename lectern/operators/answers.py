"""Answer checking: terms, answerability, claims and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X


def answerability(hits: DataFrame, queries: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, terms, max_coverage, relevant, reason) for ranked hits.

    A passage is relevant if it has at least a quarter of the query's terms
    (0.34 for queries of fewer than four).  Queries without hits are kept."""
    q = queries.select("query_id", F.array_distinct(X.tokens(F.col("query"))).alias("want"))
    d = docs.select(key, F.array_distinct(X.tokens(F.col(text))).alias("have"))
    x = hits.select("query_id", key).join(F.broadcast(q), "query_id").join(d, key)
    share = F.size(F.array_intersect("want", "have")) / F.greatest(F.size("want"), F.lit(1))
    bar = F.when(F.size("want") >= 4, 0.25).otherwise(0.34)
    per = x.groupBy("query_id").agg(F.max(share).alias("best"), F.count_if(share >= bar).alias("relevant"))
    out = q.join(per, "query_id", "left")
    reason = F.when(F.col("best").isNull(), "no_retrieved_chunks").when(F.size("want") == 0, "no_terms").when(F.col("relevant") == 0, "low_coverage").otherwise("answerable")
    return out.select("query_id", F.size("want").alias("terms"), F.round(F.coalesce("best", F.lit(0.0)), 6).alias("max_coverage"), F.coalesce("relevant", F.lit(0).cast("long")).alias("relevant"), reason.alias("reason"))


def claims(df: DataFrame, key: str, text: str, least: int = 4) -> DataFrame:
    """(key, n, claim): sentences of at least ``least`` tokens, in order."""
    s = df.where(F.col(text).isNotNull()).select(key, F.posexplode(X.sentences(F.col(text))).alias("n", "claim"))
    return s.where(F.size(X.tokens(F.col("claim"))) >= least)


def best_sentence(df: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """The sentence of each text with most of the terms; the first of equals."""
    want = F.array(*[F.lit(t) for t in terms])
    s = claims(df, key, text, 1).withColumn("hits", F.size(F.array_intersect(want, F.array_distinct(X.tokens(F.col("claim")))))).where("hits > 0")
    return s.groupBy(key).agg(F.max(F.struct("hits", (-F.col("n")).alias("at"), "claim")).alias("b")).select(key, F.col("b.hits").alias("hits"), F.col("b.claim").alias("sentence"))


def points_covered(points, text) -> F.Column:
    """How many answer points a text covers: every group of a point needs any of
    its phrases."""
    low = F.lower(text)
    return F.size(F.filter(points, lambda p: (F.size(p["groups"]) > 0) & F.forall(p["groups"], lambda g: F.exists(g, lambda w: F.contains(low, F.lower(w))))))


#: What parts a sentence into claims of their own.
CLAUSE = r"\s*;\s+|,\s+(?:but|however|whereas|although)\s+"


def atomic_claims(df: DataFrame, key: str, text: str, least: int = 4) -> DataFrame:
    """(key, n, claim): the clauses of a text in order, without references in
    brackets; clauses of fewer than ``least`` tokens make no claim."""
    plain = F.regexp_replace(F.col(text), r"\s*\[[^\[\]]+\]\s*", " ")
    parts = F.flatten(F.transform(X.sentences(plain), lambda s: F.split(s, CLAUSE)))
    c = df.where(F.col(text).isNotNull()).select(key, F.posexplode(parts).alias("n", "claim"))
    c = c.withColumn("claim", F.regexp_replace("claim", r"^[ \-:;,.]+|[ \-:;,.]+$", ""))
    return c.where(F.size(X.tokens(F.col("claim"))) >= least)


def claim_support(claims: DataFrame, passages: DataFrame, key: str, cited: str, full: float = 0.8, part: float = 0.5) -> DataFrame:
    """(key, n, cited, overlap, support): how much of each claim's tokens the cited
    work has: ``supported`` from ``full``, ``partial`` from ``part``, else
    ``unsupported``; ``no_source`` without a citation or a text of it.

    ``claims`` is (key, n, claim, cited), ``passages`` (cited, text).  Claims and
    works meet on single tokens, so a work with many claims and passages costs
    their sum, not their product."""
    c = claims.select(key, "n", cited, F.array_distinct(X.tokens(F.col("claim"))).alias("t"))
    has = passages.where(F.col(cited).isNotNull()).select(cited, F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token")).distinct()
    known = passages.where(F.col(cited).isNotNull() & F.col("text").isNotNull()).select(cited, F.lit(True).alias("known")).distinct()
    hit = c.select(key, "n", cited, F.explode("t").alias("token")).join(has, [cited, "token"]).groupBy(key, "n").agg(F.count("*").alias("hits"))
    x = c.join(hit, [key, "n"], "left").join(known, cited, "left")
    share = F.coalesce(F.col("hits"), F.lit(0)) / F.greatest(F.size("t"), F.lit(1))
    label = F.when(F.col("known").isNull(), "no_source").when(share >= full, "supported").when(share >= part, "partial").otherwise("unsupported")
    return x.select(key, "n", cited, F.round(share, 6).alias("overlap"), label.alias("support"))


def containment(df: DataFrame, a: str, b: str, longer_than: int = 0) -> tuple:
    """Columns (shared, share): distinct tokens of ``a`` that ``b`` has too, and their
    share of those of ``a``; only tokens longer than ``longer_than`` count."""
    of = lambda c: F.filter(F.array_distinct(X.tokens(F.col(c))), lambda t: F.length(t) > longer_than)
    shared = F.size(F.array_intersect(of(a), of(b)))
    return shared, F.when(F.size(of(a)) > 0, shared / F.size(of(a))).otherwise(0.0)
