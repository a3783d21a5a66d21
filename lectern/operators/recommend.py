"""Recommendation: weighted scores, tuning, related papers, identities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators import relational as R


def _kinds(papers: DataFrame) -> DataFrame:
    """Papers as what a score depends on: topics, year, and whether there is a
    venue and a text.  There are as many kinds as vocabularies allow, however
    many papers there are."""
    return papers.select("paper_id", F.array_sort(F.array_distinct("topics")).alias("topics"), F.coalesce("pub_year", F.lit(2000)).alias("year"), F.col("venue").isNotNull().alias("placed"), F.col("pdf_url").isNotNull().alias("readable"))


KIND = ["topics", "year", "placed", "readable"]


def _wants(profiles: DataFrame) -> DataFrame:
    return profiles.where("size(preferred_topics) > 0").withColumn("want", F.array_sort(F.array_distinct("preferred_topics")))


def score(profiles: DataFrame, papers: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """(profile_id, paper_id, score, rank): the best ``k`` of all papers that share
    a topic with the profile, by weighted components in [0, 1]: shared topics,
    recency, a venue, an available text.  Weights must not be negative and are
    divided by their sum.

    Sets of wanted topics are scored against kinds of papers.  The ``k`` best
    kinds by score and first paper hold the ``k`` best papers, each among the
    first ``k`` of its kind, so no pair of a profile and a paper is made that is
    not an answer."""
    if any(w < 0 for w in weights.values()) or not sum(weights.values()):
        raise ValueError("weights must not be negative nor all zero")
    w = {n: v / sum(weights.values()) for n, v in weights.items()}
    firsts = R.top_k(_kinds(papers), KIND, [F.col("paper_id")], k, "nth")
    kinds = firsts.where("nth = 1").select(*KIND, F.col("paper_id").alias("first"))
    wanted = _wants(profiles).select("want").distinct()
    met = wanted.withColumn("topic", F.explode("want")).join(kinds.withColumn("topic", F.explode("topics")), "topic").dropDuplicates(["want", *KIND])
    parts = {
        "topics": F.size(F.array_intersect("want", "topics")) / F.size("want"),
        "recent": F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("year") - 2000) / 25.0)),
        "venue": F.col("placed").cast("double"),
        "text": F.col("readable").cast("double"),
    }
    total = sum((parts[n] * v for n, v in sorted(w.items())), F.lit(0.0))
    best = R.top_k(met.withColumn("score", F.round(total, 6)), ["want"], [F.desc("score"), F.col("first")], k).select("want", "score", *KIND)
    best = R.top_k(best.join(firsts, KIND), ["want"], [F.desc("score"), F.col("paper_id")], k)
    return _wants(profiles).select("profile_id", "want").join(best, "want").select("profile_id", "paper_id", "score", "rank")


def weight_wins(profiles: DataFrame, papers: DataFrame) -> DataFrame:
    """(tenths, wins, of): for weights of topics against recency in tenths, over
    how many other papers that share a wanted topic a profile's ``gold`` paper
    comes out, and how many there are.

    Pairs are counted by classes: profiles by wanted topics and what their own
    paper has, papers by what they share with the wanted topics and their year."""
    kinds = _kinds(papers)
    both = lambda t: F.size(F.array_intersect("want", t))
    share = lambda t: F.floor(both(t) * 1000 / F.size("want"))
    mine = _wants(profiles).select("want", "gold").join(kinds.select(F.col("paper_id").alias("gold"), "topics", "year"), "gold")
    mine = mine.groupBy("want", share("topics").alias("gt"), ((F.col("year") - 2000) * 40).alias("gy"), (both("topics") > 0).cast("long").alias("self")).agg(F.count("*").alias("m"))
    many = kinds.groupBy("topics", "year").agg(F.count("*").alias("n"))
    met = mine.select("want").distinct().withColumn("topic", F.explode("want")).join(many.withColumn("topic", F.explode("topics")), "topic").dropDuplicates(["want", "topics", "year"])
    rivals = met.groupBy("want", share("topics").alias("ct"), ((F.col("year") - 2000) * 40).alias("cy")).agg(F.sum("n").alias("n"))
    grid = F.broadcast(profiles.sparkSession.range(11).select(F.col("id").alias("tenths")))
    t = F.col("tenths")
    better = t * F.col("gt") + (10 - t) * F.col("gy") > t * F.col("ct") + (10 - t) * F.col("cy")
    pairs = mine.join(rivals, "want").crossJoin(grid).groupBy("tenths").agg(F.sum(F.when(better, F.col("m") * F.col("n")).otherwise(0)).cast("long").alias("wins"), F.sum(F.col("m") * F.col("n")).alias("of"))
    # a paper is no rival of its own
    own = mine.agg(F.coalesce(F.sum(F.col("m") * F.col("self")), F.lit(0)).alias("own"))
    return pairs.crossJoin(F.broadcast(own)).select("tenths", "wins", (F.col("of") - F.col("own")).cast("long").alias("of"))


def related(papers: DataFrame, k: int = 5) -> DataFrame:
    """(paper_id, related_id, score, rank): three points for each shared topic, two
    for each shared author, one for years at most two apart.  Papers that share
    neither topic nor author are not related.

    Topics are shared by many, so sets of topics are compared instead of
    papers: of a set and year the ``k`` + 1 first papers can matter.  Pairs are
    made only of papers with a common author."""
    p = papers.select("paper_id", F.array_sort(F.array_distinct("topics")).alias("topics"), F.col("pub_year").alias("year"))
    sets = p.where("size(topics) > 0").select("topics").distinct()
    a = sets.select(F.col("topics").alias("mine"), F.explode("topics").alias("t"))
    b = sets.select(F.col("topics").alias("theirs"), F.explode("topics").alias("t"))
    shared = a.join(b, "t").groupBy("mine", "theirs").agg((3 * F.count("*")).alias("points"))
    of_year = R.top_k(p, ["topics", "year"], [F.col("paper_id")], k + 1).select(F.col("topics").alias("theirs"), "year", F.col("paper_id").alias("related_id"))
    of_any = R.top_k(p, ["topics"], [F.col("paper_id")], k + 1).select(F.col("topics").alias("theirs"), F.col("paper_id").alias("related_id"))
    kinds = p.select(F.col("topics").alias("mine"), "year").distinct()
    near = shared.join(of_year.where("year is not null"), "theirs").select("mine", "related_id", (F.col("points") + 1).alias("score"), F.explode(F.sequence(F.col("year") - 2, F.col("year") + 2)).alias("year"))
    near = kinds.join(near, ["mine", "year"]).select("mine", "year", "related_id", "score")
    far = kinds.join(shared.join(of_any, "theirs"), "mine").select("mine", "year", "related_id", F.col("points").alias("score"))
    by_kind = near.unionByName(far).groupBy("mine", "year", "related_id").agg(F.max("score").alias("score"))
    by_kind = R.top_k(by_kind, ["mine", "year"], [F.desc("score"), F.col("related_id")], k + 1).drop("rank")
    same = p["topics"].eqNullSafe(by_kind["mine"]) & p["year"].eqNullSafe(by_kind["year"])
    topical = p.select("paper_id", "topics", "year").join(by_kind, same).where("paper_id <> related_id").select("paper_id", "related_id", "score")

    pairs = R.shared_counts(papers.select("paper_id", F.explode("authors").alias("t")), "paper_id", "t")
    left = p.select(F.col("paper_id").alias("a"), F.col("topics").alias("ta"), F.col("year").alias("ya"))
    right = p.select(F.col("paper_id").alias("b"), F.col("topics").alias("tb"), F.col("year").alias("yb"))
    both = F.coalesce(F.size(F.array_intersect("ta", "tb")), F.lit(0))
    points = 2 * F.col("shared") + 3 * F.greatest(both, F.lit(0)) + F.when(F.abs(F.col("ya") - F.col("yb")) <= 2, 1).otherwise(0)
    authored = pairs.join(left, "a").join(right, "b").select("a", "b", points.alias("score"))
    ways = authored.select(F.col("a").alias("paper_id"), F.col("b").alias("related_id"), "score").union(authored.select("b", "a", "score"))
    every = topical.union(ways).groupBy("paper_id", "related_id").agg(F.max("score").cast("long").alias("score"))
    return R.top_k(every, ["paper_id"], [F.desc("score"), F.col("related_id")], k)


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two strings, 0 to 1."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def identity_pairs(names: DataFrame, least: float = 0.84) -> DataFrame:
    """(a, b, ratio): folded names that may be one person: the same last word and
    first letter, and either an initial or alike first names.

    Names are blocked by last word and first letter; only the short list inside
    a block is compared."""
    n = names.select("name").where("name like '% %'").distinct().select("name", F.substring_index("name", " ", -1).alias("last"), F.substring_index("name", " ", 1).alias("first"))
    n = n.withColumn("block", F.concat_ws("|", "last", F.substring("first", 1, 1)))
    b = n.select("block", F.col("name").alias("b"), F.col("first").alias("fb"))
    p = n.select("block", F.col("name").alias("a"), F.col("first").alias("fa")).join(b, "block").where("a < b")
    short = (F.length("fa") == 1) | (F.length("fb") == 1)
    return p.select("a", "b", short.alias("initial"), F.round(likeness("fa", "fb"), 6).alias("ratio")).where(F.col("initial") | (F.col("ratio") >= least))
