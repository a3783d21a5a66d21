"""Ranking operators that go beyond one window."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators import relational as R


def holm(df: DataFrame, p: str, label: str, alpha: float = 0.05) -> DataFrame:
    """Holm's step-down correction: ``adjusted`` and ``rejected`` of each p-value.

    ``df`` holds one row a hypothesis, few by nature; ties go by label."""
    order = Window.orderBy(p, label)
    m = F.count("*").over(Window.partitionBy())
    ranked = df.withColumn("__i", F.row_number().over(order)).withColumn("__m", m)
    adjusted = F.least(F.lit(1.0), F.max(F.col(p) * (F.col("__m") - F.col("__i") + 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.withColumn("adjusted", adjusted).withColumn("rejected", F.col("adjusted") <= alpha).drop("__i", "__m")


def diversify(pool: DataFrame, query: str, k: int, scale: float = 1.0) -> DataFrame:
    """Greedy choice of ``k`` rows a query from a bounded candidate pool.

    ``pool`` has base (score), paper_id, chunk_index and position (order among
    equals, unique in the query).  A row loses 0.045 for every chosen row of its
    paper and 0.04 more if that is a neighbour, 0.16 at most.  Pools are top
    lists, so a group is small by construction.
    """
    schema = T.StructType([*pool.schema.fields, T.StructField("diversified", T.DoubleType()), T.StructField("chosen", T.IntegerType())])

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position", ignore_index=True)
        left, out = list(range(len(rows))), []
        lost = [0.0] * len(rows)
        paper, place, base = rows["paper_id"].tolist(), rows["chunk_index"].tolist(), rows["base"].tolist()
        score_of = {}
        while left and len(out) < k:
            best = max(left, key=lambda i: (max(0.0, base[i] - min(0.16, lost[i]) * scale), -i))
            score_of[best] = max(0.0, base[best] - min(0.16, lost[best]) * scale)
            out.append(best)
            left.remove(best)
            for i in left:
                if paper[i] is not None and paper[i] == paper[best]:
                    lost[i] += 0.045 + (0.04 if abs(place[i] - place[best]) <= 1 else 0.0)
        chosen = rows.iloc[out].copy()
        chosen["diversified"] = [score_of[i] for i in out]
        chosen["chosen"] = range(1, len(out) + 1)
        return chosen

    return pool.groupBy(query).applyInPandas(pick, schema)


def diversity_pool(df: DataFrame, query: str, k: int) -> DataFrame:
    """The rows among which :func:`diversify` can choose ``k``, with their position.

    Papers come in by their best row, so only the ``k`` best of these matter;
    of a paper, a row can be passed over for two neighbours of each chosen one,
    so its 3 ``k`` best rows do.  ``df`` has base, paper_id and chunk_index."""
    order = [F.desc("base"), F.col("chunk_index")]
    rows = R.top_k(df, [query, "paper_id"], order, 3 * k, "__r")
    best = R.top_k(rows.where("__r = 1"), [query], order, k).select(query, "paper_id")
    return R.top_k(rows.drop("__r").join(best, [query, "paper_id"], "left_semi"), [query], order, 3 * k * k, "position")


def _digest(fields: list[str]) -> F.Column:
    return F.sha2(F.concat_ws("|", *[F.col(f).cast("string") for f in fields]), 256)


def _link(before: F.Column, own: F.Column) -> F.Column:
    return F.sha2(F.concat_ws("|", F.coalesce(before, F.lit("")), own), 256)


def chain(rows: DataFrame, by: str, order: list[str], key: str, fields: list[str]) -> DataFrame:
    """(by, key, previous, link): a hash chain over the rows of each ``by``; a link
    is the hash of the digests of the row before and of the row itself."""
    w = Window.partitionBy(by).orderBy(*order)
    d = rows.withColumn("__d", _digest(fields))
    return d.select(by, key, F.lag(key).over(w).alias("previous"), _link(F.lag("__d").over(w), F.col("__d")).alias("link"))


def verify_chain(stored: DataFrame, rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``stored`` with ``valid``: whether the link, worked out anew from the rows
    that it names, is what was stored.  Rows are found by key, not by order."""
    d = rows.select(key, _digest(fields).alias("__d"))
    before = d.select(F.col(key).alias("previous"), F.col("__d").alias("__b"))
    found = stored.join(d, key, "left").join(before, "previous", "left")
    whole = F.col("__d").isNotNull() & (F.col("previous").isNull() | F.col("__b").isNotNull())
    return found.withColumn("valid", whole & (_link(F.col("__b"), F.col("__d")) == F.col("link"))).drop("__d", "__b")


def displacement(a: DataFrame, b: DataFrame, key: str, k: int) -> DataFrame:
    """Mean distance of the ranks of two top-``k`` lists; absent is k + 1."""
    both = a.select(key, F.col("rank").alias("ra")).join(b.select(key, F.col("rank").alias("rb")), key, "full")
    gap = F.abs(F.coalesce("ra", F.lit(k + 1)) - F.coalesce("rb", F.lit(k + 1)))
    return both.agg(F.avg(gap).alias("mean_displacement"), F.count("*").alias("items"))


def sessions(df: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """(key, session, start, end, n): runs of rows with gaps below the limit."""
    w = Window.partitionBy(key).orderBy(at)
    wait = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    starts = F.when(wait.isNull() | (wait > gap_seconds * 1_000_000), 1).otherwise(0)
    numbered = df.withColumn("__s", starts).withColumn("session", F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))
