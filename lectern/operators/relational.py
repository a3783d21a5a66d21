"""Relational building blocks: keep-one, top-k, visibility, joins with fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once(df: DataFrame, keys: Sequence[str], stamps: Sequence[str] = ("loaded_at", "written_at")) -> DataFrame:
    """One row a key: repeats differ only in their arrival stamps."""
    return df.drop(*[s for s in stamps if s in df.columns]).dropDuplicates(list(keys))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank from 1; ``order`` must
    be total, so that ties have one result."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def codes(**conditions: Column) -> Column:
    """The names of the conditions that hold, in the order given; a null
    condition does not hold."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions.items()]), lambda x: x.isNotNull())


def any_contains(values: str | Column, part: str) -> Column:
    """Whether any string of an array holds ``part``, whatever its case."""
    return F.coalesce(F.exists(values, lambda x: F.contains(F.lower(x), F.lit(part.lower()))), F.lit(False))


def with_fallback(left: DataFrame, right: DataFrame, on: str, take: str, fallback: str, name: str) -> DataFrame:
    """Left join that puts ``fallback`` where ``take`` found nothing."""
    return left.join(right.select(on, F.col(take).alias("__take")), on, "left").withColumn(name, F.coalesce("__take", fallback)).drop("__take")


def value_counts(df: DataFrame, column: str, seeds: Sequence[str] = (), unknown: str = "unknown") -> DataFrame:
    """(value, n): null and blank count as ``unknown``; seeds without rows get 0."""
    value = F.when(F.trim(F.coalesce(F.col(column), F.lit(""))) == "", F.lit(unknown)).otherwise(F.col(column))
    counted = df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    if not seeds:
        return counted
    zero = df.sparkSession.createDataFrame([(s, 0) for s in seeds], "value string, n long")
    return counted.unionByName(zero).groupBy("value").agg(F.sum("n").alias("n"))


def shared_counts(bridge: DataFrame, entity: str, through: str, repeats_matter: bool = False) -> DataFrame:
    """(a, b, shared): entities tied by the same ``through``, a < b.

    The self-join runs on distinct (entity, through); a ``through`` with many
    entities is inherently quadratic in its own size only.
    """
    once_ = bridge.select(F.col(through).alias("t"), F.col(entity).alias("e")).where("t is not null and e is not null")
    if not repeats_matter:
        once_ = once_.distinct()
    a, b = once_.select("t", F.col("e").alias("a")), once_.select("t", F.col("e").alias("b"))
    return a.join(b, "t").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """OFFSET/LIMIT over a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)
