"""Changes between snapshots: classify, merge, replace, diff."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    flat = F.trim(F.regexp_replace(c.cast("string"), r"\s+", " "))
    return F.when(flat != "", flat)


def classify(stored: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, change): ``new``, ``changed`` or ``unchanged`` of each incoming row.

    Null or blank incoming values say nothing; white space does not matter."""
    old = stored.select(key, F.lit(True).alias("__known"), *[F.col(c).alias(f"__{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | (_text(c).isNotNull() & ~_text(c).eqNullSafe(_text(f"__{c}")))
    kind = F.when(F.col("__known").isNull(), "new").when(differs, "changed").otherwise("unchanged")
    return incoming.join(old, key, "left").select(key, kind.alias("change"))


def merge(stored: DataFrame, incoming: DataFrame, key: str, columns: Sequence[str], protected: Column | None = None) -> DataFrame:
    """The next snapshot: stored rows updated by incoming ones, new rows added.

    Incoming nulls keep the stored value; rows for which ``protected`` (over the
    stored columns) holds keep all stored values and are marked ``conflict``
    where the incoming differ.  One full outer join, no update in place."""
    old = stored.select(key, F.lit(True).alias("__old"), (protected if protected is not None else F.lit(False)).alias("__keep"), *[F.col(c).alias(f"__o_{c}") for c in columns])
    new = incoming.select(key, F.lit(True).alias("__new"), *[F.col(c).alias(f"__n_{c}") for c in columns])
    j = old.join(new, key, "full")
    keep = F.coalesce(F.col("__keep"), F.lit(False))
    differs = F.lit(False)
    for c in columns:
        differs = differs | (F.col(f"__n_{c}").isNotNull() & ~F.col(f"__n_{c}").eqNullSafe(F.col(f"__o_{c}")))
    values = [F.when(keep, F.col(f"__o_{c}")).otherwise(F.coalesce(f"__n_{c}", f"__o_{c}")).alias(c) for c in columns]
    state = F.when(F.col("__old").isNull(), "inserted").when(F.col("__new").isNull(), "kept").when(keep & differs, "conflict").when(differs, "updated").otherwise("kept")
    return j.select(key, *values, state.alias("state"))


def replace_keys(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of the keys in ``incoming`` are replaced by the incoming ones."""
    return stored.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def diffs(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, field, before, after): one row for each field that changed."""
    old = before.select(key, *[F.col(c).cast("string").alias(f"__{c}") for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"__{c}").alias("before"), F.col(c).cast("string").alias("after")) for c in columns])
    j = after.join(old, key).select(key, F.explode(F.filter(pairs, lambda p: ~p["before"].eqNullSafe(p["after"]))).alias("d"))
    return j.select(key, "d.field", "d.before", "d.after")


def reattach(derived: DataFrame, reviews: DataFrame, key: str, fingerprint: str, status: str) -> DataFrame:
    """A review stays on a rebuilt row only if the row's fingerprint is the same."""
    r = reviews.select(key, F.col(fingerprint).alias("__f"), F.col(status).alias("__s"))
    same = F.col(fingerprint).eqNullSafe(F.col("__f"))
    return derived.join(r, key, "left").withColumn(status, F.when(same, F.col("__s")).otherwise("needs_review")).drop("__f", "__s")
