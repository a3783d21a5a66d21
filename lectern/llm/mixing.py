"""Problem 7: mix sources to target weights.

The documents of each source are shuffled by hash and laid end to end, as often
as the source may be used; every ``block`` tokens of that line are one block.
The mixture is a list of slots of one block each: slot k takes the golden-ratio
point frac(k * phi) to the source whose stretch of the cumulative weights holds
it, so any prefix of the list already has the target shares.  The slots of a
source are ranked, and the slot of rank r is joined with block r of the source.
A document is used once for each of its blocks that has a slot, and the places it
comes out with (slot, and tokens into the slot) order the whole mixture.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import cut

GOLDEN = 0.6180339887498949


def schedule(spark, bounds: list[tuple[str, float]], slots: int, run: int = 65_536) -> DataFrame:
    """(slot, source_name, rank) of ``slots`` golden-ratio points under the
    cumulative weights ``bounds``.  Ranks are counted in runs of slots, so that no
    source's slots gather in a task."""
    point = F.col("slot") * F.lit(GOLDEN)
    point = point - F.floor(point)
    pick = F.lit(bounds[-1][0]) if bounds else F.lit(None).cast("string")
    for name, upto in reversed(bounds[:-1]):
        pick = F.when(point < upto, F.lit(name)).otherwise(pick)
    plan = spark.range(slots if bounds else 0).toDF("slot").select("slot", pick.alias("source_name"), F.floor(F.col("slot") / run).alias("run"))
    runs = plan.groupBy("source_name", "run").agg(F.count("*").alias("n"))
    runs = runs.select("source_name", "run", (F.sum("n").over(Window.partitionBy("source_name").orderBy("run")) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("source_name", "run").orderBy("slot")) - 1
    return plan.withColumn("inner", inner).join(runs, ["source_name", "run"]).select("slot", "source_name", (F.col("before") + F.col("inner")).alias("rank"))


def mix(docs: DataFrame, targets: DataFrame, slots: int | None = None, total: int | None = None, block_tokens: int = 262_144, buckets: int = 1024, few: int = 100_000, seed: int = 11):
    """(chosen, shares) for ``docs`` (doc_id, source_name, tokens).

    chosen: doc_id, source_name, tokens, repeats, places (slot and offset of each
    use, in order).  shares: source_name, target_share, max_repeats, documents,
    tokens, mixed_tokens, actual_share.

    The mixture has ``total`` tokens, by default the most that lets every source
    with documents reach its share within max_repeats passes.  It has ``slots``
    slots, by default one for every ``block_tokens`` tokens, at least 4,096, and
    at least 16 for the smallest share.  Targets without
    tokens get none and the others keep their proportions; documents of sources
    without a target, of a null source or without tokens are not used.  Target
    names must differ; there may be at most 1,000 of them, since they are read
    to the driver.  A source never passes max_repeats: should ``total`` ask for
    more, its last slots stay empty and the shares say so.  Schedules of at most
    ``few`` slots are broadcast, longer ones joined by a shuffle.
    """
    spark = docs.sparkSession
    rows = targets.where("source_name is not null").select("source_name", F.coalesce("target_share", F.lit(0.0)), F.coalesce("max_repeats", F.lit(1))).limit(1001).collect()
    if len(rows) > 1000 or len({r[0] for r in rows}) < len(rows):
        raise ValueError("at most 1,000 targets of different names")
    names = spark.createDataFrame([(r[0],) for r in rows], "source_name string")
    usable = docs.where("tokens > 0 and source_name is not null and doc_id is not null").select("doc_id", "source_name", "tokens").join(F.broadcast(names), "source_name")
    # two-level running sums: no source, however large, is in one task
    spot = F.xxhash64("doc_id", F.lit(seed))
    usable = cut(usable.withColumns({"spot": spot, "bucket": F.pmod(F.shiftright(spot, 7), F.lit(buckets)).cast("int")}), "mix-docs")
    per = cut(usable.groupBy("source_name", "bucket").agg(F.sum("tokens").cast("long").alias("n"), F.count("*").alias("d")), "mix-buckets")
    have = {r[0]: r[1] for r in per.groupBy("source_name").agg(F.sum("n")).collect()}
    live = sorted((r[0], r[1], max(0, r[2])) for r in rows if r[0] in have and r[1] > 0 and r[2] > 0)
    weight = sum(r[1] for r in live)
    most = min((r[2] * have[r[0]] * weight / r[1] for r in live), default=0)
    want = float(total if total is not None else most)
    if slots is None:
        slots = max(4096, math.ceil(want / block_tokens), *[math.ceil(16 * weight / r[1]) for r in live])
    block = max(want / slots, 1e-9) if live else 1.0

    bounds, upto = [], 0.0
    for name, share, _ in live:
        upto += share / weight
        bounds.append((name, upto))
    plan = cut(schedule(spark, bounds, slots), "mix-schedule")
    ranks = {r[0]: r[1] for r in plan.groupBy("source_name").count().collect()}
    # the passes over a source that its slots can reach
    info = spark.createDataFrame([(n, int(have[n]), min(most_, math.ceil(ranks.get(n, 0) * block / have[n])), ranks.get(n, 0)) for n, _, most_ in live], "source_name string, have long, passes int, ranks long")

    before = per.select("source_name", "bucket", (F.sum("n").over(Window.partitionBy("source_name").orderBy("bucket")) - F.col("n")).alias("before"))
    start = F.col("before") + F.sum("tokens").over(Window.partitionBy("source_name", "bucket").orderBy("spot", "doc_id")) - F.col("tokens")
    placed = usable.join(F.broadcast(before), ["source_name", "bucket"]).withColumn("start", start).join(F.broadcast(info.where("passes > 0")), "source_name")
    at = F.explode(F.transform(F.sequence(F.lit(0), F.col("passes") - 1), lambda p: p * F.col("have") + F.col("start")))
    uses = placed.select("doc_id", "source_name", "tokens", "ranks", at.alias("at")).withColumn("rank", F.floor(F.col("at") / F.lit(block))).where("rank < ranks")
    used = uses.join(F.broadcast(plan) if slots <= few else plan, ["source_name", "rank"])
    place = F.struct("slot", F.floor(F.col("at") - F.col("rank") * F.lit(block)).cast("long").alias("offset"))
    chosen = used.groupBy("doc_id", "source_name", "tokens").agg(F.sort_array(F.collect_list(place)).alias("places"))
    chosen = chosen.select("doc_id", "source_name", "tokens", F.size("places").alias("repeats"), "places")
    return chosen, _shares(chosen, targets, per)


def _shares(chosen: DataFrame, targets: DataFrame, per: DataFrame) -> DataFrame:
    got = chosen.groupBy("source_name").agg(F.sum(F.col("tokens") * F.col("repeats")).cast("long").alias("mixed_tokens"))
    have = per.groupBy("source_name").agg(F.sum("d").cast("long").alias("documents"), F.sum("n").cast("long").alias("tokens"))
    out = targets.where("source_name is not null").select("source_name", "target_share", "max_repeats").join(have, "source_name", "left").join(got, "source_name", "left").na.fill(0, ["documents", "tokens", "mixed_tokens"])
    total = F.sum("mixed_tokens").over(Window.partitionBy())
    return out.withColumn("actual_share", F.when(total > 0, F.col("mixed_tokens") / total).otherwise(0.0))
