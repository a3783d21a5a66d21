"""Statistics over results: intervals, resampling, tests, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.959963984540054


def wilson(successes: Column, trials: Column, z: float = Z) -> tuple[Column, Column]:
    """Lower and upper bound of a share; null without trials."""
    p, n = F.try_divide(successes, trials), trials
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    ok = trials > 0
    return F.when(ok, middle - half), F.when(ok, middle + half)


def draw(*parts: Column) -> Column:
    """A uniform number below 2^32 from the MD5 of the parts: a seeded stream
    that any engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


#: The distribution function of a Poisson variable of mean one.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def poisson_weight(uniform: Column) -> Column:
    out = F.lit(len(POISSON))
    for k in range(len(POISSON) - 1, -1, -1):
        out = F.when(uniform < POISSON[k], k).otherwise(out)
    return out


def bootstrap_mean(values: DataFrame, unit: str, value: str, repetitions: int = 200, seed: int = 20260712, level: float = 0.95) -> DataFrame:
    """(mean, low, high, n): percentile interval of a mean by a Poisson bootstrap.

    ``values`` has one row a unit (a user, a case).  In every replicate a unit
    weighs as often as a Poisson variable drawn by hash of replicate and unit, so
    no numbering and no sort of the units is needed; replicates are fixed in
    number and partial sums are combined before the shuffle.  Null values are
    left out; without any the result has no row."""
    good = values.where(F.col(value).isNotNull() & F.col(unit).isNotNull()).select(F.col(unit).alias("u"), F.col(value).alias("v"))
    reps = F.broadcast(values.sparkSession.range(repetitions).toDF("rep"))
    w = good.crossJoin(reps).withColumn("w", poisson_weight(draw(F.lit(seed), F.col("rep"), F.col("u")) / 4294967296.0))
    means = w.groupBy("rep").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("m"))
    low, high = (1 - level) / 2, 1 - (1 - level) / 2
    point = good.agg(F.avg("v").alias("mean"), F.count("*").alias("n")).where("n > 0")
    # one row each
    return means.agg(F.percentile("m", low).alias("low"), F.percentile("m", high).alias("high")).crossJoin(point).select("mean", "low", "high", "n")


def paired_bootstrap(pairs: DataFrame, unit: str, a: str, b: str, cluster: str | None = None, repetitions: int = 10_000, seed: int = 20260712, level: float = 0.95) -> DataFrame:
    """(mean, low, high, n): percentile interval of the mean difference ``a`` - ``b``.

    Both values of a pair are drawn together; with ``cluster`` all pairs of a
    cluster are, so the interval allows for their likeness.  Clusters are summed
    before they are drawn.  Pairs with a null on either side are left out."""
    good = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(unit).isNotNull()).withColumn("__d", F.col(a) - F.col(b))
    by = F.col(cluster or unit)
    drawn = good.where(by.isNotNull()).groupBy(by.alias("u")).agg(F.sum("__d").alias("s"), F.count("*").alias("n"))
    return _poisson_ratio(drawn, repetitions, seed, level)


def _poisson_ratio(drawn: DataFrame, repetitions: int, seed: int, level: float) -> DataFrame:
    """Interval of sum(s) / sum(n) over units ``u`` drawn by Poisson weights."""
    # replicates come in runs, so that a unit is a few rows and each row a few sums
    run = 10
    runs = F.broadcast(drawn.sparkSession.range(-(-repetitions // run)).toDF("run"))
    weight = lambda i: poisson_weight(draw(F.lit(seed), F.col("run") * run + i, F.col("u")) / 4294967296.0)
    w = drawn.crossJoin(runs).select("run", "s", "n", F.posexplode(F.array(*[weight(i) for i in range(run)])).alias("i", "w")).where("w > 0")
    means = w.groupBy((F.col("run") * run + F.col("i")).alias("rep")).agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m")).where(F.col("rep") < repetitions)
    low, high = (1 - level) / 2, 1 - (1 - level) / 2
    point = drawn.agg(F.try_divide(F.sum("s"), F.sum("n")).alias("mean"), F.sum("n").alias("n")).where("n > 0")
    return means.agg(F.percentile("m", low).alias("low"), F.percentile("m", high).alias("high")).crossJoin(point).select("mean", "low", "high", "n")


def sign_flip_test(pairs: DataFrame, difference: str, limit: int = 20, unit: str | None = None, repetitions: int = 10_000, seed: int = 20260712) -> DataFrame:
    """(pairs, statistic, p_value): two-sided paired permutation test of a mean.

    Up to ``limit`` nonzero differences it is exact: all 2^n sign patterns are one
    range of numbers whose bits are the signs.  Beyond that it needs ``unit``, the
    id of a pair, and draws ``repetitions`` sign patterns by hash of replicate and
    unit; the p-value then counts the pattern seen as one of them."""
    d = [r[0] for r in pairs.where(F.col(difference) != 0).select(difference).orderBy(difference).limit(limit + 1).collect()]
    spark = pairs.sparkSession
    if len(d) > limit:
        if unit is None:
            raise ValueError(f"more than {limit} nonzero pairs need the id of a pair")
        # whole numbers and halves add up alike in any order; other values are rounded to 1e-9
        good = pairs.where(F.col(difference).isNotNull() & (F.col(difference) != 0)).select(F.col(unit).alias("u"), F.col(difference).cast("decimal(28,9)").alias("x"))
        flips = good.crossJoin(F.broadcast(spark.range(repetitions).toDF("rep")))
        sign = F.when(draw(F.lit(seed), F.col("rep"), F.col("u")) % 2 == 0, F.col("x")).otherwise(-F.col("x"))
        totals = flips.groupBy("rep").agg(F.abs(F.sum(sign)).alias("t"))
        seen = good.agg(F.count("*").cast("int").alias("pairs"), F.sum("x").alias("s"))
        # one row each
        both = totals.crossJoin(F.broadcast(seen))
        return both.groupBy("pairs", (F.col("s").cast("double") / F.col("pairs")).alias("statistic")).agg(((F.count_if(F.col("t") >= F.abs("s")) + 1) / (repetitions + 1)).alias("p_value"))
    if not d:
        return spark.createDataFrame([(0, 0.0, 1.0)], "pairs int, statistic double, p_value double")
    flips = spark.range(1 << len(d))
    total = F.lit(0.0)
    for i, x in enumerate(d):
        total = total + F.when(F.shiftright("id", i).bitwiseAND(1) == 1, -x).otherwise(x)
    seen = abs(sum(d))
    return flips.agg(F.lit(len(d)).alias("pairs"), F.lit(sum(d) / len(d)).alias("statistic"), F.avg((F.abs(total) >= seen - 1e-12).cast("double")).alias("p_value"))


def threshold_sweep(scored: DataFrame, score: str, truth: str, low: int = 20, high: int = 60) -> DataFrame:
    """(threshold, tp, fp, fn, f1) for thresholds of whole hundredths.

    One histogram by hundredth and running sums from the top replace a join of
    every row with every threshold."""
    h = scored.withColumn("bin", F.least(F.greatest(F.floor(F.col(score) * 100 + 1e-9), F.lit(low - 1)), F.lit(high)).cast("int"))
    h = h.groupBy("bin").agg(F.count_if(F.col(truth)).alias("p"), F.count_if(~F.col(truth)).alias("n"))
    bins = scored.sparkSession.range(low - 1, high + 1).select(F.col("id").cast("int").alias("bin"))
    w = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    c = bins.join(h, "bin", "left").na.fill(0, ["p", "n"])
    c = c.select("bin", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp"), F.sum("p").over(Window.partitionBy()).alias("all_p")).where(F.col("bin") >= low)
    return c.select((F.col("bin") / 100).alias("threshold"), "tp", "fp", (F.col("all_p") - F.col("tp")).alias("fn"), F.coalesce(F.try_divide(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("all_p")), F.lit(0.0)).alias("f1"))


def ranked_metrics(run: DataFrame, judged: DataFrame, query: str, item: str, cutoffs: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """(query, k, recall, hit, precision, reciprocal_rank, ndcg) for every query that
    is judged, also without any result.

    ``run`` is (query, item, rank) from 1, ``judged`` (query, item, grade) with
    grades above zero for what is relevant; gain is 2^grade - 1.  The best order
    takes the first of each query's judged grades, largest first."""
    good = judged.where("grade > 0")
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    most = max(cutoffs)
    best = good.groupBy(query, "grade").agg(F.count("*").alias("n"))
    # grades are few: where each grade's run of ranks begins in the best order
    w = Window.partitionBy(query).orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("before") < most)
    spots = best.select(query, "grade", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("n"), F.lit(most)))).alias("rank"))
    hits = run.where(F.col("rank") <= most).join(good, [query, item])
    total = good.groupBy(query).agg(F.count("*").alias("relevant"))
    at = lambda k, value: F.sum(F.when(F.col("rank") <= k, value))
    discount = F.log2(F.col("rank") + 1.0)
    got = hits.groupBy(query).agg(F.min("rank").alias("first"), *[at(k, F.lit(1)).alias(f"h{k}") for k in cutoffs], *[at(k, gain / discount).alias(f"d{k}") for k in cutoffs])
    ideal = spots.groupBy(query).agg(*[at(k, gain / discount).alias(f"i{k}") for k in cutoffs])
    x = total.join(ideal, query).join(got, query, "left")
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(k).alias("k"), (F.coalesce(f"h{k}", F.lit(0)) / F.col("relevant")).alias("recall"), (F.coalesce(f"h{k}", F.lit(0)) > 0).cast("double").alias("hit"),
            (F.coalesce(f"h{k}", F.lit(0)) / F.lit(k)).alias("precision"), F.when(F.col("first") <= k, 1 / F.col("first")).otherwise(0.0).alias("reciprocal_rank"),
            F.coalesce(F.col(f"d{k}") / F.col(f"i{k}"), F.lit(0.0)).alias("ndcg"),
        ) for k in cutoffs
    ]))
    return x.select(query, rows.alias("m")).select(query, "m.*")
