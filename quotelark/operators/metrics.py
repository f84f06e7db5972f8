"""Scores, calibration, returns and effect sizes as aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotelark.scratch import cut

from quotelark.functions.odds import clip


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def log_loss(p: Column, y: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """Low and high end of a share's interval; null without trials."""
    share = k / n
    centre, spread = share + z * z / (2 * n), z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.struct(((centre - spread) / (1 + z * z / n)).alias("low"), ((centre + spread) / (1 + z * z / n)).alias("high")))


def equal_count_bins(rows: DataFrame, order: Sequence[Column], bins: int, extras: str = "first", by: Sequence[str] = ()) -> DataFrame:
    """rows with `bin`, from 0, of nearly equal counts; the extras go to the first or to the last bins.

    Rows are ranked by ranges, within `by` too, so that no task holds more than its range.
    """
    ranked = group_rank(rows, by, list(order))
    n, r = F.col("_n"), F.col("rank")
    size, more = F.floor(n / bins), n % bins
    if extras == "last":
        r = n - 1 - r
    bin_ = F.when(r < more * (size + 1), F.floor(r / (size + 1))).otherwise(more + F.floor((r - more * (size + 1)) / F.greatest(size, F.lit(1)))).cast("int")
    return ranked.withColumn("bin", bin_ if extras == "first" else (bins - 1 - bin_).cast("int")).drop("rank", "_n")


def group_rank(rows: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """rows with `rank` from 0 within `by` in the given total order, and the group's size `_n`.

    All groups are ranked at once by ranges of (by, order), so a group of any size is spread; a table of a row a group is joined.
    """
    ranked, _ = global_rank(rows, [*map(F.col, by), *order])
    sizes = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("rank").alias("_first"))
    if not by:
        return ranked.crossJoin(F.broadcast(sizes)).drop("_first")  # one row
    same = sizes.select(*[F.col(c).alias(f"_{c}") for c in by], "_n", "_first")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return ranked.join(same, reduce(Column.__and__, on)).withColumn("rank", F.col("rank") - F.col("_first")).drop("_first", *[f"_{c}" for c in by])


def prior_sums(values: DataFrame, by: Sequence[str], order: Sequence[str], weight: str) -> DataFrame:
    """values with `before`: the sum of `weight` over all rows of the group ahead in `order`.

    Rows are dealt by ranges of (by, order), which are cut by a sample of them, so neither a large group nor a far value fills a task; sums run
    within a range, and each range's start comes from the sums of those ahead, a row for each range and group.
    """
    ranged = cut(values.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "_part").agg(F.sum(weight).alias("_sum"))
    ahead = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_of"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start"))
    within = W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("_part") == F.col("_of"))
    placed = ranged.withColumn("_within", F.coalesce(F.sum(weight).over(within), F.lit(0))).join(starts, on)
    return placed.withColumn("before", F.col("_start") + F.col("_within")).drop("_part", "_of", "_start", "_within", *[f"_{c}" for c in by])


def percentiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(by, q: array): exact interpolated percentiles of few groups, however large and however their values lie.

    Values are counted first; counts ahead of each value (prior_sums) tell which values hold the wanted ranks.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    run = cut(prior_sums(counts, by, ["_v"], "_c"))
    sizes = run.groupBy(*by).agg(F.sum("_c").alias("_n"))  # a row a group
    at = lambda q: F.lit(q) * (F.col("_n") - 1)
    ranks = F.array(*[F.struct(F.lit(k).alias("k"), r.alias("r"), w.alias("w")) for k, q in enumerate(shares) for r, w in ((F.floor(at(q)), 1 - (at(q) - F.floor(at(q)))), (F.floor(at(q)) + 1, at(q) - F.floor(at(q))))])
    asks = sizes.select(*by, F.explode(ranks).alias("a")).select(*by, "a.k", "a.r", "a.w").where("w > 0")
    hit = run.join(asks, list(by)).where("before <= r and r < before + _c")
    one = hit.groupBy(*by, "k").agg(F.sum(F.col("w") * F.col("_v")).alias("x"))
    return one.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("q"))


def global_rank(rows: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, int]:
    """rows with `rank` from 0 in the given total order, and their number: sorted in ranges, offsets from counts by range."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    sorted_ = cut(sorted_)  # written, so that ranks and offsets are of one evaluation
    counts = sorted((r["_part"], r["count"]) for r in sorted_.groupBy(F.shiftright("_at", 33).alias("_part")).count().collect())  # a row a range
    pairs, total = [], 0
    for part, n in counts:
        pairs += [F.lit(part), F.lit(total)]
        total += n
    if not counts:
        return sorted_.withColumn("rank", F.lit(0).cast("long")).drop("_at"), 0
    start = F.element_at(F.create_map(*pairs), F.shiftright("_at", 33))
    return sorted_.withColumn("rank", (start + F.col("_at") - F.shiftleft(F.shiftright("_at", 33), 33)).cast("long")).drop("_at"), total


def calibration_table(binned: DataFrame, by: Sequence[str] = ("bin",)) -> DataFrame:
    return binned.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))


def expected_calibration_error(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))


def auc(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve by average ranks. Rows are counted by distinct p, and counts ahead of each are summed by ranges."""
    values = rows.groupBy(*by, "p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    ranked = prior_sums(values, by, ["p"], "n").withColumn("ranks", (F.col("before") + (F.col("n") + 1) / 2) * F.col("pos"))
    pos, all_ = F.sum("pos"), F.sum("n")
    return ranked.groupBy(*by).agg(((F.sum("ranks") - pos * (pos + 1) / 2) / (pos * (all_ - pos))).alias("auc"))


def cohens_d(value: Column, good: Column) -> Column:
    """Difference of means over the pooled deviation (population variances, n - 1 weights); null under five rows a side."""
    a, b = F.when(good, value), F.when(~good, value)
    na, nb = F.count(a), F.count(b)
    pooled = F.sqrt(((na - 1) * F.var_pop(a) + (nb - 1) * F.var_pop(b)) / (na + nb - 2))
    return F.when((na >= 5) & (nb >= 5), (F.avg(a) - F.avg(b)) / pooled)


def returns(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bets, stake, profit, return and hit rate by any keys; rows have staked, profit and won."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("bets"), F.sum("staked").alias("staked"), F.sum("profit").alias("profit"),
        (F.sum("profit") / F.sum("staked")).alias("roi"), F.avg("won").alias("hit_rate"),
    )


def thresholds(rows: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """Counts and rates for p >= t, for every t: rows are counted by band once, then summed from the top; no row is repeated."""
    bands = rows.withColumn("band", sum((F.col("p") >= t).cast("int") for t in cuts)).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    grid = rows.sparkSession.createDataFrame([(k + 1, float(t)) for k, t in enumerate(sorted(cuts))], "k int, threshold double")
    return grid.join(F.broadcast(bands), F.col("band") >= F.col("k")).groupBy("threshold").agg(F.sum("n").alias("n"), (F.sum("pos") / F.sum("n")).alias("rate"))


def holm(p_values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Holm-adjusted p-values: running maximum of (m - rank) p, at most 1."""
    w = W.partitionBy(*by).orderBy("p_value", "test")
    m = F.count(F.lit(1)).over(W.partitionBy(*by))
    raw = p_values.withColumn("raw", F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col("p_value")))
    return raw.withColumn("adjusted", F.max("raw").over(w)).drop("raw")


def bootstrap(rows: DataFrame, cluster: str, value: Column, weight: Column, draws: int, by: Sequence[str] = (), seed: str = "boot") -> DataFrame:
    """Ratio of sums under `draws` cluster bootstraps: (by, draw, estimate).

    A cluster's weight in a draw is Poisson(1), from a hash of (cluster, draw): draws need no resampling and agree on reruns.
    Rows are summed by cluster first, so only clusters are multiplied by draws.
    """
    sums = rows.groupBy(*by, cluster).agg(F.sum(value).alias("v"), F.sum(weight).alias("w"))
    times = sums.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(cluster).cast("string"), F.col("draw").cast("string")).cast("binary")), 1, 12), 16, 10).cast("double") / float(16**12)
    k, total, term = F.lit(0), 0.0, 0.36787944117144233
    for i in range(9):
        total += term
        k = k + (u >= total).cast("int")
        term /= i + 1
    return times.withColumn("k", k).groupBy(*by, "draw").agg((F.sum(F.col("k") * F.col("v")) / F.sum(F.col("k") * F.col("w"))).alias("estimate"))
