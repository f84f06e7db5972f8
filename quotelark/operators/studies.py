"""Studies made of the other operators: backtests, capacity, structures, settlement and price panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def favourites(rows: DataFrame, event: str, p: str, tie: str) -> DataFrame:
    """The likeliest row of each event (first of equals) with its outcome."""
    best = rows.groupBy(event).agg(F.max(F.struct(p, (-F.col(tie)).alias("t"), "y")).alias("x"))
    return best.select(event, F.col(f"x.{p}").alias("p"), (-F.col("x.t")).alias(tie), F.col("x.y").alias("y"))


def capacity(bets: DataFrame, day: str, cap: int, order: Sequence[Column]) -> DataFrame:
    """Bets and profit per calendar day under a daily cap; days without bets count as zero."""
    kept = bets.withColumn("_r", F.row_number().over(W.partitionBy(day).orderBy(*order))).where(F.col("_r") <= cap)
    daily = kept.groupBy(day).agg(F.count(F.lit(1)).alias("bets"), F.sum("profit").alias("profit"))
    ends = bets.agg(F.min(day).alias("a"), F.max(day).alias("b"))  # one row
    spine = ends.select(F.explode(F.sequence("a", "b")).alias(day))
    return spine.join(daily, day, "left").select(day, F.coalesce("bets", F.lit(0)).alias("bets"), F.coalesce("profit", F.lit(0.0)).alias("profit"))


def deviation(rows: DataFrame, bucket: Column, z: float) -> DataFrame:
    """Outcome rate less market chance by bucket, with a normal interval and whether it holds zero."""
    gap, se = F.avg(F.col("y") - F.col("p")), F.stddev_samp(F.col("y") - F.col("p")) / F.sqrt(F.count(F.lit(1)))
    got = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), gap.alias("gap"), se.alias("se"))
    return got.withColumn("significant", F.coalesce(F.abs("gap") > z * F.col("se"), F.lit(False)))


def clustered_calibration(rows: DataFrame, cluster: str, by: Sequence[str]) -> DataFrame:
    """Bias with a cluster-robust error, Brier skill against climatology and effective clusters."""
    c = rows.groupBy(*by, cluster).agg(F.sum(F.col("y") - F.col("p")).alias("r"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("sq"))
    s = c.groupBy(*by).agg(
        F.sum("r").alias("r"), F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum("sq").alias("sq"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("r") * F.col("n")).alias("rn"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
    )
    bias, rate = F.col("r") / F.col("n"), F.col("pos") / F.col("n")
    se = F.sqrt(F.col("rr") - 2 * bias * F.col("rn") + bias * bias * F.col("nn")) / F.col("n")
    return s.select(*by, bias.alias("bias"), se.alias("se"), (1 - F.col("sq") / F.col("n") / (rate * (1 - rate))).alias("skill"), (F.col("n") * F.col("n") / F.col("nn")).alias("n_eff"))


def structures(legs: DataFrame, by: str) -> DataFrame:
    """Exact return distribution of a card of legs and of the same legs as singles, over all 2^k outcomes of an array of (p, odds).

    The outcomes of one card are an array inside its row; nothing is joined.
    """
    k = F.size("legs")
    masks = F.transform(F.sequence(F.lit(0), F.pow(F.lit(2), k).cast("int") - 1), lambda m: F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.shiftright(m, 0).bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0))

    def chance(m: Column) -> Column:
        return F.aggregate(F.zip_with(m, "legs", lambda w, g: F.when(w, g["p"]).otherwise(1 - g["p"])), F.lit(1.0), lambda s, x: s * x)

    def multi(m: Column) -> Column:
        return F.aggregate(F.zip_with(m, "legs", lambda w, g: F.when(w, g["odds"]).otherwise(0.0)), F.lit(1.0), lambda s, x: s * x) - 1

    def singles(m: Column) -> Column:
        return F.aggregate(F.zip_with(m, "legs", lambda w, g: F.when(w, g["odds"] - 1).otherwise(-1.0)), F.lit(0.0), lambda s, x: s + x) / k

    table = legs.withColumn("t", F.transform(masks, lambda m: F.struct(chance(m).alias("q"), multi(m).alias("a"), singles(m).alias("b"))))
    total = lambda f: F.aggregate("t", F.lit(0.0), lambda s, x: s + x["q"] * f(x))
    got = table.select(by, total(lambda x: x["a"]).alias("card_ev"), total(lambda x: x["a"] * x["a"]).alias("a2"), total(lambda x: x["b"]).alias("singles_ev"), total(lambda x: x["b"] * x["b"]).alias("b2"), total(lambda x: F.when(x["b"] <= -1, 1.0).otherwise(0.0)).alias("all_lost"))
    sd = lambda m, e: F.sqrt(F.greatest(F.lit(0.0), F.col(m) - F.col(e) * F.col(e)))
    return got.select(by, "card_ev", sd("a2", "card_ev").alias("card_sd"), "singles_ev", sd("b2", "singles_ev").alias("singles_sd"), "all_lost")


def convolved(a: Column, b: Column) -> Column:
    """Chances of totals of two independent counts, from arrays of chances."""
    return F.transform(
        F.sequence(F.lit(0), F.size(a) + F.size(b) - 2),
        lambda t: F.aggregate(F.sequence(F.greatest(F.lit(0), t - F.size(b) + 1), F.least(t, F.size(a) - 1)), F.lit(0.0), lambda s, i: s + F.get(a, i) * F.get(b, t - i)),
    )


def poisson_over(h: Column, a: Column, most: int, line: float) -> Column:
    """over() of convolved() for two Poisson counts up to `most` each, without arrays: totals up to `line` (at most `most`) are a Poisson count
    of rate h + a, so they are taken from the product of both counts' sums of x^k / k!."""
    def sums(x: Column, n: int) -> Column:
        out = F.lit(1.0)
        for k in range(n, 0, -1):
            out = 1.0 + x * F.lit(1 / k) * out
        return out

    return F.exp(-(h + a)) * (sums(h, most) * sums(a, most) - sums(h + a, int(line)))


def over(pmf: Column, line: float) -> Column:
    """Chance of a total above the line."""
    return F.aggregate(F.slice(pmf, int(line) + 2, 10_000), F.lit(0.0), lambda s, x: s + x)


def price_panel(quotes: DataFrame) -> DataFrame:
    """Each quote with the best, median and spread of its (market, outcome), its rank and its gap to the best."""
    w = W.partitionBy("market", "outcome")
    mid = quotes.groupBy("market", "outcome").agg(F.median("odds").alias("mid"), F.max("odds").alias("best"), F.stddev_pop("odds").alias("spread"), F.count(F.lit(1)).alias("books"))
    ranked = quotes.withColumn("place", F.rank().over(w.orderBy(F.desc("odds"))))
    return ranked.join(mid, ["market", "outcome"]).withColumn("gap", F.col("best") - F.col("odds"))


def event_outcome(rows: DataFrame, event: str, status: str) -> DataFrame:
    """CONFLICT where sources disagree."""
    got = rows.groupBy(event).agg(F.count_distinct(status).alias("n"), F.min(status).alias("s"), F.count(F.lit(1)).alias("sources"))
    return got.select(event, "sources", F.when(F.col("n") > 1, "CONFLICT").otherwise(F.col("s")).alias("outcome"))


def settle_with_fallback(bets: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The first source's result, else the second's; `source` says which, or UNRESOLVED."""
    a, b = first.select(key, F.col("result").alias("_a")), second.select(key, F.col("result").alias("_b"))
    out = bets.join(a, key, "left").join(b, key, "left")
    source = F.when(F.col("_a").isNotNull(), "PRIMARY").when(F.col("_b").isNotNull(), "FALLBACK").otherwise("UNRESOLVED")
    return out.withColumn("result", F.coalesce("_a", "_b")).withColumn("source", source).drop("_a", "_b")


def all_or_nothing(legs: DataFrame, results: DataFrame, card: str, leg: str) -> DataFrame:
    """Cards whose legs are all resolved, and whether they won; unresolved cards are counted with a null."""
    got = legs.join(results, leg, "left").groupBy(card).agg(F.count(F.lit(1)).alias("legs"), F.count("won").alias("resolved"), F.min("won").alias("w"))
    return got.select(card, "legs", "resolved", F.when(F.col("legs") == F.col("resolved"), F.col("w")).alias("won"))
