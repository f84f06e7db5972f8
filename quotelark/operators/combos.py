"""Combinations, dependence and their returns, without enumerating what sums can tell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_n(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def pairs(pool: DataFrame, by: str, event: str, p: str, odds: str) -> DataFrame:
    """Pairs of different events within a bounded pool (see top_n): joint chance, odds and expected value."""
    a = pool.select(F.col(by), F.col(event).alias("event_a"), F.col(p).alias("p_a"), F.col(odds).alias("odds_a"), F.col("place").alias("place_a"))
    b = pool.select(F.col(by), F.col(event).alias("event_b"), F.col(p).alias("p_b"), F.col(odds).alias("odds_b"), F.col("place").alias("place_b"))
    both = a.join(b, by).where("place_a < place_b and event_a <> event_b")
    joint, price = F.col("p_a") * F.col("p_b"), F.col("odds_a") * F.col("odds_b")
    return both.select(by, "event_a", "event_b", joint.alias("joint_p"), price.alias("joint_odds"), (joint * price - 1).alias("ev"))


def price_all(legs: DataFrame, quotes: DataFrame, card: str, leg: str) -> DataFrame:
    """Books that price every leg of a card (division), with the product of their odds, and its extremes by card."""
    size = legs.groupBy(card).agg(F.count(F.lit(1)).alias("k"))
    per = legs.join(quotes, leg).groupBy(card, "book").agg(F.count_distinct(leg).alias("n"), F.exp(F.sum(F.log("odds"))).alias("price"))
    whole = per.join(size, card).where("n = k")
    return whole.groupBy(card).agg(F.count(F.lit(1)).alias("books"), F.min("price").alias("low"), F.median("price").alias("mid"), F.max("price").alias("high"))


def power_sums(rows: DataFrame, by: str, residual: Column) -> DataFrame:
    """Sums over all pairs and triples of a group's residuals from power sums: nothing is enumerated."""
    s = [F.sum(F.pow(residual, F.lit(float(k)))) for k in (1, 2, 3)]
    got = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), s[0].alias("s1"), s[1].alias("s2"), s[2].alias("s3"))
    e2 = (F.col("s1") * F.col("s1") - F.col("s2")) / 2
    e3 = (F.pow("s1", F.lit(3.0)) - 3 * F.col("s1") * F.col("s2") + 2 * F.col("s3")) / 6
    return got.select(by, "n", e2.alias("pair_total"), e3.alias("triple_total"))


def dependence(rows: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """P(AB) / (P(A) P(B)) and conditional rates."""
    pa, pb, pab = F.avg(a), F.avg(b), F.avg(F.col(a) * F.col(b))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pa.alias("p_a"), pb.alias("p_b"), pab.alias("p_ab")).select(
        *by, "n", "p_a", "p_b", "p_ab", (F.col("p_ab") / (F.col("p_a") * F.col("p_b"))).alias("ratio"), (F.col("p_ab") / F.col("p_b")).alias("a_given_b")
    )


def effective_size(weights: DataFrame) -> DataFrame:
    """Kish's (sum w)^2 / sum w^2 over clusters."""
    return weights.agg((F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))).alias("n_eff"))


def exposure(bets: DataFrame, event: str, amount: str, places: int = 4) -> DataFrame:
    """Each event's share of all stakes, and the largest; all of those that tie. Amounts have up to `places` decimals and are summed as
    whole numbers, so no order of a sum shows in a tie."""
    per = bets.groupBy(event).agg(F.sum(F.round(F.col(amount) * 10**places)).alias("whole"))
    total = per.agg(F.sum("whole").alias("total"), F.max("whole").alias("most"))
    out = (F.col("whole") / 10**places).alias("amount"), (F.col("whole") / F.col("total")).alias("share"), (F.col("whole") == F.col("most")).alias("largest")
    return per.crossJoin(F.broadcast(total)).select(event, *out)


def number_correct(p: Column) -> Column:
    """Poisson-binomial chances of 0..n right out of an array of chances, by convolution."""
    zero = F.array(F.lit(1.0))
    return F.aggregate(
        p, zero,
        lambda d, q: F.transform(F.sequence(F.lit(0), F.size(d)), lambda k: F.coalesce(F.get(d, k), F.lit(0.0)) * (1 - q) + F.when(k > 0, F.coalesce(F.get(d, k - 1), F.lit(0.0)) * q).otherwise(0.0)),
    )


def disjoint_tuples(legs: DataFrame, by: Sequence[str], key: Column, k: int) -> DataFrame:
    """Hash-ordered legs cut into cards of k; incomplete cards are dropped."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(key))
    carded = legs.withColumn("card", ((n - 1) / k).cast("int"))
    return carded.groupBy(*by, "card").agg(F.count(F.lit(1)).alias("n"), F.exp(F.sum(F.log("p"))).alias("joint_p"), F.exp(F.sum(F.log("odds"))).alias("price"), F.min("y").alias("won")).where(F.col("n") == k).drop("n")
