"""Rating replays over pools of connected players, all step sizes in one pass, and what is scored from one replay.

A rating depends on every earlier one that reaches it through common opponents, so players who are connected by matches must be
replayed in order and together, and nobody else need be: pools are the connected components of the match table. One pool is one
ordered scan in one task (its matches stream through; state is a number for each player and step size); pools run side by side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelark.scratch import cut


@dataclass(frozen=True)
class Ratings:
    """How ratings move. revert: the share of its distance to `mean` that a rating loses between seasons.

    own_seasons: a player reverts once when its next match is in another season; else with every season that anybody begins.
    by_margin: steps grow with the margin and shrink with the winner's edge, ((|margin| + 3) ** 0.8) / (7.5 + 0.006 * edge).
    """

    steps: tuple[float, ...] = (20.0,)
    start: float = 1500.0
    mean: float = 1500.0
    home: float = 0.0
    revert: float = 0.25
    own_seasons: bool = False
    by_margin: bool = False


def pools(matches: DataFrame, a: str = "home", b: str = "away") -> DataFrame:
    """(player, pool): the least player that matches lead to. Labels spread to neighbours and along labels, so a chain of n players
    takes about log n rounds; each round is two joins of the players with their pairs."""
    one = matches.select(F.col(a).alias("x"), F.col(b).alias("y"))
    pairs = cut(one.union(one.select("y", "x")).distinct())
    labels = cut(pairs.groupBy(F.col("x").alias("player")).agg(F.least(F.min("x"), F.min("y")).alias("pool")))
    while True:
        near = pairs.join(labels, pairs["y"] == labels["player"]).groupBy("x").agg(F.min("pool").alias("near"))
        least = labels.join(near, labels["player"] == near["x"]).select("player", "pool", F.least("pool", "near").alias("next"))
        top = labels.select(F.col("player").alias("via"), F.col("pool").alias("top"))
        moved = cut(least.join(top, least["next"] == top["via"], "left").select("player", F.col("pool").alias("old"), F.least("next", F.coalesce("top", "next")).alias("pool")))
        labels = moved.select("player", "pool")
        if moved.where("old <> pool").isEmpty():
            return labels


def replay(matches: DataFrame, rules: Ratings) -> DataFrame:
    """matches (pool, match_id, day, season, home, away, margin) with each side's rating before the match, for each step size.

    Returns (pool, match_id, season, result, step, rating_home, rating_away, p), p being the expected score of the home side.
    """
    numbered = [r[0] for r in matches.select("season").distinct().orderBy("season").collect()]  # a row a season
    number = F.element_at(F.map_from_arrays(F.array(*map(F.lit, numbered)), F.array(*map(F.lit, range(len(numbered))))), F.col("season")) if numbered else F.lit(0)
    steps, keep, first = list(map(float, rules.steps)), 1 - rules.revert, [rules.start] * len(rules.steps)  # plain numbers: arrays of a few cost more than they save

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool, ratings, last = None, {}, {}
        for frame in frames:
            before = []
            for of, home, away, season, margin in zip(*(frame[c].tolist() for c in ("pool", "home", "away", "number", "margin"))):
                if of != pool:
                    pool, ratings, last = of, {}, {}
                for player in (home, away):
                    passed = season - last.get(player, season)
                    if passed:
                        kept = keep ** (1 if rules.own_seasons else passed)
                        ratings[player] = [rules.mean + (r - rules.mean) * kept for r in ratings[player]]
                    last[player] = season
                x, y = ratings.get(home, first), ratings.get(away, first)
                edge = [a + rules.home - b for a, b in zip(x, y)]
                p = [1 / (1 + 10 ** min(-e / 400, 300.0)) for e in edge]
                before.append((x, y, p))
                won, moves = 1.0 if margin > 0 else 0.0 if margin < 0 else 0.5, steps
                if rules.by_margin:
                    wide, sign = (abs(margin) + 3) ** 0.8, 1 if margin > 0 else -1
                    moves = [s * (wide / d if (d := 7.5 + 0.006 * sign * e) else math.inf) for s, e in zip(steps, edge)]
                move = [s * (won - q) for s, q in zip(moves, p)]
                ratings[home], ratings[away] = [a + m for a, m in zip(x, move)], [b - m for b, m in zip(y, move)]
            yield frame[["pool", "match_id", "season"]].assign(result=np.sign(frame["margin"]).astype("int32"), x=[b[0] for b in before], y=[b[1] for b in before], p=[b[2] for b in before])

    ordered = matches.withColumn("number", number).select("pool", "match_id", "day", "season", "home", "away", "margin", "number").repartition("pool").sortWithinPartitions("pool", "day", "match_id")
    kinds = {f.name: f.dataType.simpleString() for f in matches.schema}
    got = ordered.mapInPandas(run, f"pool {kinds['pool']}, match_id {kinds['match_id']}, season {kinds['season']}, result int, x array<double>, y array<double>, p array<double>")
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, map(float, rules.steps))).alias("step"), F.col("x"), F.col("y"), F.col("p"))).alias("r")
    return got.select("pool", "match_id", "season", "result", each).select("pool", "match_id", "season", "result", "r.step", F.col("r.x").alias("rating_home"), F.col("r.y").alias("rating_away"), F.col("r.p").alias("p"))


def three_way(edge: Column, margin: float) -> tuple[Column, Column, Column]:
    """Chances of home, draw and away: the draw is what lies between the edge less the margin and the edge with it."""
    below = lambda x: 1 / (1 + F.pow(F.lit(10.0), -x / 400))
    home, not_away = below(edge - margin), below(edge + margin)
    return home, not_away - home, 1 - not_away


def draw_margins(replayed: DataFrame, margins: Sequence[float], home: float = 0.0) -> DataFrame:
    """(step, margin, log_loss, n, best): every margin is scored from the one replay, as margins don't move ratings; matches are read once."""
    edge = F.col("rating_home") + home - F.col("rating_away")

    def loss(margin: float) -> Column:
        h, d, a = three_way(edge, margin)
        return F.avg(-F.log(F.greatest(F.lit(1e-15), F.when(F.col("result") > 0, h).when(F.col("result") < 0, a).otherwise(d))))

    wide = replayed.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.struct(F.lit(float(m)).alias("margin"), loss(m).alias("log_loss")) for m in margins)).alias("tried"))
    least = F.array_min(F.transform("tried", lambda t: F.struct(t["log_loss"].alias("l"), t["margin"].alias("m"))))
    return wide.withColumn("least", least).select("step", "n", F.explode("tried").alias("t"), "least").select("step", "t.margin", "t.log_loss", "n", (F.col("t.margin") == F.col("least.m")).alias("best"))


def negative_binomial(rates: DataFrame, label: str, by: str, low: float = 1e-4, high: float = 3.0, points: int = 16, rounds: int = 7) -> DataFrame:
    """(by, alpha): the dispersion of greatest likelihood within [low, high], by a grid over log alpha that closes in on its best point.

    With r = 1 / alpha, the terms of log gamma for whole counts are sums of log(r + j) over j below the count, so a group needs how many of its
    counts lie above each j, and its rows and counts by rate: two short tables, whatever the number of rows. A round reads these once.
    """
    counts = rates.groupBy(by, F.col(label).cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    above = counts.where("y > 0").select(by, "n", F.explode(F.sequence(F.lit(0), F.col("y") - 1)).alias("j")).groupBy(by, F.col("j").cast("double").alias("v")).agg(F.sum("n").cast("double").alias("a"), F.lit(0.0).alias("b"), F.lit(True).alias("over"))
    sums = rates.groupBy(by, F.col("rate").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("a"), F.sum(label).cast("double").alias("b"), F.lit(False).alias("over"))
    terms = cut(above.unionByName(sums))
    bracket = terms.select(by).distinct().select(by, F.lit(math.log(low)).alias("low"), F.lit(math.log(high)).alias("high"))
    for _ in range(rounds):
        at = bracket.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("r", F.exp(-(F.col("low") + (F.col("high") - F.col("low")) * F.col("k") / (points - 1))))
        r, v = F.col("r"), F.col("v")
        term = F.when(F.col("over"), F.col("a") * F.log(r + v)).otherwise(F.col("a") * r * F.log(r) - (F.col("a") * r + F.col("b")) * F.log(r + v))
        scored = terms.join(at, by).groupBy(by, "low", "high", "k").agg(F.sum(term).alias("l"))
        best = scored.groupBy(by, "low", "high").agg(F.max(F.struct("l", (-F.col("k")).alias("k")))["k"].alias("k")).withColumn("k", -F.col("k"))
        point = lambda k: F.col("low") + (F.col("high") - F.col("low")) * k / (points - 1)
        bracket = best.select(by, point(F.greatest(F.col("k") - 1, F.lit(0))).alias("low"), point(F.least(F.col("k") + 1, F.lit(points - 1))).alias("high"))
    return bracket.select(by, F.exp((F.col("low") + F.col("high")) / 2).alias("alpha"))
