"""Fitting jobs: recalibration, blends, regressions and rating replays."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelark.functions.odds import logit, sigmoid
from quotelark.scratch import cut


def calibration_slope(rows: DataFrame, by: str, steps: int = 12) -> DataFrame:
    """(by, intercept, slope) of y on logit(p) by Newton steps from (0, 1), all groups at once.

    Rows are counted by distinct p first; every step is one aggregate of five sums over those counts.
    """
    values = cut(rows.groupBy(by, "p").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).withColumn("x", logit(F.col("p"))))
    fitted = values.select(by).distinct().select(by, F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))
    for _ in range(steps):
        q = sigmoid(F.col("a") + F.col("b") * F.col("x"))
        w, r = F.col("n") * q * (1 - q), F.col("n") * q - F.col("pos")
        s = values.join(fitted, by).groupBy(by, "a", "b").agg(F.sum(w).alias("h0"), F.sum(w * F.col("x")).alias("h1"), F.sum(w * F.col("x") * F.col("x")).alias("h2"), F.sum(r).alias("g0"), F.sum(r * F.col("x")).alias("g1"))
        det = F.col("h0") * F.col("h2") - F.col("h1") * F.col("h1")
        a = F.col("a") - (F.col("h2") * F.col("g0") - F.col("h1") * F.col("g1")) / det
        b = F.col("b") - (F.col("h0") * F.col("g1") - F.col("h1") * F.col("g0")) / det
        fitted = s.select(by, a.alias("a"), b.alias("b"))
    return fitted.select(by, F.col("a").alias("intercept"), F.col("b").alias("slope"))


def blend_grid(rows: DataFrame, first: str, second: str, steps: int) -> DataFrame:
    """Log loss of w x first + (1 - w) x second for each w of a grid; rows are counted by distinct values before they meet the grid."""
    values = rows.groupBy(first, second, "y").agg(F.count(F.lit(1)).alias("n"))
    at = values.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("w", F.col("step") / steps)
    p = F.col("w") * F.col(first) + (1 - F.col("w")) * F.col(second)
    loss = -F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p))
    return at.groupBy("w").agg((F.sum(F.col("n") * loss) / F.sum("n")).alias("log_loss"))


def _features(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with all features; those without are scored null by scored_all()."""
    whole = rows.where(" and ".join(f"`{c}` is not null" for c in columns))
    return VectorAssembler(inputCols=list(columns), outputCol="raw").transform(whole)


def scored_all(scored: DataFrame, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The scored rows, and the rows that lack a feature with a null score: none is dropped."""
    return scored.unionByName(rows.where(" or ".join(f"`{c}` is null" for c in columns)), allowMissingColumns=True)


def logistic(train: DataFrame, test: DataFrame, columns: Sequence[str], label: str, ridge: float = 0.01, family: str = "binomial") -> DataFrame:
    """test with `chances`: ridge logistic (or multinomial) regression, standardised on the training rows only.

    Training rows are counted by their features and label first and fitted with these weights: the same sums, over different rows only.
    Test rows are scored where they lie; those that lack a feature get null.
    """
    whole = " and ".join(f"`{c}` is not null" for c in columns)
    counted = cut(train.where(whole).groupBy(*columns, label).agg(F.count(F.lit(1)).cast("double").alias("_n")))
    x = lambda c: F.col(f"`{c}`").cast("double")
    mean = counted.agg(*[F.sum(F.col("_n") * x(c)) / F.sum("_n") for c in columns], F.sum("_n")).first()
    n = mean[-1] or 0
    spread = counted.agg(*[F.sqrt(F.sum(F.col("_n") * F.pow(x(c) - F.lit(m), 2)) / max(n - 1, 1)) for c, m in zip(columns, mean)]).first()
    scaled = lambda k: (x(columns[k]) - F.lit(mean[k])) * F.lit(1 / spread[k] if spread[k] else 0.0)
    ready = VectorAssembler(inputCols=[f"_x{k}" for k in range(len(columns))], outputCol="features").transform(counted.select(label, "_n", *[scaled(k).alias(f"_x{k}") for k in range(len(columns))]))
    model = LogisticRegression(labelCol=label, weightCol="_n", regParam=ridge, elasticNetParam=0.0, family=family, standardization=False).fit(ready)
    rows, base = model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist()
    lines = [reduce(Column.__add__, (F.lit(w) * scaled(k) for k, w in enumerate(row)), F.lit(b)) for row, b in zip(rows, base)]
    if len(lines) == 1:
        lines = [F.lit(0.0), *lines]
    top = F.greatest(*lines)
    parts = F.array(*[F.exp(line - top) for line in lines])
    chances = F.transform(parts, lambda p: p / F.aggregate(parts, F.lit(0.0), lambda a, q: a + q))
    return test.withColumn("chances", F.when(F.expr(whole), chances))


def poisson_rates(train: DataFrame, test: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """test with `rate`, by a Poisson regression with log link."""
    model = GeneralizedLinearRegression(family="poisson", link="log", labelCol=label, featuresCol="raw", predictionCol="rate").fit(_features(train, columns))
    return scored_all(model.transform(_features(test, columns)).drop("raw"), test, columns)


def dispersion(rates: DataFrame, label: str, by: str) -> DataFrame:
    """(by, alpha): the negative binomial dispersion by moments, sum((y - m)^2 - m) / sum(m^2), at least 0."""
    m, y = F.col("rate"), F.col(label)
    return rates.groupBy(by).agg(F.greatest(F.lit(0.0), F.sum((y - m) * (y - m) - m) / F.sum(m * m)).alias("alpha"))


def walk_forward(rows: DataFrame, season: str) -> DataFrame:
    """rows of each evaluated season with `model_p`: the two-parameter recalibration of p fitted on all earlier seasons.

    All folds are fitted at once: training rows are counted by season and p, and a fold adds the counts of its seasons.
    """
    seasons = [r[0] for r in rows.select(season).distinct().orderBy(season).collect()]  # a row a season
    folds = rows.sparkSession.createDataFrame([(a, b) for b in seasons for a in seasons if a < b], f"`{season}` int, fold int")
    fitted = calibration_slope(rows.join(F.broadcast(folds), season), "fold")
    x = F.col("intercept") + F.col("slope") * logit(F.col("p"))
    return rows.join(F.broadcast(fitted), F.col(season) == F.col("fold")).withColumn("model_p", sigmoid(x)).drop("fold", "intercept", "slope")


def expanding_folds(rows: DataFrame, season: str, fit, least: int = 1) -> DataFrame:
    """Rows of every season that has at least `least` earlier ones, as fit(train, test) returns them, pooled: train is all earlier seasons."""
    seasons = [r[0] for r in rows.select(season).distinct().orderBy(season).collect()]  # a row a season
    rows = cut(rows)
    folds = [fit(rows.where(F.col(season) < s), rows.where(F.col(season) == s)) for s in seasons[least:]]
    return reduce(DataFrame.unionByName, folds) if folds else fit(rows, rows.where(F.lit(False)))


def implied_rates(markets: DataFrame, keys: Sequence[str], steps: int, step: float, line: float = 2.5, most: int = 10) -> DataFrame:
    """(keys, lambda_home, lambda_away, error): the grid's rates whose Poisson chances are nearest to p_home, p_away and p_over.

    The grid is a constant of the plan, so each market looks through it where it lies; no row is repeated.
    """
    pmf = lambda m: [math.exp(-m) * m**k / math.factorial(k) for k in range(most + 1)]
    cells = []
    for i in range(1, steps + 1):
        for j in range(1, steps + 1):
            a, b = pmf(i * step), pmf(j * step)
            joint = [(x, y, a[x] * b[y]) for x in range(most + 1) for y in range(most + 1)]
            cells.append((i * step, j * step, sum(p for x, y, p in joint if x > y), sum(p for x, y, p in joint if x < y), sum(p for x, y, p in joint if x + y > line)))
    names = ("home", "away", "p_h", "p_a", "p_o")
    grid = F.from_json(F.lit(json.dumps([dict(zip(names, c)) for c in cells])), "array<struct<home:double,away:double,p_h:double,p_a:double,p_o:double>>")
    square = lambda x: x * x
    error = lambda g: square(g["p_h"] - F.col("p_home")) + square(g["p_a"] - F.col("p_away")) + square(g["p_o"] - F.col("p_over"))
    best = F.array_min(F.transform(grid, lambda g: F.struct(error(g).alias("e"), g["home"].alias("h"), g["away"].alias("a"))))
    return markets.withColumn("best", best).select(*keys, F.col("best.h").alias("lambda_home"), F.col("best.a").alias("lambda_away"), F.col("best.e").alias("error"))


def refined_rates(markets: DataFrame, keys: Sequence[str], steps: int, step: float, finer: int, line: float = 2.5, most: int = 10) -> DataFrame:
    """implied_rates(), then a second grid, `finer` times as fine, over the cells about each market's best one; never worse than the first.

    Single goal counts' chances for each fine rate, and their sums, are constants of the plan; a row looks through its own neighbourhood,
    where three short dot products give a cell's chances.
    """
    n = (steps + 1) * finer
    fine = [[math.exp(-m) * m**k / math.factorial(k) for k in range(most + 1)] for m in (i * step / finer for i in range(1, n + 1))]
    sums = [[sum(row[: k + 1]) for k in range(most + 1)] for row in fine]
    doubles = lambda rows: F.from_json(F.lit(json.dumps(rows)), "array<array<double>>")
    pmf, cdf = doubles(fine), doubles(sums)
    below = int(line)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    first = implied_rates(markets, keys, steps, step, line, most).withColumnRenamed("error", "coarse_error")
    rows = markets.join(first, list(keys)).withColumn("i0", F.round(F.col("lambda_home") / step * finer).cast("int")).withColumn("j0", F.round(F.col("lambda_away") / step * finer).cast("int"))
    near = lambda c: F.sequence(F.greatest(F.col(c) - finer, F.lit(1)), F.least(F.col(c) + finer, F.lit(n)))
    strictly = lambda c: F.concat(F.array(F.lit(0.0)), F.slice(c, 1, most))  # noqa: E731  chances of fewer goals

    def cell(i, j):
        a, b, ca, cb = F.get(pmf, i - 1), F.get(pmf, j - 1), F.get(cdf, i - 1), F.get(cdf, j - 1)
        under = dot(F.slice(a, 1, below + 1), F.reverse(F.slice(cb, 1, below + 1)))
        square = lambda x: x * x
        error = square(dot(a, strictly(cb)) - F.col("p_home")) + square(dot(b, strictly(ca)) - F.col("p_away")) + square(F.get(ca, F.lit(most)) * F.get(cb, F.lit(most)) - under - F.col("p_over"))
        return F.struct(error.alias("e"), i.alias("i"), j.alias("j"))

    cells = F.flatten(F.transform(near("i0"), lambda i: F.transform(near("j0"), lambda j: cell(i, j))))
    return rows.withColumn("best", F.array_min(cells)).select(*keys, (F.col("best.i") * step / finer).alias("lambda_home"), (F.col("best.j") * step / finer).alias("lambda_away"), F.col("best.e").alias("error"), "coarse_error")


def replay_ratings(matches: DataFrame, pool: str, k: float = 20.0, start: float = 1500.0, home: float = 0.0) -> DataFrame:
    """Ratings of a and b before each match, replayed in order within each independent pool.

    A rating depends on all earlier ones of its pool, so a pool is one ordered scan; pools and configurations run side by side.
    """
    schema = f"{pool} long, match_id long, a long, b long, a_won int, rating_a double, rating_b double, p double"

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ratings: dict[tuple, float] = {}
        for frame in frames:
            before_a, before_b, chance = [], [], []
            for g, a, b, won in zip(frame[pool], frame["a"], frame["b"], frame["a_won"]):
                ra, rb = ratings.get((g, a), start), ratings.get((g, b), start)
                p = 1 / (1 + 10 ** (-(ra - rb + home) / 400))
                before_a.append(ra)
                before_b.append(rb)
                chance.append(p)
                ratings[g, a], ratings[g, b] = ra + k * (won - p), rb - k * (won - p)
            yield frame[[pool, "match_id", "a", "b", "a_won"]].assign(rating_a=before_a, rating_b=before_b, p=chance)

    ordered = matches.repartition(pool).sortWithinPartitions(pool, "day", "match_id")
    return ordered.mapInPandas(replay, schema)
