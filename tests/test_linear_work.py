"""Closed forms and counted fits, against the plain work."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotelark.functions.odds import poisson_pmf
from quotelark.operators import models as M
from quotelark.operators import studies as S
from quotelark.plans.rates import over_lines


def test_totals_of_two_poisson_counts(spark):
    rates = spark.createDataFrame([(0.2, 0.2), (0.001, 0.0), (3.0, 14.0), (0.0, 0.0), (900.0, 1.0)], "h double, a double")
    slow = S.over(S.convolved(poisson_pmf(F.col("h"), 8), poisson_pmf(F.col("a"), 8)), 2.5)
    for r in rates.where("h < 800").select(slow.alias("x"), S.poisson_over(F.col("h"), F.col("a"), 8, 2.5).alias("y")).collect():
        assert r.x == pytest.approx(r.y, abs=1e-12)


def test_chances_over_lines(spark):
    rates = [0.5, 20.0, 44.5, 900.0]
    got = spark.createDataFrame([(r,) for r in rates], "r double").select(over_lines((2, 40))(F.col("r")).alias("p"), "r").collect()
    for row in got:
        for k in (2, 40):
            assert row.p[f"p{k}"] == pytest.approx(1 - sum(math.exp(-row.r + j * math.log(row.r) - math.lgamma(j + 1)) for j in range(k + 1)), abs=1e-12)


def test_counted_fit_reads_each_different_row_once(spark, monkeypatch):
    """A hundred equal rows are one row of the fit, a missing feature gives null, and chances are those of the plain fit."""
    sizes, plain = [], M.LogisticRegression.fit
    monkeypatch.setattr(M.LogisticRegression, "fit", lambda self, rows: sizes.append(rows.count()) or plain(self, rows))
    train = spark.range(4_000).select((F.col("id") % 5 / 5).alias("u"), (F.col("id") % 2).alias("v"), ((F.col("id") * 7 % 11) % 3).cast("int").alias("y"))
    test = spark.createDataFrame([(0.2, 1), (0.8, 0), (None, 1)], "u double, v long")
    got = M.logistic(train, test, ["u", "v"], "y", family="multinomial").collect()
    assert sizes == [30] and [r.chances is None for r in got] == [False, False, True]
    assert all(np.isclose(sum(r.chances), 1) for r in got[:2])
