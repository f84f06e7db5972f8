"""Fits and replays that SQL doesn't state, against plain numpy."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotelark import catalog
from quotelark.operators import models as M
from quotelark.operators.metrics import group_rank, percentiles
from quotelark.sources.driver_tables import Tables

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def bets(spark):
    return Tables(spark, DIR).bets().toPandas()


def design(train, test, columns):
    x, z = train[columns].to_numpy(float), test[columns].to_numpy(float)
    mean, std = x.mean(0), x.std(0, ddof=1)
    one = lambda a: np.c_[(a - mean) / std, np.ones(len(a))]
    return one(x), one(z)


def test_ridge_logistic(spark, bets):
    train, test = bets[bets.season < 1999], bets[bets.season >= 1999]
    x, z = design(train, test, ["p", "odds"])
    y, w, ridge = train.y.to_numpy(float), np.zeros(3), np.diag([0.01, 0.01, 0.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x / len(x) + ridge, x.T @ (q - y) / len(x) + ridge @ w)
    want = dict(zip(test.bet_id, 1 / (1 + np.exp(-z @ w))))
    got = {r.bet_id: r.p_model for r in catalog.QUERIES["m1_logistic_walk_forward"](spark, DIR).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-3


def test_logistic_on_expanding_folds(spark, bets):
    want = {}
    for season in sorted(bets.season.unique())[2:]:
        train, test = bets[bets.season < season], bets[bets.season == season]
        x, z = design(train, test, ["p", "odds"])
        y, w, ridge = train.y.to_numpy(float), np.zeros(3), np.diag([0.01, 0.01, 0.0])
        for _ in range(30):
            q = 1 / (1 + np.exp(-x @ w))
            w = w - np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x / len(x) + ridge, x.T @ (q - y) / len(x) + ridge @ w)
        want |= dict(zip(test.bet_id, 1 / (1 + np.exp(-z @ w))))
    got = {r.bet_id: r.p_model for r in catalog.QUERIES["m1_expanding_folds"](spark, DIR).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-3
    pooled = {r.model: r for r in catalog.QUERIES["m5_models_on_folds"](spark, DIR).collect()}
    y = dict(zip(bets.bet_id, bets.y))
    assert {r.n for r in pooled.values()} == {len(want)} and pooled["fitted"].brier == pytest.approx(np.mean([(p - y[k]) ** 2 for k, p in want.items()]), abs=1e-4)
    sums = [r.p_a + r.p_n + r.p_r for r in catalog.QUERIES["m2_multinomial_folds"](spark, DIR).collect()]
    assert len(sums) == len(want) and max(abs(s - 1) for s in sums) < 1e-5


def test_multinomial(spark, bets):
    train, test = bets[bets.season < 1999], bets[bets.season >= 1999]
    x, z = design(train, test, ["p", "odds"])
    y = np.stack([(train.sport == s).to_numpy(float) for s in "ANR"], 1)
    w, ridge = np.zeros((3, 3)), np.array([[0.01], [0.01], [0.0]])
    for _ in range(3000):
        e = np.exp(x @ w)
        w = w - 0.5 * (x.T @ (e / e.sum(1, keepdims=True) - y) / len(x) + ridge * w)
    e = np.exp(z @ w)
    want = dict(zip(test.bet_id, e / e.sum(1, keepdims=True)))
    got = {r.bet_id: (r.p_a, r.p_n, r.p_r) for r in catalog.QUERIES["m2_multinomial"](spark, DIR).collect()}
    assert got.keys() == want.keys() and max(np.abs(got[k] - want[k]).max() for k in want) < 2e-3


def test_poisson_rates(spark):
    h = Tables(spark, DIR).history().withColumn("early", F.col("day") < F.lit("1999-01-01").cast("date")).toPandas()
    x = lambda d: np.c_[d.goals_against.to_numpy(float) / 10, np.ones(len(d))]
    train, test = h[h.early], h[~h.early]
    y, w = train.goals_for.to_numpy(float), np.array([0.0, math.log(train.goals_for.mean())])
    for _ in range(30):
        m = np.exp(x(train) @ w)
        w = w + np.linalg.solve((x(train) * m[:, None]).T @ x(train), x(train).T @ (y - m))
    want = dict(zip(zip(test.team, test.match_id), np.exp(x(test) @ w)))
    got = {(r.team, r.match_id): r.rate for r in catalog.QUERIES["m3_poisson_rates"](spark, DIR).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 2e-3


def test_rows_without_a_feature_are_scored_null(spark):
    rows = [(k, float(k % 7), float(k % 5), int(k % 3 == 0)) for k in range(60)] + [(99, None, 1.0, 0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    got = {r.id: r.chances for r in M.logistic(df, df, ["a", "b"], "y").collect()}
    assert len(got) == 61 and got[99] is None and got[5] is not None


def test_rating_replays(spark):
    h = Tables(spark, DIR).history().toPandas()
    games = []
    for (league, match), g in h.groupby(["league", "match_id"]):
        if len(g) >= 2:
            top = max(zip(g.goals_for, g.team))[1]
            games.append((league, g.day.min(), match, g.team.min(), g.team.max(), int(top == g.team.min())))
    ratings, want, losses = {}, {}, []
    for league, _, match, a, b, won in sorted(games):
        p = 1 / (1 + 10 ** (-(ratings.get((league, a), 1500) - ratings.get((league, b), 1500)) / 400))
        want[league, match] = p
        losses.append(-math.log(p if won else 1 - p))
        for team, sign in ((a, 1), (b, -1)):
            ratings[league, team] = ratings.get((league, team), 1500) + sign * 20 * (won - p)
    got = {(r.league, r.match_id): r.p for r in catalog.QUERIES["m7_rating_replay"](spark, DIR).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-5
    steps = {r.k: r for r in catalog.QUERIES["m8_rating_step_calibration"](spark, DIR).collect()}
    assert steps[20.0].log_loss == pytest.approx(np.mean(losses), abs=1e-5)
    assert [k for k, r in steps.items() if r.best] == [min(steps, key=lambda k: steps[k].log_loss)]


def test_percentiles_and_ranks(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.normal(size=500).round(2)] + [("b", 3.0)] * 40 + [("c", 1.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: r.q for r in percentiles(df, ["g"], "v", [0.0, 0.1, 0.5, 1.0]).collect()}
    for g in "abc":
        assert got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None], [0.0, 0.1, 0.5, 1.0]))
    far = spark.createDataFrame([("a", float(k)) for k in range(3000)] + [("a", 1e15)], "g string, v double").repartition(4)
    assert percentiles(far, ["g"], "v", [0.5, 1.0]).first().q == [1500.0, 1e15]
    ranked = group_rank(df.where("v is not null"), ["g"], [F.col("v")]).orderBy("g", "rank").collect()
    assert [r.rank for r in ranked] == [*range(500), *range(40), 0] and all(a.v <= b.v for a, b in zip(ranked, ranked[1:]) if a.g == b.g)


def test_stream_keeps_late_keys(spark, tmp_path):
    from quotelark.sinks.ledger import read
    from quotelark.streaming import ledgers as S

    schema = "k int, ts timestamp"
    for k, rows in enumerate([[(1, "2024-03-01 00:00:00")], [(2, "2024-03-09 00:00:00"), (1, "2024-03-09 01:00:00")], [(3, "2023-01-01 00:00:00")]]):
        spark.createDataFrame(rows, "k int, t string").select("k", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    S.append_to_ledger(S.read_files(spark, f"{tmp_path}/in", schema, 1), f"{tmp_path}/out", ["k"], ["ts"], f"{tmp_path}/state").awaitTermination()
    assert sorted((r.k, str(r.ts)[:10]) for r in read(spark, f"{tmp_path}/out", schema).collect()) == [(1, "2024-03-01"), (2, "2024-03-09"), (3, "2023-01-01")]


def test_derived_aliases(spark):
    from quotelark.operators.board import derive_aliases

    fixtures = [("c", 1, "x"), ("c", 2, "x"), ("c", 1, "y"), ("c", 3, "y"), ("c", 3, "z"), ("d", 1, "p"), ("d", 1, "q"), ("e", 1, "r"), ("e", 1, "s"), ("e", 2, "u")]
    odds = [("c", 1, "X"), ("c", 1, "Y"), ("c", 2, "X"), ("c", 3, "Y"), ("c", 3, "Z"), ("d", 1, "P"), ("d", 1, "Q"), ("e", 1, "R")]
    a, b = spark.createDataFrame(fixtures, "comp string, slot int, team string"), spark.createDataFrame(odds, "comp string, slot int, name string")
    got = {r.team: (r.name, r.status) for r in derive_aliases(a, b, "comp", "slot", "team", "name").collect()}
    assert got == {"x": ("X", "MATCHED"), "y": ("Y", "MATCHED"), "z": ("Z", "MATCHED"), "p": (None, "AMBIGUOUS"), "q": (None, "AMBIGUOUS"), "r": (None, "CONFLICT"), "s": (None, "CONFLICT"), "u": (None, "CONFLICT")}


def test_derived_aliases_are_true(spark):
    got = catalog.QUERIES["j10_derived_aliases"](spark, DIR).collect()
    assert len(got) > 100 and all(r.name == f"T{r.team * 7 % 25}" for r in got if r.status == "MATCHED") and {r.status for r in got} <= {"MATCHED", "AMBIGUOUS"}
