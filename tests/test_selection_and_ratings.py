"""Greedy picks, overlapping cards, pools, replays and likelihoods against plain Python."""

import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotelark import catalog
from quotelark.operators import combos as C
from quotelark.operators import ratings as R
from quotelark.operators import selection as X

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_parallel_picks_equal_the_sequential_greedy(spark):
    rng = random.Random(1)
    rows = [(d, k, round(rng.random(), 2), [f"p{x}" for x in rng.sample(range(12 + 30 * d), 2)]) for d in range(4) for k in range(60)]
    rows += [(9, k, 1.0, [f"c{k}", f"c{k + 1}"]) for k in range(10)]  # a chain: each in conflict with the next
    df = spark.createDataFrame(rows, "day int, id int, v double, who array<string>").repartition(3)
    got = {(r.day, r.id): (r.place, r.left) for r in X.distinct_top(df, ["day"], F.struct((-F.col("v")).alias("v"), F.col("id").alias("i")), "id", F.col("who"), 4).collect()}
    want = {}
    for d in {r[0] for r in rows}:
        used, chosen = set(), []
        for _, k, _, who in sorted((r for r in rows if r[0] == d), key=lambda r: (-r[2], r[1])):
            if not used & set(who):
                used |= set(who)
                chosen.append(k)
        want |= {(d, k): (n + 1, max(0, len(chosen) - 4)) for n, k in enumerate(chosen[:4])}
    assert got == want


def effective(cards):
    """Kish's size from all pairs: {card: ({event: (side, p)}, weight)}."""
    total = sum(w for _, w in cards) ** 2
    below = 0.0
    for i, (a, wa) in enumerate(cards):
        for j, (b, wb) in enumerate(cards):
            pa, pb = math.prod(p for _, p in a.values()), math.prod(p for _, p in b.values())
            both = 0.0 if any(e in a and a[e][0] != s for e, (s, _) in b.items()) else pa * math.prod(p for e, (_, p) in b.items() if e not in a)
            below += wa * wb * (1.0 if i == j else (both - pa * pb) / math.sqrt(pa * (1 - pa) * pb * (1 - pb)))
    return total / below


def size_of(spark, cards):
    rows = [(k, e, s, p, w) for k, (legs, w) in enumerate(cards) for e, (s, p) in legs.items()]
    return X.overlap_size(spark.createDataFrame(rows, "card int, event string, side string, p double, w double"), "card", "event", "side", "p", "w").first().n_eff


def test_overlapping_cards_without_pairs(spark):
    same = [({"e1": ("x", 0.6)}, 1.0)] * 5
    apart = [({f"e{k}": ("x", 0.6)}, 1.0) for k in range(5)]
    shared = [({"e1": ("x", 0.6), "e2": ("y", 0.7)}, 1.0), ({"e2": ("y", 0.7), "e3": ("z", 0.8)}, 1.0)]
    against = [({"e1": ("x", 0.6), "e2": ("y", 0.7)}, 1.0), ({"e1": ("o", 0.4)}, 1.0)]
    assert size_of(spark, same) == pytest.approx(1.0) and size_of(spark, apart) == pytest.approx(5.0)
    for cards in (shared, against):
        assert size_of(spark, cards) == pytest.approx(effective(cards))
    assert size_of(spark, against) > 2  # opposite sides say more than two apart
    p = {(e, s): round(random.Random(f"{e}{s}").uniform(0.1, 0.9), 3) for e in range(9) for s in "abc"}
    rng = random.Random(3)
    many = [({f"e{e}": (s, p[e, s]) for e, s in ((e, rng.choice("abc")) for e in rng.sample(range(9), rng.randint(1, 5)))}, rng.choice([0.5, 1.0, 2.0])) for _ in range(60)]
    assert size_of(spark, many) == pytest.approx(effective(many))


def test_sets_of_one_card_are_not_made(spark, monkeypatch):
    cards = [({f"e{5 * k + j}": ("x", 0.6) for j in range(5)}, 1.0) for k in range(50)] + [({"e0": ("x", 0.6), "e1": ("x", 0.6), "e2": ("y", 0.3)}, 1.0)]
    made, cut = [], X.cut
    monkeypatch.setattr(X, "cut", lambda df: made.append(cut(df)) or made[-1])
    assert size_of(spark, cards) == pytest.approx(effective(cards))
    sums = next(df for df in made if "sides" in df.columns)
    assert sums.where(F.size("events") > 1).count() == 7  # three pairs and a triple, with two choices of sides where e2 is in


def test_card_chances_round_half_up_whatever_the_order(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{DIR}/lineitem.parquet'")
    sql = catalog.ORACLE_SQL["a31_overlapping_cards"]
    whole = sql.replace("round(avg(p), 4) as p from bets", "((2 * sum(round(p * 10000)::bigint) + count(*)) // (2 * count(*))) / 10000 as p from bets")
    assert whole != sql  # means in whole numbers: a sum of doubles puts those that lie half-way on either side
    assert tuple(catalog.QUERIES["a31_overlapping_cards"](spark, DIR).first()) == pytest.approx(con.execute(whole).fetchone(), abs=1e-4)


def test_equal_exposures_tie_whatever_the_order(spark):
    rows = [(e, a) for e, amounts in ((1, (0.1, 0.2, 0.3)), (2, (0.3, 0.2, 0.1)), (3, (0.2, 0.3))) for a in amounts]
    got = C.exposure(spark.createDataFrame(rows, "event int, odds double").coalesce(1), "event", "odds").orderBy("event").collect()
    assert [tuple(r) for r in got] == [(1, 0.6, 6 / 17, True), (2, 0.6, 6 / 17, True), (3, 0.5, 5 / 17, False)]


def test_pools_are_connected_components(spark):
    rng = random.Random(5)
    games = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)]
    root = {x: x for g in games for x in g}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in games:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.player: r.pool for r in R.pools(spark.createDataFrame(games, "home int, away int")).collect()}
    assert got == {x: find(x) for x in root}


def test_replay_reverts_between_seasons_and_scales_by_margin(spark):
    rng = random.Random(7)
    days = spark.sql("select explode(sequence(date'2020-01-01', date'2023-12-31', interval 9 days)) as day").toPandas().day.tolist()
    rows = [(p, 1000 * p + k, d, d.year, 10 * p + a, 10 * p + b, float(rng.randint(-4, 4))) for p in (0, 1) for k, d in enumerate(days) if d.year != 2021 + p for a, b in [rng.sample(range(6), 2)]]
    df = spark.createDataFrame(rows, "pool int, match_id int, day date, season int, home int, away int, margin double")
    for rules in (R.Ratings(steps=(10.0, 30.0), home=50.0), R.Ratings(steps=(20.0,), home=75.0, mean=1505.0, own_seasons=True, by_margin=True)):
        got = {(r.match_id, r.step): (r.rating_home, r.rating_away, r.p) for r in R.replay(df, rules).collect()}
        assert len(got) == len(rows) * len(rules.steps)
        for step in rules.steps:
            ratings, last = {}, {}
            for _, match, _, season, home, away, margin in sorted(rows, key=lambda r: (r[0], r[2])):
                for x in (home, away):
                    for _ in range(min(1, season - last.get(x, season)) if rules.own_seasons else season - last.get(x, season)):
                        ratings[x] = 0.75 * ratings[x] + 0.25 * rules.mean
                    last[x] = season
                a, b = ratings.get(home, 1500.0), ratings.get(away, 1500.0)
                edge = a + rules.home - b
                p = 1 / (1 + 10 ** (-edge / 400))
                assert got[match, step] == pytest.approx((a, b, p))
                k = step * ((abs(margin) + 3) ** 0.8 / (7.5 + 0.006 * (edge if margin > 0 else -edge)) if rules.by_margin else 1)
                move = k * ((margin > 0) + 0.5 * (margin == 0) - p)
                ratings[home], ratings[away] = a + move, b - move


def test_three_way_chances(spark):
    h, d, a = spark.range(1).select(*R.three_way(F.lit(100.0), 100.0)).first()
    assert h == pytest.approx(0.5) and h + d + a == pytest.approx(1) and spark.range(1).select(*R.three_way(F.lit(0.0), 0.0)).first()[1] == 0


def test_dispersion_of_greatest_likelihood(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for g, alpha in (("a", 0.4), ("b", 0.05), ("p", 0.0)):
        mu = rng.choice([2.0, 5.0, 9.0], 3000)
        y = rng.poisson(mu * rng.gamma(1 / alpha, alpha, 3000)) if alpha else np.full(3000, 4)
        rows += [(g, float(m), int(v)) for m, v in zip(mu, y)]

        def loss(la, y=y, mu=mu):
            r = math.exp(-la)
            pairs, n = np.unique(np.stack([y, mu]), axis=1, return_counts=True)
            return -sum(c * (math.lgamma(v + r) - math.lgamma(r) + r * math.log(r / (r + m)) + v * math.log(m / (r + m))) for v, m, c in zip(*pairs, n))

        low, high, ratio = math.log(1e-4), math.log(3), (math.sqrt(5) - 1) / 2
        for _ in range(60):
            x, z = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, z) if loss(x) < loss(z) else (x, high)
        want[g] = math.exp((low + high) / 2)
    got = {r.g: r.alpha for r in R.negative_binomial(spark.createDataFrame(rows, "g string, rate double, y int"), "y", "g").collect()}
    assert got == pytest.approx(want, rel=2e-4)


def test_refined_rates_are_never_worse(spark):
    got = catalog.QUERIES["m6_refined_goal_rates"](spark, DIR).collect()
    assert got and all(r.error <= r.coarse_error + 1e-9 for r in got) and sum(r.error < r.coarse_error for r in got) > len(got) / 2


def test_log_growth_over_all_outcomes(spark):
    legs = [(0.6, 1.8), (0.5, 2.2), (0.7, 1.5), (0.4, 2.9), (0.55, 2.0)]
    row = spark.createDataFrame([([{"p": p, "odds": o} for p, o in legs],)], "x array<struct<p: double, odds: double>>")
    for k in (1, 2, 3, None):
        lines, want = list(itertools.combinations(range(5), k or 5)), 0.0
        for won in itertools.product((0, 1), repeat=5):
            q = math.prod(p if w else 1 - p for (p, _), w in zip(legs, won))
            made = sum(math.prod(legs[i][1] for i in line) - 1 if all(won[i] for i in line) else -1 for line in lines) / len(lines)
            want += q * math.log(1 + 0.02 * made)
        assert row.select(X.growth(F.col("x"), 0.02, k)).first()[0] == pytest.approx(want)
