"""Alias derivation against plain Python, conflicts that are errors, and window checks."""

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quotelark import catalog
from quotelark.operators import aliases as A
from quotelark.operators import gates as G

SCHEMA = "comp string, at timestamp, home string, away string"
T0 = dt.datetime(2024, 8, 1, 12)


def plain(fixtures, odds):
    """The same rules, one competition at a time, over sets."""
    out = {}
    for comp in {f[0] for f in fixtures}:
        ours, theirs = sorted({f for f in fixtures if f[0] == comp}), sorted({e for e in odds if e[0] == comp})
        near = {f: [e for e in theirs if abs(e[1] - f[1]) <= dt.timedelta(minutes=10)] for f in ours}
        near = {f: es for f, es in near.items() if es}
        names = {n for f in near for n in f[2:]}
        cand, method = {n: {x for e in theirs for x in e[2:]} for n in names}, {}
        word = lambda s: {w for w in s.lower().replace("-", " ").split() if w not in A.GENERIC_WORDS}

        def settle(cand=cand, near=near, names=names):
            before = None
            while before != cand:
                before = {n: set(c) for n, c in cand.items()}
                for f, es in near.items():
                    fit = [e for e in es if e[2] in before[f[2]] and e[3] in before[f[3]]]
                    cand[f[2]] &= {e[2] for e in fit}
                    cand[f[3]] &= {e[3] for e in fit}
                taken = [(n, next(iter(c))) for n, c in cand.items() if len(c) == 1]
                for n, x in taken:
                    for other in names - {n}:
                        cand[other].discard(x)

        def record(how, cand=cand, method=method):
            for n, c in cand.items():
                if len(c) == 1:
                    method.setdefault(n, how)

        settle()
        record("FIXTURE_IDENTITY")
        while True:
            undecided = [n for n in names if len(cand[n]) > 1]
            hits = {n: [x for x in cand[n] if word(n) & word(x)] for n in undecided}
            picks = {n: h[0] for n, h in hits.items() if len(h) == 1 and sum(h[0] in v for v in hits.values()) == 1}
            if not picks:
                break
            for n, x in picks.items():
                cand[n] = {x}
                method[n] = "NAME_WORD"
            settle()
            record("ELIMINATION")
        single = {n: next(iter(c)) for n, c in cand.items() if len(c) == 1}
        bad = any(not c for c in cand.values()) or len(set(single.values())) < len(single)
        bad |= any(sum(e[2] == single[f[2]] and e[3] == single[f[3]] for e in es) != 1 for f, es in near.items() if f[2] in single and f[3] in single)
        for n in {n for f in ours for n in f[2:]}:
            how = "NONE" if n not in names else "CONFLICT" if bad else method[n] if n in single else "AMBIGUOUS"
            out[comp, n] = (single[n] if how in ("FIXTURE_IDENTITY", "NAME_WORD", "ELIMINATION") else None, how)
    return out


def league(rng, comp, teams, rounds, spread, named):
    fixtures, odds = [], []
    for k in range(rounds):
        order = rng.sample(teams, len(teams))
        for h, a in zip(order[::2], order[1::2]):
            at = T0 + dt.timedelta(days=7 * k, minutes=10 * rng.randrange(spread))
            fixtures.append((comp, at, h, a))
            odds.append((comp, at + dt.timedelta(minutes=rng.randint(-10, 10)), named(h), named(a)))
    return fixtures, odds


@pytest.mark.parametrize("seed", [3, 4])
def test_aliases_by_kickoff(spark, seed):
    rng, fixtures, odds = random.Random(seed), [], []
    teams = [f"Club {w}" for w in ("Alder", "Birch", "Cedar", "Dogwood", "Elm", "Fir")]
    parts = [
        league(rng, "easy", teams, 8, 40, lambda n: f"{n[5:].upper()} x"),
        league(rng, "tight", teams, 2, 1, lambda n: f"{n[5:]} FC"),
        league(rng, "blind", teams, 1, 1, lambda n: f"Z{sum(map(ord, n))}"),
        league(rng, "broken", teams, 6, 40, lambda n: "same" if n[-1] in "rm" else n[5:]),
    ]
    for f, o in parts:
        fixtures, odds = fixtures + f, odds + o
    fixtures.append(("easy", T0 + dt.timedelta(days=900), "Lost", "Far"))
    got = A.derive_names(spark.createDataFrame(fixtures, SCHEMA).repartition(3), spark.createDataFrame(odds, SCHEMA), "comp", "at", "home", "away")
    got = {(r["comp"], r["name"]): (r["alias"], r["method"]) for r in got.collect()}
    want = plain(fixtures, odds)
    assert got == want
    assert {m for _, m in want.values()} >= {"FIXTURE_IDENTITY", "CONFLICT", "NONE"} | ({"NAME_WORD"} if seed == 4 else set())
    assert all(a == f"{n[5:].upper()} x" for (c, n), (a, _) in want.items() if c == "easy" and a)


def test_query_finds_true_names(spark):
    got = catalog.QUERIES["j10_aliases_by_kickoff"](spark, "/root/testdata/sf0.001").collect()
    named = [r for r in got if r.alias]
    assert len(named) > 50 and all(r.alias == f"T{int(r['name'][1:]) * 7 % 25}" for r in named)


def test_alias_conflicts_are_errors(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "raw string")
    table = [("a", "A"), ("a", "A"), ("b", "B")]
    good = spark.createDataFrame(table, "raw string, name string")
    assert {(r.raw, r.name) for r in A.normalised(rows, good, "raw", "name").collect()} == {("a", "A"), ("b", "B"), ("c", None)}
    bad = spark.createDataFrame([*table, ("b", "BB")], "raw string, name string")
    assert [tuple(r) for r in A.alias_conflicts(bad, "raw", "name").collect()] == [("b", ["B", "BB"])]
    with pytest.raises(PySparkException, match="two canonical names for b"):
        A.normalised(rows, bad, "raw", "name").collect()


def test_windows_and_test_periods(spark):
    d = lambda k: dt.date(2024, 1, k)
    rows = spark.createDataFrame([(1, d(5), [d(1), d(4)]), (2, d(5), [d(4), d(5)]), (3, d(5), [d(7), d(6), d(1)]), (4, d(5), [])], "id int, day date, seen array<date>")
    assert [(r.id, r.violation) for r in G.window_violations(rows, "day", "seen").orderBy("id").collect()] == [(2, d(5)), (3, d(6))]
    assert G.test_period_violations(rows.withColumn("day", F.date_add("day", F.col("id"))), "day", "2024-01-08").count() == 2
