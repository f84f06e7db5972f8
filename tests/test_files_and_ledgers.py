"""File scans, sinks and streams on small fixtures."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from quotelark.functions import odds as O
from quotelark.functions import text as X
from quotelark.operators import consensus as C
from quotelark.operators import history as H
from quotelark.operators import models as M
from quotelark.sinks import ledger as L
from quotelark.sources import files as S
from quotelark.streaming import ledgers as Q

TS = datetime.datetime


def test_two_books_by_hand(spark):
    rows = [("m", b, o, x) for b, q in (("b1", (2.0, 4.0, 4.0)), ("b2", (1.8, 3.6, 4.5))) for o, x in zip(("home", "draw", "away"), q)] + [("m", "b3", "home", 2.0)]
    quotes = spark.createDataFrame(rows, "market string, book string, outcome string, odds double")
    got = {r.outcome: r.median_p for r in C.consensus(C.fair_by_book(quotes, ["home", "draw", "away"])).collect()}
    assert got["home"] == pytest.approx(0.513158, abs=1e-6) and got["draw"] == pytest.approx(0.256579, abs=1e-6) and got["away"] == pytest.approx(0.230263, abs=1e-6)
    status = {r.book: (r.complete, r.missing) for r in C.complete_books(quotes, ["home", "draw", "away"]).collect()}
    assert status["b3"] == (False, "away,draw") and status["b1"] == (True, "")


@pytest.mark.parametrize("method", ["proportional", "additive", "power", "odds_ratio", "shin"])
def test_devig_keeps_a_fair_book(spark, method):
    df = spark.createDataFrame([([2.0, 4.0, 4.0],), ([1.5, 4.0, 7.0],)], "q array<double>")
    fair, real = [r.p for r in df.select(O.devig(F.col("q"), method).alias("p")).collect()]
    assert fair == pytest.approx([0.5, 0.25, 0.25], abs=1e-6) and sum(real) == pytest.approx(1) and real[0] > real[1] > real[2]


def test_unknown_market_is_an_error(spark):
    df = spark.range(1).select(O.outcome(F.lit("odd"), F.lit("x"), F.lit(1), F.lit(0), F.lit(2.5)).alias("x"))
    with pytest.raises(Exception, match="unknown market"):
        df.collect()


def test_rolling_sees_only_earlier_rows(spark):
    rows = [("t", k, TS(2024, 1, k + 1).date(), float(k), 0.0) for k in range(7)]
    schema = "team string, match_id long, day date, goals_for double, goals_against double"
    got = H.form(spark.createDataFrame(rows, schema), 5).orderBy("match_id").collect()
    assert got[0].window_matches == 0 and got[0].form_for is None and got[6].window_matches == 5 and got[6].form_for == pytest.approx(3.0)
    changed = [r if r[1] != 3 else (*r[:3], 99.0, 0.0) for r in rows]
    again = H.form(spark.createDataFrame(changed, schema), 5).orderBy("match_id").collect()
    assert again[3] == got[3] and again[4].form_for != got[4].form_for


def test_csv_and_json_scans(spark, tmp_path):
    (tmp_path / "odds.csv").write_text("market_id,event,selection,bookmaker,decimal_odds\nm,e,home,b,2.5\nm,e,away,b,\n")
    assert sorted((r.outcome, r.odds) for r in S.long_odds(spark, str(tmp_path / "odds.csv")).collect()) == [("away", None), ("home", 2.5)]
    feed = {"id": "e", "commence_time": "2024-01-01T10:00:00Z", "home_team": "H", "away_team": "A", "bookmakers": [{"key": "b", "last_update": "2024-01-01T09:00:00Z", "markets": [{"key": "h2h", "outcomes": [{"name": "H", "price": 2.0}, {"name": "H", "price": 9.0}, {"name": "Draw", "price": 3.0}, {"name": "Z", "price": 1.1}]}]}]}
    (tmp_path / "feed.json").write_text(json.dumps(feed))
    assert sorted((r.outcome, r.odds) for r in S.odds_feed(spark, str(tmp_path / "feed.json")).collect()) == [("draw", 3.0), ("home", 2.0)]
    (tmp_path / "scores.json").write_text(json.dumps({"id": "e", "completed": True, "home_team": "H", "away_team": "A", "scores": [{"name": "A", "score": "x"}, {"name": "H", "score": "2"}]}))
    row = S.scores(spark, str(tmp_path / "scores.json")).first()
    assert (row.completed, row.home, row.away) == (True, 2, None)


def test_messages_to_index(spark, tmp_path):
    lines = [
        {"pt": 1, "mc": [{"id": "1.1", "marketDefinition": {"eventId": "9", "marketType": "MATCH_ODDS", "status": "OPEN", "runners": [{"id": 1, "name": "A"}]}}]},
        {"pt": 3, "mc": [{"id": "1.1", "rc": [{"id": 1, "ltp": 2.0}, {"id": 2, "batb": [[0, 1.5]]}]}]},
        {"pt": 2, "mc": [{"id": "1.1", "marketDefinition": {"status": "SUSPENDED"}, "rc": [{"id": 1, "ltp": 1.9}]}]},
    ]
    (tmp_path / "m.json").write_text("\n".join(map(json.dumps, lines)))
    rows = S.messages(spark, str(tmp_path / "m.json"))
    row = S.market_index(rows).first()
    assert (row.eventId, row.status, row.n_messages, [p.ltp for p in row.prices]) == ("9", "SUSPENDED", 3, [1.9, 2.0])
    assert S.bad_ladders(rows).count() == 1 and S.price_points(S.market_index(rows)).count() == 2
    found = S.manifest(spark, str(tmp_path / "m.json"))
    frozen = spark.createDataFrame([("m.json", 1, "0"), ("gone", 1, "0")], "name string, size long, sha256 string")
    assert {r.name: r.status for r in S.manifest_check(found, frozen).collect()} == {"m.json": "CHANGED", "gone": "MISSING"}


def test_wide_to_long(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0, None, None, None), (2, 2.0, None, 4.0, 1.5, 3.0, 9.0)], "id long, ah double, ad double, aa double, bh double, bd double, ba double")
    got = S.wide_to_long(df, ["id"], {"a": ["ah", "ad", "aa"], "b": ["bh", "bd", "ba"]}, ["home", "draw", "away"])
    assert {(r.id, r.book, r.status) for r in got.collect()} == {(1, "a", "OK"), (2, "a", "REJECTED"), (2, "b", "OK")} and got.count() == 9


def test_dates_and_names(spark):
    df = spark.createDataFrame([("05/09/2023",), ("05/09/23",), ("x",)], "d string")
    assert [str(r[0]) for r in df.select(S.match_day(F.col("d"))).collect()] == ["2023-09-05", "2023-09-05", "None"]
    row = spark.createDataFrame([("José-María  Núñez", "2.0@2.1")], "n string, q string").select(X.name_forms(F.col("n")).alias("f"), X.exchange_spread(F.col("q")).alias("s"), X.season(F.lit(TS(2024, 3, 1))).alias("y")).first()
    assert row.f == ["jose maria nunez", "nunez j.", "nunez, jose"] and row.s == pytest.approx(1 / 2 - 1 / 2.1) and row.y == "2023/24"


def test_append_unique_and_days(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, n int, v string")
    assert L.append_unique(rows, path, ["k"], ["n"]) == 2 and L.append_unique(rows, path, ["k"], ["n"]) == 0
    assert {(r.k, r.v) for r in L.read(spark, path, rows.schema).collect()} == {("a", "y"), ("b", "z")}
    days = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2)], "day string, n int")
    assert L.write_days(days, str(tmp_path / "days"), "day") == ["2024-01-01", "2024-01-02"] and L.write_days(days, str(tmp_path / "days"), "day") == []
    L.contract(rows, str(tmp_path / "out"), ["k", "n"], "n > 1")
    assert spark.read.csv(str(tmp_path / "out/qualified"), header=True).count() == 2


def test_settlement(spark):
    ledger = spark.createDataFrame([(1, "old", 1)], "card long, settlement_id string, seq int")
    settled = spark.createDataFrame([(1, "won"), (2, "lost")], "card long, result string")
    new = L.superseding(settled, ledger, "card", ["result"])
    assert {(r.card, r.supersedes, r.seq) for r in new.collect()} == {(1, "old", 2), (2, None, 1)}
    after = ledger.unionByName(new.select("card", "settlement_id", F.col("seq").cast("int").alias("seq")))
    assert L.superseding(settled, after, "card", ["result"]).count() == 0
    bets = spark.createDataFrame([(1, "PENDING", None), (2, "WON", 5.0)], "card long, status string, profit double")
    outcome = spark.createDataFrame([(1, "LOST", -1.0), (2, "LOST", -1.0)], "card long, status string, profit double")
    assert [tuple(r) for r in L.settle(bets, outcome, "card", ["status", "profit"]).orderBy("card").collect()] == [(1, "LOST", -1.0), (2, "WON", 5.0)]


def test_append_reads_the_folders_of_its_own_days(spark, tmp_path):
    schema, path = "day date, k string, n int", str(tmp_path / "ledger")
    d = lambda k: TS(2024, 1, k).date()
    assert L.append_unique(spark.createDataFrame([(d(1), "a", 1), (d(2), "a", 2), (d(2), "b", 3), (None, "z", 4)], schema), path, ["day", "k"], ["n"], "day") == 4
    (tmp_path / "ledger" / "day=2024-01-01").rename(tmp_path / "moved")  # a day that the next append has no business with
    more = [(d(2), "b", 0), (d(2), "c", 9), (d(2), "c", 5), (None, "z", 0), (d(3), "a", 7)]
    assert L.append_unique(spark.createDataFrame(more, schema), path, ["day", "k"], ["n"], "day") == 2
    got = {(r.day, r.k): r.n for r in L.read(spark, path, schema).collect()}
    assert got == {(d(2), "a"): 2, (d(2), "b"): 3, (None, "z"): 4, (d(2), "c"): 5, (d(3), "a"): 7}
    held = L.read(spark, path, schema).where(F.col("day").isin([d(2)])).select("day", "k")
    assert "PartitionFilters: [isnotnull(day" in held._jdf.queryExecution().toString()


def test_canonical_id_upgrade(spark):
    ledger = spark.createDataFrame([("p1", False), ("p2", True)], "id string, validated boolean")
    rows = spark.createDataFrame([("p1", True), ("p2", True), ("p3", True)], "id string, validated boolean")
    got = {r.id for r in L.upgraded_ids(rows, ledger, "id", "validated").collect()}
    assert "p3" in got and "p1" not in got and "p2" not in got and len(got) == 2


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.createDataFrame([("a", TS(2024, 1, 1, 1), 1), ("a", TS(2024, 1, 1, 2), 2), ("b", TS(2024, 1, 2), 3)], "k string, ts timestamp, n int")
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(src)
    path = str(tmp_path / "out")
    Q.append_to_ledger(Q.read_files(spark, src, rows.schema, 1), path, ["k"], ["n"], str(tmp_path / "state")).awaitTermination()
    assert {(r.k, r.n) for r in L.read(spark, path, rows.schema).collect()} == {("a", 1), ("b", 3)}


def test_rating_replay(spark):
    rows = [(0, k, TS(2024, 1, k + 1).date(), 1, 2, 1) for k in range(3)]
    got = M.replay_ratings(spark.createDataFrame(rows, "pool long, match_id long, day date, a long, b long, a_won int"), "pool").orderBy("match_id").collect()
    ra = rb = 1500.0
    for r in got:
        p = 1 / (1 + 10 ** (-(ra - rb) / 400))
        assert (r.rating_a, r.rating_b, r.p) == pytest.approx((ra, rb, p))
        ra, rb = ra + 20 * (1 - p), rb - 20 * (1 - p)
