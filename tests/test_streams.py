"""Streams whose state ends: flat state over many batches, late and tied rows, and outer joins that tell what never came."""

import datetime as dt

from pyspark.sql import functions as F

from quotelark.streaming import ledgers as S
from quotelark.streaming.state import first_of_key, latest_observed, rocksdb

DAY0 = dt.datetime(2024, 3, 1)


def at(day, hour=0, minute=0):
    return DAY0 + dt.timedelta(days=day, hours=hour, minutes=minute)


def play(spark, path, batches, schema, start):
    """Runs the query for each batch; how many state rows each batch left."""
    state = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(2).write.mode("append").parquet(f"{path}/in")
        with rocksdb(spark):
            query = start(S.read_files(spark, f"{path}/in", schema, 1000))
        query.awaitTermination()
        state.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    return state


def test_first_of_key_keeps_state_flat(spark, tmp_path):
    schema = "game string, ts timestamp, pick string, tick int"
    batches = []
    for d in range(10):
        rows = [(f"g{d}-{k}", at(d, 1 + h), f"p{h}", h) for k in range(30) for h in (3, 1, 2)]
        rows += [(f"g{d}-0", at(d, 2), "tied", -1)] if d == 0 else []
        rows += [(f"g{d - 1}-{k}", at(d - 1, 23), "again", 9) for k in range(30)] if d else []
        batches.append(rows)
    batches[5] += [("g0-1", at(0, 23), "late", 0), ("never", at(0, 5), "late", 0)]  # the watermark is past both

    def start(s):
        ends = s.withColumn("over", (F.to_date("ts") + F.expr("INTERVAL 1 DAY")).cast("timestamp"))
        return S.appended(first_of_key(ends, ["game"], ["ts", "tick"], "ts", "over", late="2 hours", buckets=3), f"{tmp_path}/out", f"{tmp_path}/state")

    state = play(spark, tmp_path, batches, schema, start)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    kept = {r.game: (r.pick, r.tick) for r in got if r.status == "KEPT"}
    assert len(kept) == 300 and set(kept.values()) == {("p1", 1), ("tied", -1)} and kept["g0-0"] == ("tied", -1)
    assert sum(r.status == "SKIPPED" for r in got) == sum(map(len, batches)) - 300 - 2 and "never" not in kept
    assert max(state) <= 3


def test_first_of_key_prefers_the_order_in_ties(spark, tmp_path):
    schema = "game string, ts timestamp, tick int"
    rows = [("a", at(0, 1), 5), ("a", at(0, 1), 2), ("b", at(0, 3), 1), ("b", at(0, 2), 7)]
    start = lambda s: S.appended(first_of_key(s.withColumn("over", F.expr("ts + INTERVAL 1 DAY")), ["game"], ["ts", "tick"], "ts", "over"), f"{tmp_path}/out", f"{tmp_path}/state")
    play(spark, tmp_path, [rows, [("a", at(0, 4), 0)]], schema, start)
    got = {(r.game, r.tick, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("a", 2, "KEPT"), ("a", 5, "SKIPPED"), ("b", 7, "KEPT"), ("b", 1, "SKIPPED"), ("a", 0, "SKIPPED")}


def test_latest_observed_revises_conflicts_and_forgets(spark, tmp_path):
    schema = "event string, seen timestamp, start string"
    batches = [
        [("a", at(0), "x"), ("a", at(1), "y"), ("b", at(0), "x"), ("b", at(0), "z")],
        [("a", at(0), "older"), ("b", at(2), "w"), ("c", at(2), None)],
        [("a", at(1), "tie"), ("b", at(2), "w")],
        [("a", at(3), "y")],
    ]
    batches += [[(f"e{d}", at(d), "s")] for d in range(20, 44, 6)]
    start = lambda s: S.upserts(latest_observed(s, ["event"], "seen", "start", late="3 days", idle="5 days", buckets=2), f"{tmp_path}/out", f"{tmp_path}/state")
    state = play(spark, tmp_path, batches, schema, start)
    every = {(r.event, r.batch): (r.found, r.status, r.start) for r in spark.read.parquet(f"{tmp_path}/out/*").collect() if r.event in "abc"}
    assert sorted(v for (k, _), v in every.items() if k == "a") == [(1, "OK", "y"), (1, "OK", "y"), (2, "CONFLICT", None)]
    last = {r.event: (r.found, r.status, r.start) for r in S.latest_rows(spark, f"{tmp_path}/out", "event").collect()}
    assert last["a"] == (1, "OK", "y") and last["b"] == (1, "OK", "w") and last["c"] == (0, "CONFLICT", None) and len(last) == 7
    assert max(state) <= 2


def test_captures_come_out_missed_once_the_time_is_past(spark, tmp_path):
    targets, quotes = "k long, start timestamp", "k long, ts timestamp, price double"
    parts = [
        ([(1, at(0, 12)), (2, at(0, 12)), (3, at(0, 13))], [(1, at(0, 11, 55), 1.5), (1, at(0, 11, 40), 1.4), (2, at(0, 12), 1.6), (9, at(0, 12), 1.0)]),
        ([(4, at(1, 12))], [(3, at(0, 12, 59), 1.7), (-1, at(1, 12), 0.0)]),
        ([(-1, at(9))], [(-1, at(9), 0.0)]),
        ([(-1, at(10))], [(-1, at(10), 0.0)]),
    ]
    seen = []
    for a, b in parts:
        spark.createDataFrame(a, targets).coalesce(1).write.mode("append").parquet(f"{tmp_path}/a")
        spark.createDataFrame(b, quotes).coalesce(1).write.mode("append").parquet(f"{tmp_path}/b")
        joined = S.captures(S.read_files(spark, f"{tmp_path}/a", targets, 1000), S.read_files(spark, f"{tmp_path}/b", quotes, 1000), "k", "start", "ts")
        S.appended(joined, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        seen.append({(r.k, r.price) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.k > 0})
    assert seen[0] == {(1, 1.5)} and seen[1] >= {(1, 1.5), (3, 1.7)} and (4, None) not in seen[1]
    assert seen[3] == {(1, 1.5), (2, None), (3, 1.7), (4, None)}


def test_trailing_days_append_each_window_once(spark, tmp_path):
    days, schema = 30, "u long, ts timestamp"
    rows = [(k % 3, at(k % 40, k % 24)) for k in range(200)]
    batches = [[r for r in rows if r[1] < at(20)], [r for r in rows if r[1] >= at(20)], [(-1, at(120))], [(-1, at(121))]]
    play(spark, tmp_path, batches, schema, lambda s: S.appended(S.trailing(s, "ts", "u", days), f"{tmp_path}/out", f"{tmp_path}/state"))
    want = {}
    for u, ts in rows:
        for back in range(days):
            key = (u, (ts - dt.timedelta(days=back)).date())
            want[key] = want.get(key, 0) + 1
    got = [((r.u, r.begin.date()), r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.u >= 0]
    assert len(got) == len(want) and dict(got) == want
