"""Streaming queries: the events arrive as files in three parts, in order of time, some rows late; after each part the query goes on from its checkpoint."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelark.plans.registry import query, rounded
from quotelark.scratch import new_path
from quotelark.streaming import ledgers as S
from quotelark.streaming.state import first_of_key, latest_observed, rocksdb


def played(t, start, *sources) -> None:
    """Run a query over parts of its sources: the first and second half by time, then a part for each further condition.

    sources: (rows, ts, *conditions). start(*streams) starts the query; it ends with each part and takes up the next from its checkpoint.
    """
    laid = []
    for rows, ts, *later in sources:
        cut = rows.agg(F.percentile_approx(F.unix_micros(ts), 0.5)).first()[0]
        part = F.when(F.unix_micros(ts) <= (cut or 0), 0).otherwise(1)
        for k, condition in reversed(list(enumerate(later, 2))):
            part = F.when(F.expr(condition), k).otherwise(part)
        laid.append((rows, part, new_path(t.spark)))
    for k in range(2 + max(len(later) for _, _, *later in sources)):
        for rows, part, path in laid:
            rows.where(part == k).write.mode("append").parquet(path)
        with rocksdb(t.spark):
            query = start(*(S.read_files(t.spark, path, rows.schema, 10_000) for rows, _, path in laid))
        query.awaitTermination()


#: The key of heartbeats; joins drop null keys before they tell the time.
CLOCK = -1


def with_clock(rows, ts: str, key: str, ahead: int = 90) -> tuple:
    """A source for played(): rows, and two that only say what time it is, `ahead` days after all others (feeds send such heartbeats).

    The first moves the watermark past all that is open; the second makes one more batch, which acts on it.
    """
    last = rows.agg(F.unix_micros(F.max(ts))).first()[0] or 0
    beats = rows.sparkSession.range(2).select(*(F.timestamp_micros(F.lit(last) + (F.col("id") + ahead) * 86_400_000_000).alias(c) if c == ts else F.lit(CLOCK if c == key else None).cast(kind).alias(c) for c, kind in rows.dtypes))
    first = f"{key} = {CLOCK} and unix_micros({ts}) = {last + ahead * 86_400_000_000}"
    return rows.unionByName(beats), ts, first, f"{key} = {CLOCK} and not ({first})"


def ticks(t):
    return t.ticks().select("tick_id", "entity", F.col("ts").cast("timestamp").alias("ts"), "price", "source")


@query("q1_stream_latest_definition", "ticks", "select entity, arg_max(price, (ts, tick_id)) as price, arg_max(tick_id, (ts, tick_id)) as tick_id, max(ts) as ts from ticks where source in ('view', 'click') group by entity")
def latest_definition(t):
    """The last usable definition of each market, in update mode; some clicks come late and don't undo newer ones."""
    last = lambda rows: rows.groupBy("entity").agg(F.max(F.struct("ts", "tick_id", "price")).alias("x")).select("entity", "x.price", "x.tick_id", "x.ts")
    path = new_path(t.spark)
    played(t, lambda rows: S.upserts(last(rows), f"{path}/rows", f"{path}/state"), (ticks(t).where("source in ('view', 'click')"), "ts", "source = 'click' and price > 150"))
    return S.latest_rows(t.spark, f"{path}/rows", "entity").select("entity", "price", "tick_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("q3_stream_first_snapshot_only", "ticks", "select entity, ts::date as game, arg_min(tick_id, (ts, tick_id)) as tick_id from ticks group by all")
def first_snapshot(t):
    """One prediction a game, though later files hold other favourites. State: a mark for each open game, until the day is over."""
    rows = ticks(t).withColumn("game", F.to_date("ts")).withColumn("over", (F.col("game") + F.expr("INTERVAL 1 DAY")).cast("timestamp"))
    path = new_path(t.spark)
    played(t, lambda s: S.appended(first_of_key(s, ["entity", "game"], ["ts", "tick_id"], "ts", "over"), f"{path}/rows", f"{path}/state"), (rows, "ts"))
    return t.spark.read.parquet(f"{path}/rows").where("status = 'KEPT'").select("entity", "game", "tick_id")


@query("q4_stream_quotes_before_start", "ticks starts", """
select s.entity, s.start_id, count(*) as quotes, count(*) filter (epoch_us(start_ts) - epoch_us(ts) <= 600000000) as near_close, round(max(price), 4) as best from starts s join ticks t on t.entity = s.entity and t.ts > s.entry_ts and t.ts < s.start_ts and t.ts < s.entry_ts + interval 7 day group by all""")
def before_start(t):
    """A stream-stream join: quotes after the entry and before the start, with those of the last ten minutes counted."""
    entries = t.starts().select("entity", "start_id", F.col("entry_ts").cast("timestamp").alias("entry_ts"), F.col("start_ts").cast("timestamp").alias("start_ts"))
    path = new_path(t.spark)
    joined = lambda a, b: S.quotes_before_start(a, b, "entity", "entry_ts", "start_ts", "ts", late="40 days").select("entity", "start_id", "start_ts", "ts", "price")
    played(t, lambda a, b: S.appended(joined(a, b), f"{path}/rows", f"{path}/state"), (entries, "entry_ts"), (ticks(t), "ts"))
    near = F.unix_micros("start_ts") - F.unix_micros("ts") <= 600_000_000
    return rounded(t.spark.read.parquet(f"{path}/rows").groupBy("entity", "start_id").agg(F.count(F.lit(1)).alias("quotes"), F.count_if(near).alias("near_close"), F.max("price").alias("best")), 4)


@query("q5_stream_start_revisions", "ticks", """
, o as (select entity, date_trunc('day', ts) as seen, floor(price) as start_at from ticks), l as (select entity, max(seen) as seen from o group by entity)
select o.entity, count(distinct start_at) as starts, case when count(distinct start_at) = 1 then 'OK' else 'CONFLICT' end as status, case when count(distinct start_at) = 1 then min(start_at) end as start_at from o join l on o.entity = l.entity and o.seen = l.seen group by o.entity""")
def revisions(t):
    """The latest observation wins; several different ones at that time are a conflict. State: a key's latest time and its starts."""
    rows = ticks(t).select("entity", F.date_trunc("day", "ts").alias("seen"), F.floor("price").alias("start_at"))
    path = new_path(t.spark)
    played(t, lambda s: S.upserts(latest_observed(s, ["entity"], "seen", "start_at", idle="400 days"), f"{path}/rows", f"{path}/state"), (rows, "seen"))
    last = S.latest_rows(t.spark, f"{path}/rows", "entity")
    return last.select("entity", F.col("found").alias("starts"), "status", F.col("start_at").cast("double").alias("start_at"))


@query("q6_stream_missed_captures", "ticks starts", """
, j as (select s.entity, s.start_id, count(t.tick_id) as quotes, max(t.price) as best from starts s left join ticks t on t.entity = s.entity and t.ts >= s.start_ts - interval 10 minute and t.ts < s.start_ts group by all)
select entity, start_id, quotes, round(best, 4) as best, case when quotes = 0 then 'MISSED' else 'CAPTURED' end as status from j""")
def missed_captures(t):
    """The quotes of each start's last ten minutes; a start without any comes out of the stream as missed, when its time is past."""
    targets = t.starts().select("entity", "start_id", F.col("start_ts").cast("timestamp").alias("start_ts"))
    quotes = ticks(t).select("entity", "tick_id", "ts", "price")
    path = new_path(t.spark)
    run = lambda a, b: S.appended(S.captures(a, b, "entity", "start_ts", "ts").select("entity", "start_id", "start_ts", "tick_id", "price"), f"{path}/rows", f"{path}/state")
    played(t, run, with_clock(targets, "start_ts", "entity"), with_clock(quotes, "ts", "entity"))
    n = F.count("tick_id")
    found = t.spark.read.parquet(f"{path}/rows").where(F.col("entity") != CLOCK).groupBy("entity", "start_id").agg(n.alias("quotes"), F.max("price").alias("best"))
    return rounded(found.withColumn("status", F.when(F.col("quotes") == 0, "MISSED").otherwise("CAPTURED")), 4)


@query("q6_lag_report", "", """
with r as (select o_orderkey as id, o_orderpriority as source, o_orderstatus as s, o_orderdate::date as start from orders), n as (select max(start) as now from r)
select id, case when s = 'F' then 'SETTLED' when start >= now then 'NOT_STARTED' when now - start <= 30 * substr(source, 1, 1)::int then 'NORMAL_SOURCE_LAG' else 'UNRESOLVED_AFTER_EXPECTED_LAG' end as status, s <> 'F' and now - start > 30 * substr(source, 1, 1)::int as missed from r, n""")
def lag_report(t):
    """What isn't settled yet, against the lag that its source usually has."""
    r = t.read("orders").select(F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("source"), F.col("o_orderstatus").alias("s"), F.to_date("o_orderdate").alias("start"))
    now = r.agg(F.max("start").alias("now"))  # one row
    late = F.datediff("now", "start") > 30 * F.col("source")
    status = F.when(F.col("s") == "F", "SETTLED").when(F.col("start") >= F.col("now"), "NOT_STARTED").when(~late, "NORMAL_SOURCE_LAG").otherwise("UNRESOLVED_AFTER_EXPECTED_LAG")
    return r.crossJoin(F.broadcast(now)).select("id", status.alias("status"), ((F.col("s") != "F") & late).alias("missed"))


@query("q7_stream_scan_selection", "ticks", """
, s as (select entity, ts::date as scan, count(*) as rows from ticks group by all), w as (select entity, max(ts::date) filter (source = 'error') as started from ticks group by entity)
select entity, max(scan) filter (scan >= started) as taken, count(*) filter (started is null) as no_start, count(*) filter (scan < started) as old, count(*) filter (scan >= started) as usable from s join w using (entity) group by entity""")
def scan_selection(t):
    """One record for each scan of the stream; the latest usable scan is taken, none older than the workflow's start."""
    started = ticks(t).where("source = 'error'").groupBy("entity").agg(F.max(F.to_date("ts")).alias("started"))
    rows, path = ticks(t).withColumn("scan", F.to_date("ts")).join(started, "entity", "left"), new_path(t.spark)
    played(t, lambda s: S.scan_records(s, f"{path}/rows", f"{path}/state", "scan", "ts", "started"), (rows, "ts"))
    seen = t.spark.read.parquet(f"{path}/rows/*").groupBy("entity", "scan").agg(F.max_by("status", "batch").alias("status"))
    of = lambda s: F.count_if(F.col("status") == s)
    return seen.groupBy("entity").agg(F.max(F.when(F.col("status") == "USABLE", F.col("scan"))).alias("taken"), of("NO_START").alias("no_start"), of("OLD").alias("old"), of("USABLE").alias("usable"))


@query("q8_stream_trailing_days", "", """
with d as (select user_id, ts::date as day, count(*) as n from events group by all), w as (select 7 as days union all select 30)
select days, user_id, day - (days - 1 - k)::int as begin, sum(n)::bigint as n from d, w, range(0, 30) g(k) where k < days group by all""")
def trailing_days(t):
    """Every 7 and 30 days in a row, from the stream: windows come out once the watermark has passed them."""
    events = t.read("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = []
    for days in (7, 30):
        path = new_path(t.spark)
        played(t, lambda s, p=path, d=days: S.appended(S.trailing(s, "ts", "user_id", d), f"{p}/rows", f"{p}/state"), with_clock(events, "ts", "user_id"))
        out.append(t.spark.read.parquet(f"{path}/rows").where(F.col("user_id") != CLOCK).select(F.lit(days).alias("days"), "user_id", F.to_date("begin").alias("begin"), "n"))
    return out[0].unionByName(out[1])


@query("q8_stream_weeks_and_months", "", """
select 'week' as unit, user_id, date_trunc('week', ts)::date as begin, count(*) as n from events group by all union all select 'month', user_id, date_trunc('month', ts)::date, count(*) from events group by all""")
def weeks_and_months(t):
    """Calendar weeks from the stream, and months from days that the stream has closed."""
    events = with_clock(t.read("events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "ts", "user_id")
    path = new_path(t.spark)
    for unit, window, offset in (("week", "7 days", "4 days"), ("day", "1 day", "0 days")):
        played(t, lambda s, u=unit, w=window, o=offset: S.appended(S.counters(s, "ts", "user_id", w, o), f"{path}/{u}", f"{path}/{u}-state"), events)
    closed = lambda unit: t.spark.read.parquet(f"{path}/{unit}").where(F.col("user_id") != CLOCK).withColumn("begin", F.to_date("begin"))
    months = closed("day").groupBy("user_id", F.trunc("begin", "month").alias("begin")).agg(F.sum("n").alias("n"))
    of = lambda unit, rows: rows.select(F.lit(unit).alias("unit"), "user_id", "begin", "n")
    return of("week", closed("week")).unionByName(of("month", months))
