"""Queries of names across sources, fresh prices and what a split must not see."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotelark.operators import aliases as A
from quotelark.operators import gates as G
from quotelark.operators import temporal as T
from quotelark.plans.registry import query, rounded

HOURS = 3_600_000_000


def two_sources(t):
    """Orders as fixtures of two nations, and as another source names them, up to seven minutes earlier or later.

    Kickoffs lie on a grid of ten minutes, so that most slots hold a few fixtures; odd fixtures are in the second source only.
    """
    o = t.read("orders").join(t.read("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    away = (F.col("c_nationkey") + 1 + F.col("o_orderkey") % 24) % 25
    at = F.timestamp_micros(F.unix_micros(F.to_date("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 144 * 600_000_000)
    rows = o.select(F.col("o_orderpriority").alias("comp"), at.alias("at"), F.concat(F.lit("N"), "c_nationkey").alias("home"), F.concat(F.lit("N"), away.cast("string")).alias("away"), "c_nationkey", away.alias("a"), "o_orderkey", "o_orderstatus")
    named = lambda n: F.concat(F.lit("T"), (n * 7 % 25).cast("string"))
    later = F.timestamp_micros(F.unix_micros("at") + (F.col("o_orderkey") % 15 - 7) * 60_000_000)
    return rows.where("o_orderstatus = 'F'").select("comp", "at", "home", "away"), rows.select("comp", later.alias("at"), named(F.col("c_nationkey")).alias("home"), named(F.col("a")).alias("away"))


@query("j10_aliases_by_kickoff")
def by_kickoff(t):
    """Names of one source from the other's, where kickoffs differ by minutes. Tests hold it against plain Python."""
    fixtures, odds = two_sources(t)
    return A.derive_names(fixtures, odds, "comp", "at", "home", "away")


@query("p12_alias_conflicts", "", """
select c_mktsegment as raw, list_sort(list(distinct n_name)) as canonicals from customer join nation on c_nationkey = n_nationkey where c_custkey % 40 = 0 or c_mktsegment in (select min(c_mktsegment) from customer) group by 1 having count(distinct n_name) > 1""")
def conflicts(t):
    """Raw names that an alias table gives several canonical ones; normalising by such a table is an error."""
    c = t.read("customer").join(F.broadcast(t.read("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    first = c.agg(F.min("c_mktsegment").alias("first"))  # one row
    named = c.crossJoin(F.broadcast(first)).where((F.col("c_custkey") % 40 == 0) | (F.col("c_mktsegment") == F.col("first")))
    return A.alias_conflicts(named.select(F.col("c_mktsegment").alias("raw"), "n_name"), "raw", "n_name")


@query("p16_fresh_sources", "ticks starts", """
, a as (select entity, start_id, start_ts, entry_ts + interval 6 hour as now from starts),
j as (select a.entity, start_id, any_value(now >= start_ts) as started, arg_max(price, (ts, tick_id)) filter (source = 'purchase') as back, arg_max(price, (ts, tick_id)) filter (source = 'click') as lay,
  avg(price) filter (source = 'view') as books, count(*) filter (source = 'view') as n from a left join ticks k on k.entity = a.entity and k.ts <= now and k.ts >= now - interval 12 hour group by a.entity, start_id)
select entity, start_id, round(case when started then null when back is not null and lay is not null then (back + lay) / 2 when back is not null then back when n >= 2 then books end, 6) as price,
  case when started then 'STARTED' when back is not null and lay is not null then 'EXCHANGE_MID' when back is not null then 'EXCHANGE_BACK' when n >= 2 then 'CONSENSUS' else 'NONE' end as origin from j""")
def fresh_sources(t):
    """The best source whose price is at most twelve hours old: both sides of the exchange, its back price, two books or more, else none."""
    asks = t.starts().select("entity", "start_id", "start_ts", (F.col("entry_ts") + F.expr("INTERVAL 6 HOURS")).alias("now"))
    old = lambda c: T.micros("now") - T.micros(c) <= 12 * HOURS
    for source, name in (("purchase", "back"), ("click", "lay")):
        got = T.as_of(asks, t.ticks().where(F.col("source") == source), "entity", "now", "ts", ["price"], "tick_id")
        asks = got.withColumn(name, F.when(old("as_of_ts"), F.col("as_of_price"))).drop("as_of_ts", "as_of_price")
    views = t.ticks().where("source = 'view'").select("entity", T.micros("ts").alias("at"), "price")
    both = views.unionByName(asks.select("*", T.micros("now").alias("at")), allowMissingColumns=True)
    recent = W.partitionBy("entity").orderBy("at").rangeBetween(-12 * HOURS, 0)
    at = both.withColumn("books", F.avg("price").over(recent)).withColumn("n", F.count("price").over(recent)).where("start_id is not null")
    started, mid, back, several = F.col("now") >= F.col("start_ts"), F.col("back").isNotNull() & F.col("lay").isNotNull(), F.col("back").isNotNull(), F.col("n") >= 2
    price = F.when(started, None).when(mid, (F.col("back") + F.col("lay")) / 2).when(back, F.col("back")).when(several, F.col("books"))
    origin = F.when(started, "STARTED").when(mid, "EXCHANGE_MID").when(back, "EXCHANGE_BACK").when(several, "CONSENSUS").otherwise("NONE")
    return rounded(at.select("entity", "start_id", price.alias("price"), origin.alias("origin")))


@query("g12_split_violations", "history", """
, l as (select l_orderkey as id, min(l_shipdate)::date as day, count(*) as rows from lineitem group by 1), o as (select o_orderkey as id, o_orderdate::date as start, o_orderstatus as s from orders),
w as (select team, match_id, day, list(day) over (partition by team order by day, match_id rows between 5 preceding and 1 preceding) as seen from history)
select 'DECIDED_AFTER_START' as check_name, count(*) as hits from l join o using (id) where day > start + 60
union all select 'REPEATED_ID', sum(rows - 1)::bigint from l where rows > 1
union all select 'WINDOW_SEES_ITS_DAY', count(*) from w where len(list_filter(coalesce(seen, []), lambda d: d >= day)) > 0
union all select 'TEST_PERIOD_IN_DEVELOPMENT', count(*) from history where day >= date '1998-06-01' and league <> 4""")
def split_violations(t):
    """Four checks on rows as they came: decisions later than their event allows, ids that repeat, rolling windows that hold their own day or later, and test days among development rows."""
    l = t.read("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min(F.to_date("l_shipdate")).alias("day"), F.count(F.lit(1)).alias("rows"))
    o = t.read("orders").select(F.col("o_orderkey").alias("id"), F.date_add(F.to_date("o_orderdate"), 60).alias("last"))
    h = t.history()
    last5 = W.partitionBy("team").orderBy("day", "match_id").rowsBetween(-5, -1)
    checks = {
        "DECIDED_AFTER_START": l.join(o, "id").where("day > last").agg(F.count(F.lit(1)).alias("hits")),
        "REPEATED_ID": l.agg(F.coalesce(F.sum(F.when(F.col("rows") > 1, F.col("rows") - 1)), F.lit(0)).alias("hits")),
        "WINDOW_SEES_ITS_DAY": G.window_violations(h.withColumn("seen", F.collect_list("day").over(last5)), "day", "seen").agg(F.count(F.lit(1)).alias("hits")),
        "TEST_PERIOD_IN_DEVELOPMENT": G.test_period_violations(h.where("league <> 4"), "day", "1998-06-01").agg(F.count(F.lit(1)).alias("hits")),
    }
    rows = [df.select(F.lit(name).alias("check_name"), F.col("hits").cast("long").alias("hits")) for name, df in checks.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
