"""Further queries: panels, statuses, canonical forms and audits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotelark.functions.text import band, market_family
from quotelark.operators import temporal as T
from quotelark.plans.registry import query, rounded


@query("s9_pruned_scan", "", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_shipdate >= timestamp '2001-01-01' and l_quantity > 40")
def pruned(t):
    return t.read("lineitem").where((F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz")) & (F.col("l_quantity") > 40)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("j2_prices_with_same_scan_probability", "ticks", """
, p as (select entity, date_trunc('day', ts) as scan, max(price) as price from ticks where source = 'view' group by all), q as (select entity, date_trunc('day', ts) as scan, arg_max(price, (ts, tick_id)) as prob from ticks where source = 'click' group by all)
select entity, scan, price, prob from p left join q using (entity, scan)""")
def same_scan(t):
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("scan")
    p = t.ticks().where("source = 'view'").groupBy("entity", day).agg(F.max("price").alias("price"))
    q = t.ticks().where("source = 'click'").groupBy("entity", day).agg(F.max_by("price", F.struct("ts", "tick_id")).alias("prob"))
    return p.join(q, ["entity", "scan"], "left").select("entity", "scan", "price", "prob")


@query("j4_latest_probability_or_frozen", "ticks starts", """
, j as (select s.*, (select max((ts, tick_id)) from ticks k where k.entity = s.entity and k.source = 'click' and k.ts <= s.start_ts) as m from starts s)
select j.entity, start_id, coalesce(k.price, -1.0::double) as value, case when k.price is null then 'FROZEN' else 'LATEST' end as origin from j left join ticks k on k.tick_id = m[2]""")
def latest_or_frozen(t):
    got = T.as_of(t.starts().select("entity", "start_id", "start_ts"), t.ticks().where("source = 'click'"), "entity", "start_ts", "ts", ["price"], "tick_id")
    return got.select("entity", "start_id", F.coalesce("as_of_price", F.lit(-1.0)).alias("value"), F.when(F.col("as_of_price").isNull(), "FROZEN").otherwise("LATEST").alias("origin"))


@query("j11_recovery_with_reasons", "", """
with s as (select l_orderkey, min(l_shipdate) as shipped from lineitem group by l_orderkey)
select case when shipped is null then 'NO_LINE' when shipped < o_orderdate then 'BEFORE_ORDER' else 'RECOVERED' end as reason, count(*) as n from orders left join s on o_orderkey = l_orderkey group by 1""")
def recovery(t):
    s = t.read("lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("shipped"))
    reason = F.when(F.col("shipped").isNull(), "NO_LINE").when(F.col("shipped") < F.col("o_orderdate"), "BEFORE_ORDER").otherwise("RECOVERED")
    return t.read("orders").join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("j19_weight_grid", "bets", """
, g as (select a / 4.0 as wa, b / 4.0 as wb, (4 - a - b) / 4.0 as wc from range(0, 5) x(a), range(0, 5) y(b) where a + b <= 4), s as (select avg(p) as p, avg(y) as y, avg(1 / odds) as q from bets)
select wa::double as wa, wb::double as wb, wc::double as wc, round(wa * p + wb * y + wc * q, 6) as mixed from g, s""")
def grid(t):
    s = t.bets().agg(F.avg("p").alias("p"), F.avg("y").alias("y"), F.avg(1 / F.col("odds")).alias("q"))  # one row
    cells = t.spark.createDataFrame([(a / 4, b / 4, (4 - a - b) / 4) for a in range(5) for b in range(5 - a)], "wa double, wb double, wc double")
    return rounded(cells.crossJoin(F.broadcast(s)).select("wa", "wb", "wc", (F.col("wa") * F.col("p") + F.col("wb") * F.col("y") + F.col("wc") * F.col("q")).alias("mixed")))


@query("j29_pre_close_quote", "ticks starts", """
, j as (select s.*, (select max((ts, tick_id)) from ticks k where k.entity = s.entity and k.ts < s.start_ts) as m from starts s)
select j.entity, start_id, k.price as close_price, case when k.ts is null then 'NONE' when epoch_us(start_ts) - epoch_us(k.ts) <= 6 * 3600000000 then 'NEAR_CLOSE' else 'EARLY' end as label from j left join ticks k on k.tick_id = m[2]""")
def pre_close(t):
    asks = t.starts().select("entity", "start_id", "start_ts", (F.col("start_ts") - F.expr("INTERVAL '0.000001' SECOND")).alias("before"))
    got = T.as_of(asks, t.ticks(), "entity", "before", "ts", ["price"], "tick_id")
    age = T.micros("start_ts") - T.micros("as_of_ts")
    return got.select("entity", "start_id", F.col("as_of_price").alias("close_price"), F.when(F.col("as_of_ts").isNull(), "NONE").when(age <= 6 * 3_600_000_000, "NEAR_CLOSE").otherwise("EARLY").alias("label"))


@query("p12_alias_normalisation", "", """
select c_custkey, n_name as canonical, n_name is null as unmapped from customer left join nation on c_nationkey = n_nationkey and n_regionkey <> 0""")
def alias(t):
    names = t.read("nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("canonical"))
    return t.read("customer").join(names, "c_nationkey", "left").select("c_custkey", "canonical", F.col("canonical").isNull().alias("unmapped"))


@query("p16_source_hierarchy", "ticks", """
, d as (select entity, date_trunc('day', ts) as day, max(price) filter (source = 'purchase') as a, max(price) filter (source = 'click') as b, avg(price) filter (source = 'view') as c, count(*) filter (source = 'view') as n from ticks group by all)
select entity, day, round(coalesce(a, b, case when n >= 2 then c end), 6) as value, case when a is not null then 'FIRST' when b is not null then 'SECOND' when n >= 2 then 'CONSENSUS' else 'NONE' end as origin from d""")
def hierarchy(t):
    of = lambda s: F.when(F.col("source") == s, F.col("price"))
    d = t.ticks().groupBy("entity", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.max(of("purchase")).alias("a"), F.max(of("click")).alias("b"), F.avg(of("view")).alias("c"), F.count(of("view")).alias("n"))
    third = F.when(F.col("n") >= 2, F.col("c"))
    origin = F.when(F.col("a").isNotNull(), "FIRST").when(F.col("b").isNotNull(), "SECOND").when(third.isNotNull(), "CONSENSUS").otherwise("NONE")
    return rounded(d.select("entity", "day", F.coalesce("a", "b", third).alias("value"), origin.alias("origin")))


@query("p21_outcome_blind_sides", "history", """
, g as (select match_id, arg_max(team, (goals_for, team)) as winner, arg_min(team, (goals_for, team)) as loser from history group by match_id having count(distinct team) > 1)
select match_id, least(winner, loser) as a, greatest(winner, loser) as b, (winner <= loser)::int as a_won from g""")
def sides(t):
    s = F.struct("goals_for", "team")
    g = t.history().groupBy("match_id").agg(F.max(s)["team"].alias("winner"), F.min(s)["team"].alias("loser"), F.count_distinct("team").alias("n")).where("n > 1")
    return g.select("match_id", F.least("winner", "loser").alias("a"), F.greatest("winner", "loser").alias("b"), (F.col("winner") <= F.col("loser")).cast("int").alias("a_won"))


@query("x3_nearest_run_within_window", "ticks", """
, r as (select tick_id as run_id, entity, ts from ticks where source = 'error'), x as (select t.tick_id, r.run_id, abs(epoch_us(t.ts) - epoch_us(r.ts)) as gap from ticks t join r using (entity) where t.source = 'purchase' and abs(epoch_us(t.ts) - epoch_us(r.ts)) <= 36 * 3600000000)
select t.tick_id, (select arg_min(run_id, (gap, run_id)) from x where x.tick_id = t.tick_id) as run_id from ticks t where t.source = 'purchase'""")
def nearest_run(t):
    """The nearest run on either side, from the last one before and the first one after: two window reads, no range join."""
    runs, asks = t.ticks().where("source = 'error'"), t.ticks().where("source = 'purchase'")
    both = asks.select("tick_id", "entity", "ts", F.lit(None).cast("struct<ts:timestamp_ntz,id:bigint>").alias("r")).unionByName(
        runs.select(F.lit(None).cast("long").alias("tick_id"), "entity", "ts", F.struct("ts", F.col("tick_id").alias("id")).alias("r"))
    )
    w = W.partitionBy("entity").orderBy("ts")
    back, ahead = F.last("r", ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, 0)), F.first("r", ignorenulls=True).over(w.rangeBetween(0, W.unboundedFollowing))
    near = both.withColumn("back", back).withColumn("ahead", ahead).where("tick_id is not null")
    gap = lambda c: F.abs(T.micros("ts") - T.micros(F.col(c)["ts"]))
    option = lambda c: F.when(gap(c) <= 36 * 3_600_000_000, F.struct(gap(c).alias("gap"), F.col(c)["id"].alias("id")))
    return near.select("tick_id", F.least(option("back"), option("ahead"))["id"].alias("run_id"))


@query("x8_band_sigma_lookup", "bets", """
, s as (select case when p >= 0.5 then 1 else 0 end as b, stddev_pop(y) / sqrt(count(*)) as se from bets group by 1) select bet_id, round(sqrt(se * se + 0.0025), 6) as sigma from bets join s on s.b = case when p >= 0.5 then 1 else 0 end""")
def sigma(t):
    b = t.bets().withColumn("b", band(F.col("p"), [0.0, 0.5]))
    se = b.groupBy("b").agg((F.stddev_pop("y") / F.sqrt(F.count(F.lit(1)))).alias("se"))  # a row a band
    return rounded(b.join(F.broadcast(se), "b").select("bet_id", F.sqrt(F.col("se") * F.col("se") + 0.0025).alias("sigma")))


@query("x19_market_types", "", """
select case when regexp_matches(p_type, '(match.?odds|1x2|moneyline)', 'i') then 'RESULT' when regexp_matches(p_type, '(over|under|total)', 'i') then 'TOTALS' when regexp_matches(p_type, 'handicap', 'i') then 'HANDICAP' else 'OTHER' end as family, p_brand, count(*) as n from part group by all""")
def types(t):
    return t.read("part").groupBy(market_family(F.col("p_type")).alias("family"), "p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("x20_simulated_scan_time", "starts", "select start_id, start_ts - interval 60 minute as scan_ts from starts")
def scan_time(t):
    return t.starts().select("start_id", (F.col("start_ts") - F.expr("INTERVAL 60 MINUTES")).alias("scan_ts"))


@query("x24_ledger_union", "", """
select 'order' as ledger, o_orderkey as id, o_totalprice as amount from orders union all select 'customer', c_custkey, c_acctbal from customer union all select 'supplier', s_suppkey, s_acctbal from supplier""")
def ledgers(t):
    of = lambda name, id_, amount, table: t.read(table).select(F.lit(name).alias("ledger"), F.col(id_).alias("id"), F.col(amount).alias("amount"))
    return of("order", "o_orderkey", "o_totalprice", "orders").unionByName(of("customer", "c_custkey", "c_acctbal", "customer")).unionByName(of("supplier", "s_suppkey", "s_acctbal", "supplier"))


@query("a26_signed_residual", "history", """
, m as (select team, (goals_for - round(goals_against))::int as d from history) select team, round(avg(case when d > 0 then 1.0 else 0.0 end - 0.5) filter (d <> 0), 6) as residual, count(*) filter (d <> 0) as n from m group by team""")
def residual(t):
    d = (F.col("goals_for") - F.round("goals_against")).cast("int")
    clean = t.history().select("team", d.alias("d")).where("d <> 0")
    teams = t.history().select("team").distinct()
    got = clean.groupBy("team").agg(F.avg(F.when(F.col("d") > 0, 0.5).otherwise(-0.5)).alias("residual"), F.count(F.lit(1)).alias("n"))
    return rounded(teams.join(got, "team", "left").select("team", "residual", F.coalesce("n", F.lit(0)).alias("n")))


@query("a41_baseline_accuracy", "bets", """
, b as (select sport, avg(y) as base from bets where season < 1999 group by sport) select sport, round(any_value(base), 6) as base, round(avg((y = (base >= 0.5)::int)::int), 6) as base_accuracy, round(avg((y = (p >= 0.5)::int)::int), 6) as accuracy from bets join b using (sport) where season >= 1999 group by sport""")
def baseline(t):
    b = t.bets()
    base = b.where("season < 1999").groupBy("sport").agg(F.avg("y").alias("base"))
    right = lambda c: F.avg((F.col("y") == (c >= 0.5).cast("int")).cast("int"))
    return rounded(b.where("season >= 1999").join(base, "sport").groupBy("sport").agg(F.first("base").alias("base"), right(F.col("base")).alias("base_accuracy"), right(F.col("p")).alias("accuracy")))


@query("g13_eligibility_by_start", "ticks", """
, s as (select entity, max(ts) as start_ts, count(distinct source) as n from ticks group by entity)
select t.tick_id, case when n < 5 then 'CONFLICT' when t.price > 100 then 'INVALID' when t.ts >= start_ts then 'STARTED' else 'ELIGIBLE' end as reason from ticks t join s using (entity)""")
def eligibility(t):
    w = t.ticks().groupBy("entity").agg(F.max("ts").alias("start_ts"), F.count_distinct("source").alias("n"))
    reason = F.when(F.col("n") < 5, "CONFLICT").when(F.col("price") > 100, "INVALID").when(F.col("ts") >= F.col("start_ts"), "STARTED").otherwise("ELIGIBLE")
    return t.ticks().join(w, "entity").select("tick_id", reason.alias("reason"))


@query("g15_two_way_quality", "quotes", """
, w as (select market, book, max(odds) filter (outcome = 'A') as a, max(odds) filter (outcome = 'R') as b from quotes group by all)
select market, book, a is not null and b is not null and a >= 1.1 and b >= 1.1 and 1 / a + 1 / b between 0.9 and 1.3 as valid, round(2 / (1 / a + 1 / b), 6) as mid from w""")
def two_way(t):
    of = lambda o: F.max(F.when(F.col("outcome") == o, F.col("odds")))
    w = t.quotes().groupBy("market", "book").agg(of("A").alias("a"), of("R").alias("b"))
    inverse = 1 / F.col("a") + 1 / F.col("b")
    valid = F.coalesce((F.col("a") >= 1.1) & (F.col("b") >= 1.1) & inverse.between(0.9, 1.3), F.lit(False))
    return rounded(w.select("market", "book", valid.alias("valid"), (2 / inverse).alias("mid")))


@query("g16_verdict", "bets", """
, s as (select sport, season, avg(y - p) as gap from bets group by all) select sport, case when bool_and(gap > 0) or bool_and(gap < 0) then 'STABLE' when count(*) < 3 then 'TOO_FEW' else 'UNSTABLE' end as verdict from s group by sport""")
def verdict(t):
    s = t.bets().groupBy("sport", "season").agg(F.avg(F.col("y") - F.col("p")).alias("gap"))
    return s.groupBy("sport").agg(F.when(F.bool_and(F.col("gap") > 0) | F.bool_and(F.col("gap") < 0), "STABLE").when(F.count(F.lit(1)) < 3, "TOO_FEW").otherwise("UNSTABLE").alias("verdict"))


@query("d6_linkage_audit_by_distance", "", """
with d as (select distinct o_custkey, o_orderdate::date as day from orders), n as (select o_custkey, least(day - lag(day) over w, lead(day) over w - day)::int as gap from d window w as (partition by o_custkey order by day))
select case when gap is null then 'ALONE' when gap <= 7 then 'WEEK' when gap <= 30 then 'MONTH' else 'FAR' end as distance, count(*) as n from n group by 1""")
def link_audit(t):
    d = T.nearest_other_day(t.read("orders").withColumn("day", F.to_date("o_orderdate")), "o_custkey", "day")
    label = F.when(F.col("nearest").isNull(), "ALONE").when(F.col("nearest") <= 7, "WEEK").when(F.col("nearest") <= 30, "MONTH").otherwise("FAR")
    return d.groupBy(label.alias("distance")).agg(F.count(F.lit(1)).alias("n"))


@query("d8_resolution_summary", "bets", """
, s as (select sport, case when y = 1 then 'WON' else 'LOST' end as status from bets) select sport, status, count(*) as n from s group by grouping sets ((sport, status), (sport), ())""")
def summary(t):
    s = t.bets().select("sport", F.when(F.col("y") == 1, "WON").otherwise("LOST").alias("status"))
    return s.groupingSets([["sport", "status"], ["sport"], []], "sport", "status").agg(F.count(F.lit(1)).alias("n"))
