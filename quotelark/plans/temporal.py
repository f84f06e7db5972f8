"""Queries on joins in time, linkage, sets and audits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotelark.functions import text as X
from quotelark.operators import gates as G
from quotelark.operators import metrics as M
from quotelark.operators import temporal as T
from quotelark.plans.registry import query, rounded

HOURS = [24.0, 12.0, 1.0]
ASOF = """, a as (select entity, start_id, start_ts, h::double as hours_before, start_ts - to_microseconds((h * 3600000000)::bigint) as cutoff from starts, (values (24), (12), (1)) v(h)),
j as (select a.*, (select max((ts, tick_id)) from ticks k where k.entity = a.entity and k.ts <= a.cutoff) as m from a),
p as (select j.*, k.price, k.ts from j left join ticks k on k.tick_id = m[2])"""


def _priced(t):
    asks = T.horizons(t.starts().select("entity", "start_id", "start_ts"), "start_ts", HOURS)
    return T.as_of(asks, t.ticks(), "entity", "cutoff", "ts", ["price"], "tick_id")


@query("j3_as_of_at_horizons", "ticks starts", ASOF + "select entity, start_id, hours_before, ts as as_of_ts, price as as_of_price from p")
def as_of(t):
    return _priced(t).select("entity", "start_id", "hours_before", "as_of_ts", "as_of_price")


@query("a40_coverage_by_horizon", "ticks starts", ASOF + """
, g as (select *, (epoch_us(cutoff) - epoch_us(ts)) / 3.6e9::double as age from p)
select hours_before, count(*) as asked, round(avg((ts is not null)::int), 6) as raw_share, round(avg((ts is not null and age <= 12)::int), 6) as fresh_share, round(median(age), 6) as median_age from g group by hours_before""")
def coverage(t):
    return rounded(T.coverage(_priced(t), 12.0))


@query("j5_last_in_interval", "ticks starts", """
, j as (select s.*, (select max((ts, tick_id)) from ticks k where k.entity = s.entity and k.ts > s.entry_ts and k.ts < s.start_ts) as m from starts s)
select j.entity, start_id, k.ts as last_ts, k.price as last_price from j left join ticks k on k.tick_id = m[2]""")
def in_interval(t):
    return T.last_in_interval(t.starts(), t.ticks(), "entity", "entry_ts", "start_ts", "ts", "price", "tick_id").select("entity", "start_id", "last_ts", "last_price")


@query("j6_latest_or_conflict", "ticks", """
, d as (select entity, date_trunc('day', ts) as day, source from ticks), l as (select entity, max(day) as latest from d group by entity),
g as (select d.entity, l.latest, count(distinct source) as n, max(source) as v from d join l on d.entity = l.entity and d.day = l.latest group by all)
select entity, latest, case when n = 1 then v end as source, case when n > 1 then 'CONFLICT' else 'OK' end as status from g""")
def latest(t):
    return T.latest_or_conflict(t.ticks().withColumn("day", F.date_trunc("day", "ts")), "entity", "day", "source")


@query("g7_best_of_latest", "ticks", """
, d as (select *, date_trunc('day', ts) as day from ticks), m as (select *, max(day) over (partition by entity) as m from d)
select entity, tick_id, price from (select *, row_number() over (partition by entity order by price desc, tick_id) as r from m where day = m) where r = 1""")
def best_latest(t):
    return G.best_of_latest(t.ticks().withColumn("day", F.date_trunc("day", "ts")), "entity", "day", "price", "tick_id").select("entity", "tick_id", "price")


@query("g8_due_window", "ticks", """
select tick_id from ticks where ts > timestamp '2024-01-10 00:00:00' and ts <= timestamp '2024-01-12 00:00:00' and entity not in (select entity from ticks where source = 'error' and price > 90)""")
def due(t):
    done = t.ticks().where("source = 'error' and price > 90").select("entity").distinct()
    return G.due(t.ticks(), done, "entity", "ts", F.to_timestamp(F.lit("2024-01-10 00:00:00")), 2880).select("tick_id")


@query("j7_linkage_with_status", "", """
with o as (select o_orderkey as left_id, o_custkey as key, o_orderdate::date as day from orders where o_orderstatus = 'F'), r as (select o_orderkey as right_id, o_custkey as key, o_orderdate::date as day from orders where o_orderstatus <> 'F'),
n as (select left_id, count(distinct right_id) as n, min(right_id) as m from o join r on o.key = r.key and abs(o.day - r.day) <= 30 group by left_id)
select o.left_id, coalesce(n, 0) as candidates, case when n = 1 then 'MATCHED' when n > 1 then 'AMBIGUOUS' else 'UNMATCHED' end as status, case when n = 1 then m end as match from o left join n using (left_id)""")
def linkage(t):
    o = t.read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    left, right = o.where("o_orderstatus = 'F'").select(F.col("id").alias("left_id"), "key", "day"), o.where("o_orderstatus <> 'F'").select(F.col("id").alias("right_id"), "key", F.col("day").alias("other_day"))
    return T.link_within(left, right, "key", "day", "other_day", 30, "left_id", "right_id").select("left_id", "candidates", "status", "match")


@query("j14_nearest_other_day", "history", """
, d as (select distinct team, day from history) select team, day, least(day - lag(day) over (partition by team order by day), lead(day) over (partition by team order by day) - day)::int as nearest from d""")
def nearest(t):
    return T.nearest_other_day(t.history(), "team", "day")


@query("j15_enrichment_left_joins", "", """
select c.c_custkey, n.n_name as nation, r.r_name as region, count(o.o_orderkey) as orders, round(coalesce(sum(o.o_totalprice), 0), 2) as total
from customer c left join nation n on c.c_nationkey = n.n_nationkey left join region r on n.n_regionkey = r.r_regionkey left join orders o on o.o_custkey = c.c_custkey group by all""")
def enrichment(t):
    per = t.read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("total"))  # summed before the join
    c = t.read("customer").join(t.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return c.join(per, "c_custkey", "left").select("c_custkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("j26_anti_join", "", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderdate >= timestamp '1998-01-01')")
def anti(t):
    recent = t.read("orders").where(F.col("o_orderdate") >= F.to_timestamp(F.lit("1998-01-01"))).select(F.col("o_custkey").alias("c_custkey"))
    return t.read("customer").select("c_custkey").join(recent, "c_custkey", "left_anti")


@query("u1_u2_set_operations", "", """
with a as (select distinct l_suppkey as k from lineitem where l_returnflag = 'A'), r as (select distinct l_suppkey as k from lineitem where l_returnflag = 'R' and l_discount > 0.05)
select 'both' as part, count(*) as n from (select k from a intersect select k from r) union all select 'either', count(*) from (select k from a union select k from r) union all select 'only_a', count(*) from (select k from a except select k from r)""")
def sets(t):
    li = t.read("lineitem")
    a, r = li.where("l_returnflag = 'A'").select("l_suppkey").distinct(), li.where("l_returnflag = 'R' and l_discount > 0.05").select("l_suppkey").distinct()
    part = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return part("both", a.intersect(r)).union(part("either", a.union(r).distinct())).union(part("only_a", a.exceptAll(r)))


@query("u3_duplicate_classification", "", """
with d as (select o_custkey, o_orderdate::date as day, count(*) as n, count(distinct o_totalprice) as prices, count(distinct o_orderstatus) as states from orders group by all having count(*) > 1)
select o_custkey, day, n, case when prices = 1 and states = 1 then 'EXACT' when prices = 1 then 'CONFLICTING' when states = 1 then 'POSSIBLE_RESCHEDULE' else 'MANUAL_REVIEW' end as kind from d""")
def duplicates(t):
    d = t.read("orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_totalprice").alias("prices"), F.count_distinct("o_orderstatus").alias("states")).where("n > 1")
    same_price, same_state = F.col("prices") == 1, F.col("states") == 1
    return d.select("o_custkey", "day", "n", F.when(same_price & same_state, "EXACT").when(same_price, "CONFLICTING").when(same_state, "POSSIBLE_RESCHEDULE").otherwise("MANUAL_REVIEW").alias("kind"))


@query("d1_table_audit", "", """
with c as (select year(l_shipdate)::int as season, count(*) as n, count(*) filter (l_quantity <= 0) as bad_quantity, count(*) filter (l_discount > 0.09) as high_discount, count(*) filter (l_shipdate is null) as missing_date, count(*) - count(distinct (l_orderkey, l_linenumber)) as repeated_keys from lineitem group by 1)
select season, rule, hits from c unpivot (hits for rule in (n, bad_quantity, high_discount, missing_date, repeated_keys))""")
def audit(t):
    li = t.read("lineitem")
    per = li.groupBy(F.year("l_shipdate").alias("season")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") <= 0).alias("bad_quantity"), F.count_if(F.col("l_discount") > 0.09).alias("high_discount"), F.count_if(F.col("l_shipdate").isNull()).alias("missing_date"), (F.count(F.lit(1)) - F.count_distinct("l_orderkey", "l_linenumber")).alias("repeated_keys"))
    return per.unpivot(["season"], ["n", "bad_quantity", "high_discount", "missing_date", "repeated_keys"], "rule", "hits")


@query("d4_z_scores", "", """
with s as (select l_suppkey, year(l_shipdate)::int as season, avg(l_quantity) as m from lineitem group by all) select l_suppkey, season, round((m - avg(m) over w) / nullif(stddev_samp(m) over w, 0), 5) as z from s window w as (partition by season)""")
def z_scores(t):
    s = t.read("lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("season")).agg(F.avg("l_quantity").alias("m"))
    of = s.groupBy("season").agg(F.avg("m").alias("mean"), F.nullif(F.stddev_samp("m"), F.lit(0.0)).alias("spread"))  # a row a season
    return s.join(F.broadcast(of), "season").select("l_suppkey", "season", (F.round((F.col("m") - F.col("mean")) / F.col("spread"), 5) + 0.0).alias("z"))


@query("p11_name_folding", "", """
with n as (select s_suppkey, lower(replace(replace(s_name, '#', ' '), '-', ' ')) as name from supplier)
select s_suppkey, name as folded, split_part(name, ' ', 2) || ' ' || substr(name, 1, 1) || '.' as initialled, split_part(name, ' ', 2) || ', ' || split_part(name, ' ', 1) as reversed from n""")
def folding(t):
    forms = X.name_forms(F.regexp_replace("s_name", "#", "-"))
    return t.read("supplier").select("s_suppkey", forms[0].alias("folded"), forms[1].alias("initialled"), forms[2].alias("reversed"))


@query("s4_p22_nested_json", "ticks", """
select tick_id, (props::json->>'k')::int as k, '{"entity":' || entity || ',"k":' || (props::json->>'k') || '}' as packed from ticks""")
def nested(t):
    k = F.get_json_object("props", "$.k").cast("int")
    entries = F.array(F.struct(F.lit("k").alias("key"), k.cast("long").alias("value")), F.struct(F.lit("entity").alias("key"), F.col("entity").alias("value")))
    return t.ticks().select("tick_id", k.alias("k"), X.sorted_json(entries).alias("packed"))


@query("q8_calendar_counters", "ticks", """
select source, date_trunc('day', ts) as day, count(*) as n, round(sum(price), 4) as total from ticks group by all""")
def calendar(t):
    w = t.ticks().groupBy("source", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 4).alias("total"))
    return w.select("source", F.col("w.start").alias("day"), "n", "total")


@query("a37_usage_accounting", "ticks", """
, d as (select entity, date_trunc('day', ts) as day, sum(price) as used from ticks group by all)
select entity, day, round(sum(used) over (partition by entity, date_trunc('month', day) order by day rows unbounded preceding), 4) as month_to_date from d""")
def usage(t):
    d = t.ticks().groupBy("entity", F.date_trunc("day", "ts").alias("day")).agg(F.sum("price").alias("used"))
    w = W.partitionBy("entity", F.date_trunc("month", "day")).orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return d.select("entity", "day", F.round(F.sum("used").over(w), 4).alias("month_to_date"))


@query("a38_availability_quantiles", "ticks", """
select source, count(*) as n, round(quantile_cont(price, 0.1), 6) as q10, round(quantile_cont(price, 0.5), 6) as q50, round(quantile_cont(price, 0.9), 6) as q90, round(avg((price > 50)::int), 6) as above from ticks group by source""")
def availability(t):
    sums = t.ticks().groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("price") > 50).cast("int")).alias("above"))
    got = sums.join(M.percentiles(t.ticks(), ["source"], "price", [0.1, 0.5, 0.9]), "source")
    return rounded(got.select("source", "n", F.col("q")[0].alias("q10"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q90"), "above"))


@query("x25_match_volume", "history", """
, d as (select distinct league, day from history) select a.league, count(*) as days, count(*) filter (exists (select 1 from d b where b.league = a.league and b.day - a.day between 1 and 2)) as followed from d a group by a.league""")
def volume(t):
    d = t.history().select("league", "day").distinct()
    gap = F.datediff(F.lead("day").over(W.partitionBy("league").orderBy("day")), "day")
    return d.withColumn("gap", gap).groupBy("league").agg(F.count(F.lit(1)).alias("days"), F.count_if(F.col("gap") <= 2).alias("followed"))
