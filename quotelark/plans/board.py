"""Board, card, linkage and settlement queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotelark.functions.odds import two_way_reference
from quotelark.functions.text import book_width, nullable_int
from quotelark.operators import board as B
from quotelark.operators import gates as G
from quotelark.operators.consensus import consensus, fair_by_book
from quotelark.plans.registry import query, rounded
from quotelark.scratch import new_path
from quotelark.sinks.ledger import append_unique, read

OUT = ("A", "N", "R")


@query("g3_ordered_grade_ladder", "bets", """
, b as (select sport, event, count(distinct team) as books, stddev_pop(p) as std from bets group by all),
e as (select bet_id, p, odds, books, std, p * odds - 1 as ev, (p - 1 / odds) * 100 as edge, date_diff('day', min(day) over (partition by t.event), day) > 2000 as risk from bets t join b using (sport, event))
select bet_id, case when books < 2 or odds <= 1.05 or p <= 0.0 or p >= 1.0 or odds > 3.5 then 'Reject' when ev < 0 then 'Reject' when ev < 0.02 then 'C'
  when ev >= 0.08 and edge >= 4 and books >= 5 and not risk then 'A+' when ev >= 0.05 and edge >= 3 and books >= 4 and not risk then 'A' else 'B' end as grade,
  list_filter([case when odds > 3.5 then 'STALE_PRICE' end, case when p <= 0.0 or p >= 1.0 then 'RULES_DIFFER' end, case when odds <= 1.05 then 'ILLIQUID' end, case when books < 2 then 'DATA_QUALITY' end], lambda x: x is not null)::varchar as hard from e""")
def ladder(t):
    """Four hard gates (each stands in for its flag), then the ladder by net EV, edge in percentage points, books and information risk."""
    b = t.bets()
    spread = b.groupBy("sport", "event").agg(F.count_distinct("team").alias("books"), F.stddev_pop("p").alias("std"))
    e = b.join(spread, ["sport", "event"]).withColumn("ev", F.col("p") * F.col("odds") - 1).withColumn("edge", (F.col("p") - 1 / F.col("odds")) * 100).withColumn("risk", F.datediff("day", F.min("day").over(W.partitionBy("event"))))
    c = F.col
    hard = {"STALE_PRICE": c("odds") > 3.5, "RULES_DIFFER": (c("p") <= 0) | (c("p") >= 1), "ILLIQUID": c("odds") <= 1.05, "DATA_QUALITY": c("books") < 2}
    return e.select("bet_id", G.grade(c("ev"), c("edge"), c("books"), hard, c("risk") > 2000).alias("grade"), F.concat(F.lit("["), F.concat_ws(", ", G.reasons(hard)), F.lit("]")).alias("hard"))


@query("g2_quality_and_liquidity_labels", "ticks", """
, q as (select entity, ts::date as day, count(distinct source) as books, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0 as age, min(price) as size from ticks group by all)
select entity, day, case when books >= 4 and age <= 720 then 'GOOD' when books >= 2 and age <= 1380 then 'FAIR' else 'POOR' end as quality,
  list_filter([case when books < 4 then 'FEW_BOOKS' end, case when age > 720 then 'OLD_QUOTE' end], lambda x: x is not null)::varchar as reasons, case when size is null then 'UNKNOWN' when size >= 20 then 'LIQUID' else 'THIN' end as liquidity from q""")
def labels(t):
    q = t.ticks().groupBy("entity", F.to_date("ts").alias("day")).agg(F.count_distinct("source").alias("books"), ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 6e7).alias("age"), F.min("price").alias("size"))
    label, why = G.data_quality(F.col("books"), F.col("age"))
    return q.select("entity", "day", label.alias("quality"), F.concat(F.lit("["), F.concat_ws(", ", why), F.lit("]")).alias("reasons"), G.liquidity(F.lit(20.0), F.col("size")).alias("liquidity"))


@query("g6_multi_and_unknown_commission", "bets", """
, c as (select s_suppkey as team, case when n_regionkey > 0 then n_regionkey / 100.0 end as commission from supplier join nation on s_nationkey = n_nationkey),
d as (select b.*, commission, list_filter([case when commission is null then 'COMMISSION_UNKNOWN' end, case when odds > 3 then 'LONG_ODDS' end, case when p < 0.3 then 'LOW_PROBABILITY' end, case when p * (1 + (odds - 1) * (1 - commission)) - 1 < 0 then 'NEGATIVE_EV' end], lambda x: x is not null) as why from bets b join c using (team))
select bet_id, case when list_has_any(why, ['COMMISSION_UNKNOWN', 'NEGATIVE_EV']) then 'REJECT' when why = ['LONG_ODDS'] then 'MULTI' when len(why) > 0 then 'WATCH' else 'PICK' end as decision, len(why)::int as reasons,
  round(p * (1 + (odds - 1) * (1 - commission)) - 1, 6) as net_ev from d""")
def decisions(t):
    """An unknown commission is never taken for 0: the net EV is null and the candidate is rejected."""
    b = t.bets().join(F.broadcast(B.commissions(t.read("supplier"), t.read("nation"))), "team")
    ev = F.col("p") * (1 + (F.col("odds") - 1) * (1 - F.col("commission"))) - 1
    why = G.reasons({"COMMISSION_UNKNOWN": F.col("commission").isNull(), "LONG_ODDS": F.col("odds") > 3, "LOW_PROBABILITY": F.col("p") < 0.3, "NEGATIVE_EV": ev < 0})
    return rounded(b.withColumn("why", why).select("bet_id", G.decide(F.col("why"), ["COMMISSION_UNKNOWN", "NEGATIVE_EV"], multi="LONG_ODDS").alias("decision"), F.size("why").alias("reasons"), ev.alias("net_ev")))


@query("g14_evidence_grade", "bets", """
, s as (select team, count(distinct event) as n from bets group by team), e as (select b.*, case when n >= 55 then 2 when n >= 45 then 1 else 0 end as state from bets b join s using (team))
select bet_id, case when p * odds <= 1 then 'NONE' when (p - 1.645 * 0.03) * odds > 1 and state >= 1 then 'A+' when (p - 0.03) * odds > 1 then 'A' else 'B' end as grade from e""")
def evidence(t):
    """EV at p less its uncertainty, and the evidence that the engine has."""
    n = t.bets().groupBy("team").agg(F.count_distinct("event").alias("n"))
    e = t.bets().join(n, "team").withColumn("state", F.when(F.col("n") >= 55, 2).when(F.col("n") >= 45, 1).otherwise(0))
    return e.select("bet_id", G.evidence_grade(F.col("p"), F.lit(0.03), F.col("odds"), F.col("state"), 1).alias("grade"))


@query("j7_unordered_pair_linkage", "", """
with a as (select o_orderkey as id, least(o_custkey % 20, o_orderkey % 20) as x, greatest(o_custkey % 20, o_orderkey % 20) as y, o_orderdate::date as day from orders where o_orderstatus = 'F'),
b as (select o_orderkey as market, least(o_custkey % 20, o_orderkey % 20) as x, greatest(o_custkey % 20, o_orderkey % 20) as y, o_orderdate::date as day from orders where o_orderstatus = 'P')
select id, count(distinct market) as candidates, case count(distinct market) when 0 then 'UNMATCHED' when 1 then 'MATCHED' else 'AMBIGUOUS' end as status, case when count(distinct market) = 1 then min(market) end as market
from a left join b on a.x = b.x and a.y = b.y and abs(a.day - b.day) <= 20 group by id""")
def pair_linkage(t):
    """Names of both sides in either order, and dates within the tolerance."""
    sides = t.read("orders").select("o_orderstatus", "o_orderkey", (F.col("o_custkey") % 20).alias("a"), (F.col("o_orderkey") % 20).alias("b"), F.to_date("o_orderdate").alias("day"))
    of = lambda s, name: sides.where(F.col("o_orderstatus") == s).select(F.col("o_orderkey").alias(name), "a", "b", "day")
    return B.link_pairs(of("F", "id"), of("P", "market"), "id", "market", ("a", "b"), "day", 20)


@query("j8_abbreviated_names", "", """
with o as (select s_suppkey as id, 'Supplier ' || chr(65 + s_nationkey % 26) || '.' as abbreviated, date '2000-01-01' + s_nationkey as day from supplier),
f as (select n_nationkey as file_id, 'Supplier ' || n_name as full_name, date '2000-01-02' + n_nationkey as day from nation),
c as (select id, file_id, full_name, substr(full_name, 10, 1) = substr(abbreviated, 10, 1) as fits from o left join f on abs(o.day - f.day) <= 3)
select id, count(distinct file_id) filter (fits) as fitting, case when count(file_id) = 0 then 'NO_ROWS_NEAR_DATE' when count(distinct file_id) filter (fits) = 0 then 'NO_NAME_MATCH' when count(distinct file_id) filter (fits) = 1 then 'MATCHED' else 'AMBIGUOUS' end as status from c group by id""")
def abbreviated(t):
    """'Family I.' against full names of rows within three days; every outcome is counted."""
    ours = t.read("supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Supplier "), F.char(65 + F.col("s_nationkey") % 26), F.lit(".")).alias("abbreviated"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("s_nationkey")).alias("day"))
    theirs = t.read("nation").select(F.col("n_nationkey").alias("file_id"), F.concat(F.lit("Supplier "), "n_name").alias("full_name"), F.date_add(F.lit("2000-01-02").cast("date"), F.col("n_nationkey")).alias("day"))
    return B.link_abbreviated(ours, theirs, "id", "file_id", "day", 3)


@query("j9_fixture_results", "", """
with p as (select o_orderkey as id, o_orderpriority as comp, case when c_nationkey >= 5 then c_nationkey end as home, o_orderdate::date as kickoff from orders join customer on o_custkey = c_custkey where o_orderstatus <> 'F'),
r as (select o_orderkey as result_id, o_orderpriority as comp, c_nationkey as home, o_orderdate::date as day from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F')
select id, case when any_value(p.home) is null then 'UNRESOLVED_NAME' when max(kickoff) > date '2001-01-01' then 'NOT_YET' when count(result_id) = 0 then 'NOT_FOUND' when count(result_id) = 1 then 'MATCHED' else 'AMBIGUOUS' end as status,
 case when any_value(p.home) is not null and max(kickoff) <= date '2001-01-01' and count(result_id) = 1 then min(result_id) end as result_id
from p left join r on p.comp = r.comp and p.home = r.home and abs(p.kickoff - r.day) <= 10 group by id""")
def fixture_results(t):
    """Fixtures against results of their competition and aliased home side within the window; the first nations have no alias."""
    o = t.read("orders").join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderstatus", "o_orderkey", F.col("o_orderpriority").alias("comp"), F.col("c_nationkey").alias("raw"), F.to_date("o_orderdate").alias("day"))
    aliases = t.read("nation").where("n_nationkey >= 5").select(F.col("n_nationkey").alias("raw"), F.col("n_nationkey").alias("home"))
    results = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("result_id"), "comp", F.col("raw").alias("home"), "day")
    return B.fixture_results(o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"), "comp", "raw", F.col("day").alias("kickoff")), results, aliases, "2001-01-01", 10)


@query("j16_board_with_selections", "ticks", """
, b as (select entity, date_trunc('day', ts) as scan, max(price) as price, min(tick_id) as first_id from ticks where source = 'view' group by all), s as (select entity, date_trunc('day', ts) as decision_at, max(price) as taken from ticks where source = 'purchase' group by all)
select b.entity, scan, price, taken, taken is not null as selected, row_number() over (partition by b.entity order by scan) = 1 as first_sight from b left join s on s.entity = b.entity and s.decision_at = b.scan""")
def board(t):
    """A selection attaches to the board row of its own decision time only."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    b = t.ticks().where("source = 'view'").groupBy("entity", day.alias("scan")).agg(F.max("price").alias("price"))
    s = t.ticks().where("source = 'purchase'").groupBy("entity", day.alias("scan")).agg(F.max("price").alias("taken"))
    return b.join(s, ["entity", "scan"], "left").select("entity", "scan", "price", "taken", F.col("taken").isNotNull().alias("selected"), (F.row_number().over(W.partitionBy("entity").orderBy("scan")) == 1).alias("first_sight"))


@query("t7_latest_row_likelier_side", "ticks", """
, l as (select *, row_number() over (partition by entity, source order by ts desc, tick_id desc) as r from ticks where ts >= timestamp '2024-01-10')
select entity, source as line, tick_id, case when price - floor(price) >= 0.5 then 'OVER' else 'UNDER' end as side, round(greatest(price - floor(price), 1 - (price - floor(price))), 6) as p from l where r = 1""")
def latest_likelier(t):
    """Inside the window, each event's latest row for each line, with its likelier side."""
    over = F.col("price") - F.floor("price")
    latest = t.ticks().where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).withColumn("r", F.row_number().over(W.partitionBy("entity", "source").orderBy(F.desc("ts"), F.desc("tick_id")))).where("r = 1")
    return rounded(latest.select("entity", F.col("source").alias("line"), "tick_id", F.when(over >= 0.5, "OVER").otherwise("UNDER").alias("side"), F.greatest(over, 1 - over).alias("p")))


@query("t2_grade_first_ranking", "bets", """
, g as (select bet_id, day, p, p * odds - 1 as ev, case when p * odds >= 1.2 then 'A+' when p * odds >= 1.1 then 'A' when p * odds >= 1 then 'B' else 'C' end as grade from bets)
select bet_id, grade, row_number() over (partition by day order by case grade when 'A+' then 0 when 'A' then 1 when 'B' then 2 else 3 end, p desc, ev desc, bet_id) as place from g qualify place <= 20""")
def grade_first(t):
    ev = F.col("p") * F.col("odds") - 1
    g = t.bets().withColumn("ev", ev).withColumn("grade", F.when(F.col("p") * F.col("odds") >= 1.2, "A+").when(F.col("p") * F.col("odds") >= 1.1, "A").when(F.col("p") * F.col("odds") >= 1, "B").otherwise("C"))
    w = W.partitionBy("day").orderBy(B.grade_order("grade"), F.desc("p"), F.desc("ev"), "bet_id")
    return g.withColumn("place", F.row_number().over(w)).where("place <= 20").select("bet_id", "grade", "place")


@query("x1_same_scan_legs", "ticks", """
, p as (select entity, ts::date as scan, max(price - floor(price)) as p, count(distinct event_id_) as n from (select *, tick_id as event_id_ from ticks where source = 'click') group by all),
q as (select tick_id, entity, ts::date as scan, price, ts from ticks where source in ('view', 'purchase'))
select q.tick_id, case when p.p >= 0.5 then 'HOME' else 'AWAY' end as side, round(greatest(p.p, 1 - p.p), 6) as prob,
 list_filter([case when n > 1 then 'WIDE' end, case when date_diff('hour', q.ts::date::timestamp, q.ts) < 6 then 'STALE' end, case when price <= 20 then 'INVALID_ODDS' end], lambda x: x is not null)::varchar as codes from q join p using (entity, scan)""")
def same_scan_legs(t):
    """Each scan's one probability of an event against every quote of the same scan, with quality codes."""
    day = F.to_date("ts").alias("scan")
    p = t.ticks().where("source = 'click'").groupBy("entity", day).agg(F.max(F.col("price") - F.floor("price")).alias("p"), F.count(F.lit(1)).alias("n"))
    q = t.ticks().where("source in ('view', 'purchase')").select("tick_id", "entity", day, "price", "ts")
    codes = G.reasons({"WIDE": F.col("n") > 1, "STALE": F.hour("ts") < 6, "INVALID_ODDS": F.col("price") <= 20})
    return rounded(q.join(p, ["entity", "scan"]).select("tick_id", F.when(F.col("p") >= 0.5, "HOME").otherwise("AWAY").alias("side"), F.greatest(F.col("p"), 1 - F.col("p")).alias("prob"), F.concat(F.lit("["), F.concat_ws(", ", codes), F.lit("]")).alias("codes")))


@query("x2_card_rows_to_predictions", "quotes fair", """
, c as (select market, avg(p) filter (outcome = 'A') as h, avg(p) filter (outcome = 'N') as d, avg(p) filter (outcome = 'R') as a, max(odds) filter (outcome = 'A') as oh, max(odds) filter (outcome = 'N') as od, max(odds) filter (outcome = 'R') as oa from fair group by market),
n as (select market, h / (h + d + a) as h, d / (h + d + a) as d, a / (h + d + a) as a, oh, od, oa from c where abs(h + d + a - 1) <= 0.02)
select market, s as selection, round(case s when '1' then h when 'X' then d when '2' then a when '1X' then h + d when 'X2' then d + a else h + a end, 6) as p,
 round(case s when '1' then oh when 'X' then od when '2' then oa when '1X' then 1 / (1 / oh + 1 / od) when 'X2' then 1 / (1 / od + 1 / oa) else 1 / (1 / oh + 1 / oa) end, 6) as price from n, (select unnest(['1', 'X', '2', '1X', 'X2', '12']) as s)""")
def predictions(t):
    """Complete triplets, normalised, with the double chances derived from them."""
    f = fair_by_book(t.quotes(), OUT).groupBy("market", "outcome").agg(F.avg("p").alias("p"), F.max("odds").alias("odds"))
    return rounded(B.double_chances(f, "market", OUT, 0.02))


@query("x4_contract_violations", "bets", """
select bet_id, list_filter([case when p < 0.1 or p > 0.9 then 'PROBABILITY' end, case when odds <= 1.5 then 'PRICE' end, case when day < date '1995-06-01' then 'TIME' end, case when team is null then 'ENGINE' end], lambda x: x is not null)::varchar as violations from bets""")
def violations(t):
    why = G.reasons({"PROBABILITY": (F.col("p") < 0.1) | (F.col("p") > 0.9), "PRICE": F.col("odds") <= 1.5, "TIME": F.col("day") < F.lit("1995-06-01").cast("date"), "ENGINE": F.col("team").isNull()})
    return t.bets().select("bet_id", F.concat(F.lit("["), F.concat_ws(", ", why), F.lit("]")).alias("violations"))


@query("x5_recorded_candidates", "bets", """
, g as (select event || '::' || sport as id, max(p * odds) as v, min(day) as day from bets group by 1) select id, case when v >= 2.5 then 'A+' when v >= 2 then 'A' else 'B' end as grade, day as first_day from g where v >= 1.5""")
def recorded(t):
    """Grades A+, A and B under market::selection; ids that the ledger has are skipped."""
    b = t.bets().groupBy(F.concat_ws("::", F.col("event").cast("string"), "sport").alias("id")).agg(F.max(F.col("p") * F.col("odds")).alias("v"), F.min("day").alias("first_day"))
    g = b.select("id", F.when(F.col("v") >= 2.5, "A+").when(F.col("v") >= 2, "A").when(F.col("v") >= 1.5, "B").otherwise("C").alias("grade"), "first_day")
    path = new_path(t.spark)
    for _ in range(2):
        append_unique(g.where("grade in ('A+', 'A', 'B')"), path, ["id"], ["first_day"])
    return read(t.spark, path, g.schema)


@query("x6_settled_bankroll", "bets", """
, d as (select day, sum(profit) as pnl, count(*) as n from bets where season >= 1996 group by day) select day, n, round(1000 + sum(pnl) over (order by day), 4) as bankroll from d""")
def bankroll(t):
    """Pending bets settled by their event's completed score; the bankroll runs over days, summed by day first."""
    d = t.bets().where("season >= 1996").groupBy("day").agg(F.sum("profit").alias("pnl"), F.count(F.lit(1)).alias("n"))
    return rounded(d.select("day", "n", (1000 + F.sum("pnl").over(W.orderBy("day"))).alias("bankroll")), 4)  # a row a day


@query("x7_price_status", "ticks", """
, l as (select entity, max(ts::date) as d from ticks group by entity), s as (select t.entity, count(*) filter (source <> 'signup') as quotes, count(*) filter (source <> 'signup' and price > 30) as clean, max(price) filter (source <> 'signup' and price > 30) as best from ticks t join l on l.entity = t.entity and t.ts::date = l.d group by t.entity)
select entity, quotes, clean, best, case when quotes = 0 then 'UNAVAILABLE' when clean = 0 then 'QUALITY_FAIL' when best < 100 then 'POOR_PAYOUT' else 'VALID' end as status from s""")
def price_status(t):
    """Of the latest snapshot only: how many quotes, how many clean, the best clean one."""
    latest = t.ticks().withColumn("d", F.to_date("ts")).withColumn("m", F.max(F.to_date("ts")).over(W.partitionBy("entity"))).where("d = m")
    real = F.col("source") != "signup"
    s = latest.groupBy("entity").agg(F.count_if(real).alias("quotes"), F.count_if(real & (F.col("price") > 30)).alias("clean"), F.max(F.when(real & (F.col("price") > 30), F.col("price"))).alias("best"))
    return s.select("*", F.when(F.col("quotes") == 0, "UNAVAILABLE").when(F.col("clean") == 0, "QUALITY_FAIL").when(F.col("best") < 100, "POOR_PAYOUT").otherwise("VALID").alias("status"))


@query("x9_best_net_price", "quotes", """
, c as (select s_suppkey as book, case when n_regionkey > 0 then n_regionkey / 100.0 end as commission from supplier join nation on s_nationkey = n_nationkey), n as (select market, outcome, book, 1 + (odds - 1) * (1 - commission) as net from quotes join c using (book) where commission is not null and odds > 1.1)
select market, outcome, round(max(net), 6) as net, arg_max(book, (net, -book)) as book, round(0.4 * max(net) - 1, 6) as ev, round(0.35 * max(net) - 1, 6) as ev_low from n group by all""")
def net_price(t):
    c = B.commissions(t.read("supplier"), t.read("nation")).withColumnRenamed("team", "book")
    return rounded(B.best_net(t.quotes().join(F.broadcast(c), "book"), 0.4, 0.35, 1.1))


@query("x10_devig_comparison", "quotes fair", """
, m as (select market, outcome, median(p) as frozen, count(*) as books from fair group by all), a as (select q.market, q.book, q.outcome, 1 / q.odds - (w.s - 1) / 3 as p from quotes q join whole w using (market, book)), x as (select market, outcome, median(p) as other from a group by all)
select market, outcome, books, round(frozen, 6) as frozen, round(other, 6) as other, round(other - frozen, 6) as gap from m join x using (market, outcome)""")
def devig_rows(t):
    """The frozen consensus beside that of another method, complete books only."""
    of = lambda method, name: consensus(fair_by_book(t.quotes(), OUT, method)).select("market", "outcome", F.col("median_p").alias(name), *(["books"] if name == "frozen" else []))
    both = of("proportional", "frozen").join(of("additive", "other"), ["market", "outcome"])
    return rounded(both.select("market", "outcome", "books", "frozen", "other", (F.col("other") - F.col("frozen")).alias("gap")))


@query("x13_board_benchmark", "quotes fair", """
, c as (select market, outcome, median(p) as bench, count(*) as n from fair group by all having count(*) >= 2), q as (select market, outcome, max(odds) as best, median(odds) as mid, 0.25 + 0.5 * avg(1 / odds) as p from quotes group by all)
select market, outcome, best, round(mid, 6) as mid, round(p * best - 1, 6) as ev, round((p - 0.05) * best - 1, 6) as ev_low, round((p + 0.05) * best - 1, 6) as ev_high,
 case when bench is null then 'NO_BENCHMARK' when abs(p - bench) < 0.03 then 'AGREES' when abs(p - bench) < 0.08 then 'MILD' else 'INVESTIGATE' end as flag,
 case when (p - 0.05) * best > 1 then 'STRONG' when p * best > 1 then 'POSITIVE' else 'NEGATIVE' end as label from q left join c using (market, outcome)""")
def benchmark(t):
    q = t.quotes().groupBy("market", "outcome").agg(F.max("odds").alias("best"), F.median("odds").alias("mid"), (0.25 + 0.5 * F.avg(1 / F.col("odds"))).alias("p"))
    bench = consensus(fair_by_book(t.quotes(), OUT), 2).select("market", "outcome", F.col("median_p").alias("bench"))
    return rounded(B.against_benchmark(q.join(bench, ["market", "outcome"], "left"), 0.05))


@query("x28_consistent_rows", "history", """
select team, match_id, case when goals_for > goals_against then 'W' when goals_for < goals_against then 'L' else 'D' end as letter, goals_for > 0 and goals_against > 0 as both_known from history where (goals_for > goals_against) = (goals_for - goals_against > 0) and goals_against > 0""")
def consistent(t):
    letter = F.when(F.col("goals_for") > F.col("goals_against"), "W").when(F.col("goals_for") < F.col("goals_against"), "L").otherwise("D")
    return t.history().withColumn("letter", letter).where(B.result_agrees("letter", "goals_for", "goals_against") & (F.col("goals_against") > 0)).select("team", "match_id", "letter", ((F.col("goals_for") > 0) & (F.col("goals_against") > 0)).alias("both_known"))


@query("w11_shrunken_prior_rate", "history", """
, d as (select league, team, day, sum(goals_against) as s, count(*) as n from history group by all), l as (select league, day, sum(sum(s)) over w / sum(sum(n)) over w as base from d group by league, day window w as (partition by league order by day rows between unbounded preceding and 1 preceding)),
r as (select team, league, day, sum(s) over w as s, sum(n) over w as n from d window w as (partition by team order by day rows between unbounded preceding and 1 preceding))
select team, day, round((coalesce(s, 0) + 10 * base) / (coalesce(n, 0) + 10), 6) as rate from r join l using (league, day)""")
def referee(t):
    """(prior sum + K x league) / (prior n + K), both over strictly earlier days; the league's sums are taken by day first."""
    return rounded(B.shrunken_prior(t.history(teams_together=True), "team", "league", "day", "goals_against", 10.0))


@query("p14_p15_p23_text_and_reference", "", """
with e as (select event_id, value, event_type, 'R1 ' || round(value, 2) || '/' || round(value * 1.1, 2) || '; R2 2.0/2.5' as raw, case event_type when 'error' then '-3' when 'view' then ' 7 ' when 'click' then 'x' else (event_id % 9)::varchar end as text from events)
select event_id, case when event_type = 'error' then null else round(greatest(1 / round(value, 2) - 1 / round(value * 1.1, 2), 1 / 2.0 - 1 / 2.5), 6) end as width,
 case when value > 2 and value < 200 then round((1 / value) / (1 / value + 1 / (value + 1)), 6) end as reference, case event_type when 'error' then null when 'view' then 7 when 'click' then null else (event_id % 9)::int end as parsed from e""")
def texts(t):
    """Book width from a text of back/lay prices, a two-way reference probability, and a number that may be blank or negative."""
    e = t.read("events")
    first = F.concat(F.lit("R1 "), F.round("value", 2).cast("string"), F.lit("/"), F.round(F.col("value") * 1.1, 2).cast("string"), F.lit("; "))
    raw = F.when(~F.col("event_type").eqNullSafe("error"), F.concat(F.coalesce(first, F.lit("")), F.lit("R2 2.0/2.5")))
    text = F.when(F.col("event_type") == "error", "-3").when(F.col("event_type") == "view", " 7 ").when(F.col("event_type") == "click", "x").otherwise((F.col("event_id") % 9).cast("string"))
    inside = (F.col("value") > 2) & (F.col("value") < 200)
    return rounded(e.select("event_id", book_width(raw).alias("width"), F.when(inside, two_way_reference(F.col("value"), F.col("value") + 1)).alias("reference"), nullable_int(text).alias("parsed")))


@query("p19_signed_orientation", "history", """
select team, match_id, round(case when goals_for > 25 then goals_against when goals_for < 20 then -goals_against else -abs(goals_against) end, 6) as oriented, case when goals_for > 25 then 'HOME' when goals_for < 20 then 'AWAY' else 'DRAW' end as side from history""")
def oriented(t):
    """Home keeps a feature's sign, away turns it, a draw is minus its size."""
    side = F.when(F.col("goals_for") > 25, "HOME").when(F.col("goals_for") < 20, "AWAY").otherwise("DRAW")
    return rounded(t.history().withColumn("side", side).select("team", "match_id", B.oriented("side", "goals_against").alias("oriented"), "side"))


@query("j10_derived_aliases")
def aliases(t):
    """Names of one source from the other's, by the slots that their fixtures share."""
    o = t.read("orders").join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select(F.col("o_orderpriority").alias("comp"), F.to_date("o_orderdate").alias("slot"), F.col("c_nationkey").alias("team"), F.concat(F.lit("T"), (F.col("c_nationkey") * 7 % 25).cast("string")).alias("name"), "o_orderstatus")
    return B.derive_aliases(rows.where("o_orderstatus = 'F'"), rows, "comp", "slot", "team", "name")
