"""Research studies as compositions of the operators."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotelark.operators import combos as K
from quotelark.operators import history as H
from quotelark.operators import metrics as M
from quotelark.operators import temporal as T
from quotelark.operators.consensus import fair_by_book
from quotelark.plans.registry import query, rounded

OUT = ("A", "N", "R")


@query("x14_structures_per_leg_set", "bets", """
, t as (select day, p * odds as x from bets qualify row_number() over (partition by day order by p desc, bet_id) <= 4), s as (select day, count(*) as n, sum(x) as s1, sum(x ** 2) as s2, sum(x ** 3) as s3 from t group by day having count(*) >= 3)
select day, n as legs, round(s1 / n - 1, 6) as singles, round((s1 ** 2 - s2) / (n * (n - 1)) - 1, 6) as doubles, round((s1 ** 3 - 3 * s1 * s2 + 2 * s3) / (n * (n - 1) * (n - 2)) - 1, 6) as trebles from s""")
def structures(t):
    """EV of all singles, doubles and trebles of a day's legs, from power sums: no combination is written out."""
    legs = K.top_n(t.bets(), ["day"], [F.desc("p"), F.col("bet_id")], 4).withColumn("x", F.col("p") * F.col("odds"))
    s = legs.groupBy("day").agg(F.count("*").alias("n"), *[F.sum(F.pow("x", F.lit(k))).alias(f"s{k}") for k in (1, 2, 3)]).where("n >= 3")
    n, s1, s2, s3 = (F.col(c) for c in ("n", "s1", "s2", "s3"))
    return rounded(s.select("day", n.alias("legs"), (s1 / n - 1).alias("singles"), ((s1 * s1 - s2) / (n * (n - 1)) - 1).alias("doubles"), ((s1 * s1 * s1 - 3 * s1 * s2 + 2 * s3) / (n * (n - 1) * (n - 2)) - 1).alias("trebles")))


@query("c5_closing_price_diagnostic", "bets", """
, c as (select l_partkey as event, max(1 + l_tax * 10 + l_quantity / 50) as close_odds from lineitem where l_linestatus = 'F' group by 1), d as (select b.*, close_odds, p * (1 + (close_odds - 1) * 0.98) - 1 as ev from bets b join c using (event))
select sport, count(*) as n, round(avg(ev), 6) as mean_ev, round(avg(y), 6) as hit, round(avg(case when y = 1 then (close_odds - 1) * 0.98 else -1.0 end), 6) as roi from d where ev >= 0.03 and close_odds between 1.5 and 5 group by sport""")
def closing(t):
    """Bets taken at the closing price, after commission and gates."""
    li = t.read("lineitem").where("l_linestatus = 'F'")
    c = li.groupBy(F.col("l_partkey").alias("event")).agg(F.max(1 + F.col("l_tax") * 10 + F.col("l_quantity") / 50).alias("close_odds"))
    win = (F.col("close_odds") - 1) * 0.98
    d = t.bets().join(c, "event").withColumn("ev", F.col("p") * (1 + win) - 1).where("ev >= 0.03 and close_odds between 1.5 and 5")
    return rounded(d.groupBy("sport").agg(F.count("*").alias("n"), F.avg("ev").alias("mean_ev"), F.avg("y").alias("hit"), F.avg(F.when(F.col("y") == 1, win).otherwise(-1.0)).alias("roi")))


@query("c8_discovery_and_stability", "history", """
, f as (select *, avg(goals_for) over (partition by team order by day, match_id rows between 5 preceding and 1 preceding) as form from history), r as (select *, year(day)::int as season, row_number() over (order by form, team, match_id) as r, count(*) over () as n from f where form is not null),
s as (select case when r <= n // 2 then 'low' else 'high' end as half, season, avg(goals_for) as m, count(*) as k from r group by all), b as (select season, sum(m * k) / sum(k) as base from s group by season)
select half, sum(k)::bigint as n, round(sum((m - base) * k) / sum(k), 6) as deviation, count(*) filter (m > base) as seasons_up, count(*) filter (m < base) as seasons_down from s join b using (season) group by half""")
def discovery(t):
    """The median split of last-five form: what the halves score against their season, and in how many seasons the sign holds."""
    w = H.prior(["team"], ["day", "match_id"], 5)
    f = t.history().withColumn("form", F.avg("goals_for").over(w)).where("form is not null").withColumn("season", F.year("day"))
    r = M.group_rank(f, [], [F.col("form"), F.col("team"), F.col("match_id")])
    s = r.groupBy(F.when(F.col("rank") < F.floor(F.col("_n") / 2), "low").otherwise("high").alias("half"), "season").agg(F.avg("goals_for").alias("m"), F.count("*").alias("k"))
    b = s.groupBy("season").agg((F.sum(F.col("m") * F.col("k")) / F.sum("k")).alias("base"))
    gap = F.col("m") - F.col("base")
    return rounded(s.join(b, "season").groupBy("half").agg(F.sum("k").alias("n"), (F.sum(gap * F.col("k")) / F.sum("k")).alias("deviation"), F.count_if(gap > 0).alias("seasons_up"), F.count_if(gap < 0).alias("seasons_down")))


@query("c9_registered_hypotheses", "bets", """
, q as (select sport, quantile_cont(p * odds, 0.75) as cut from bets group by sport), e as (select sport, event, sum(y - p) as r, count(*) as n from bets join q using (sport) where p * odds >= cut group by all), s as (select sport, sum(r) as r, sum(n) as n, sum(r * r) as rr, sum(r * n) as rn, sum(n * n) as nn from e group by sport)
select sport, n::bigint as n, round(r / n, 6) as residual, round((r / n) / (sqrt(rr - 2 * r / n * rn + (r / n) ** 2 * nn) / n), 4) as z from s""")
def hypotheses(t):
    """The top quarter by p x odds in each sport: its mean residual and a z clustered by event."""
    b = t.bets().withColumn("v", F.col("p") * F.col("odds"))
    q = M.percentiles(b, ["sport"], "v", [0.75]).select("sport", F.col("q")[0].alias("cut"))
    e = b.join(F.broadcast(q), "sport").where("v >= cut").groupBy("sport", "event").agg(F.sum(F.col("y") - F.col("p")).alias("r"), F.count("*").alias("n"))
    s = e.groupBy("sport").agg(*[F.sum(x).alias(c) for c, x in {"sr": F.col("r"), "sn": F.col("n"), "rr": F.col("r") * F.col("r"), "rn": F.col("r") * F.col("n"), "nn": F.col("n") * F.col("n")}.items()])
    m = F.col("sr") / F.col("sn")
    return rounded(s.select("sport", F.col("sn").alias("n"), m.alias("residual"), F.round(m / (F.sqrt(F.col("rr") - 2 * m * F.col("rn") + m * m * F.col("nn")) / F.col("sn")), 4).alias("z")))


@query("c10_canonical_build", "quotes fair bets", """
, m as (select event as market, arg_min(sport, (day, bet_id)) as result, min(day) as day from bets group by event), c as (select market, median(p) filter (outcome = 'A') as h, median(p) filter (outcome = 'N') as d, median(p) filter (outcome = 'R') as a, count(distinct book) as books from fair group by market), o as (select market, avg(s - 1) as overround from whole group by market)
select market, day, result, round(h, 6) as h, round(d, 6) as d, round(a, 6) as a, coalesce(books, 0) as books, round(overround, 6) as overround, case when books is null then 'NO_COMPLETE_BOOK' else 'OK' end as status from m left join c using (market) left join o using (market)""")
def canonical(t):
    """One row a match: the first result kept, the consensus of complete books, the mean margin, and why prices are missing."""
    m = t.bets().groupBy(F.col("event").alias("market")).agg(F.min(F.struct("day", "bet_id", "sport")).alias("x")).select("market", "x.day", F.col("x.sport").alias("result"))
    f = fair_by_book(t.quotes(), OUT)
    of = lambda k, name: F.median(F.when(F.col("outcome") == k, F.col("p"))).alias(name)
    c = f.groupBy("market").agg(of("A", "h"), of("N", "d"), of("R", "a"), F.count_distinct("book").alias("books"))
    o = f.groupBy("market", "book").agg((F.sum(1 / F.col("odds")) - 1).alias("s")).groupBy("market").agg(F.avg("s").alias("overround"))
    rows = m.join(c, "market", "left").join(o, "market", "left")
    return rounded(rows.select("market", "day", "result", "h", "d", "a", F.coalesce("books", F.lit(0)).alias("books"), "overround", F.when(F.col("books").isNull(), "NO_COMPLETE_BOOK").otherwise("OK").alias("status")))


@query("c14_card_calibration", "bets", """
, r as (select *, (row_number() over (partition by sport, day order by md5(bet_id::varchar)) - 1) // 3 as card from bets), c as (select sport, day, card, exp(sum(ln(p))) as joint, min(y) as won from r group by all having count(*) = 3)
select least(floor(joint * 10), 4)::int as band, count(*) as cards, round(avg(joint), 6) as joint_p, round(avg(won), 6) as won, round(var_pop(won) / (avg(joint) * (1 - avg(joint))), 6) as dispersion from c group by 1""")
def card_calibration(t):
    """Disjoint triples of each day by a hash: what their joint chances promise and what they win."""
    c = K.disjoint_tuples(t.bets(), ["sport", "day"], F.md5(F.col("bet_id").cast("string").cast("binary")), 3)
    j = F.avg("joint_p")
    return rounded(c.groupBy(F.least(F.floor(F.col("joint_p") * 10), F.lit(4)).cast("int").alias("band")).agg(F.count("*").alias("cards"), j.alias("joint_p"), F.avg("won").alias("won"), (F.var_pop("won") / (j * (1 - j))).alias("dispersion")))


@query("c15_portfolio_scoreboard", "bets", """
, t as (select * from bets qualify row_number() over (partition by day order by p desc, bet_id) <= 5), s as (select day, count(*) as n, sum(y) as correct, sum(p) as expected, sum(p * (1 - p)) as v from t group by day)
select n as legs, count(*) as days, round(avg(correct), 6) as correct, round(avg(expected), 6) as expected, round((sum(correct) - sum(expected)) / sqrt(sum(v)), 4) as z from s group by n""")
def scoreboard(t):
    """How many of each day's five likeliest legs win, against the sum of their chances."""
    s = K.top_n(t.bets(), ["day"], [F.desc("p"), F.col("bet_id")], 5).groupBy("day").agg(F.count("*").alias("n"), F.sum("y").alias("c"), F.sum("p").alias("e"), F.sum(F.col("p") * (1 - F.col("p"))).alias("v"))
    return rounded(s.groupBy(F.col("n").alias("legs")).agg(F.count("*").alias("days"), F.avg("c").alias("correct"), F.avg("e").alias("expected"), F.round((F.sum("c") - F.sum("e")) / F.sqrt(F.sum("v")), 4).alias("z")))


@query("c16_hybrid_multis", "bets", """
, b as (select sport, day, max((p, -bet_id, y, odds)) as x from bets group by all), j as (select a.day, a.x[1] * b.x[1] as joint, a.x[3] * b.x[3] as won, a.x[4] * b.x[4] as odds, a.x[3] as ya, b.x[3] as yb from b a join b on a.day = b.day and a.sport = 'A' and b.sport = 'N')
select year(day)::int as season, count(*) as multis, round(avg(joint), 6) as joint_p, round(avg(won), 6) as won, round(avg(case when won = 1 then odds - 1 else -1.0 end), 6) as roi, round(avg(ya * yb) / nullif(avg(ya) * avg(yb), 0), 6) as dependence from j group by 1""")
def hybrid(t):
    """The likeliest legs of two sports on a day as one multi, and how far the two depend on each other."""
    b = t.bets().groupBy("sport", "day").agg(F.max(F.struct("p", (-F.col("bet_id")).alias("b"), "y", "odds")).alias("x"))
    of = lambda s, k: b.where(F.col("sport") == s).select("day", F.col("x").alias(k))
    j = of("A", "a").join(of("N", "b"), "day").select("day", (F.col("a.p") * F.col("b.p")).alias("joint"), (F.col("a.y") * F.col("b.y")).alias("won"), (F.col("a.odds") * F.col("b.odds")).alias("odds"), F.col("a.y").alias("ya"), F.col("b.y").alias("yb"))
    both = F.try_divide(F.avg(F.col("ya") * F.col("yb")), F.avg("ya") * F.avg("yb"))
    return rounded(j.groupBy(F.year("day").alias("season")).agg(F.count("*").alias("multis"), F.avg("joint").alias("joint_p"), F.avg("won").alias("won"), F.avg(F.when(F.col("won") == 1, F.col("odds") - 1).otherwise(-1.0)).alias("roi"), both.alias("dependence")))


@query("c19_player_shots", "", """
with d as (select user_id, ts::date as day, count(*) filter (event_type in ('click', 'purchase')) as shots from events group by all), r as (select *, avg(shots) over (partition by user_id order by day rows between 10 preceding and 1 preceding) as rate from d), p as (select *, 1 - exp(-rate) as p, (shots >= 1)::int as y from r where rate is not null)
select user_id, count(*) as days, round(avg(p), 6) as mean_p, round(avg(y), 6) as hit, round(avg((p - y) ** 2), 6) as brier from p group by user_id""")
def player_shots(t):
    """A player's mean of the last ten match days as a Poisson rate: the chance of one shot or more against what happened."""
    d = t.read("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type").isin("click", "purchase")).alias("shots"))
    r = d.withColumn("rate", F.avg("shots").over(H.prior(["user_id"], ["day"], 10))).where("rate is not null")
    p, y = 1 - F.exp(-F.col("rate")), (F.col("shots") >= 1).cast("int")
    return rounded(r.withColumn("p", p).withColumn("y", y).groupBy("user_id").agg(F.count("*").alias("days"), F.avg("p").alias("mean_p"), F.avg("y").alias("hit"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier")))


@query("c20_team_prop_predictability", "history", """
, r as (select *, avg(goals_for) over (partition by team order by day, match_id rows between 10 preceding and 1 preceding) as rate, count(*) over (partition by team order by day, match_id rows between 10 preceding and 1 preceding) as n from history),
p as (select league, (goals_for > 25)::int as y, 1 - list_sum(list_transform(range(26), lambda k: exp(-rate + k * ln(rate) - lgamma(k + 1)))) as p from r where n >= 5 and rate > 0)
select league, count(*) as n, round(avg(p), 5) as mean_p, round(avg(y), 6) as rate, round(avg((p - y) ** 2), 5) as brier, round(1 - avg((p - y) ** 2) / (avg(y) * (1 - avg(y))), 4) as skill from p group by league""")
def team_props(t):
    """P(more than 25) from the last ten matches as a Poisson rate, and its skill over the league's base rate."""
    w = H.prior(["team"], ["day", "match_id"], 10)
    r = t.history().withColumn("rate", F.avg("goals_for").over(w)).withColumn("n", F.count("*").over(w)).where("n >= 5 and rate > 0")
    under = sum(F.exp(-F.col("rate") + k * F.log("rate") - math.lgamma(k + 1)) for k in range(26))
    q = r.select("league", (F.col("goals_for") > 25).cast("int").alias("y"), (1 - under).alias("p"))
    brier, y = F.avg(F.pow(F.col("p") - F.col("y"), 2)), F.avg("y")
    return rounded(q.groupBy("league").agg(F.count("*").alias("n"), F.round(F.avg("p"), 5).alias("mean_p"), y.alias("rate"), F.round(brier, 5).alias("brier"), F.round(1 - brier / (y * (1 - y)), 4).alias("skill")))


@query("c12_market_dataset", "ticks starts", """
, d as (select s.entity, s.start_id, s.start_ts, (select arg_max(price, (ts, tick_id)) from ticks k where k.entity = s.entity and k.ts <= s.start_ts - interval 24 hour) as early, (select arg_max(price, (ts, tick_id)) from ticks k where k.entity = s.entity and k.ts <= s.start_ts - interval 1 hour) as late from starts s)
select entity, start_id, early, late, round(late / early - 1, 6) as drift, case when early is null then 'NO_EARLY_PRICE' when late is null then 'NO_PRICE' else 'OK' end as status from d""")
def market_dataset(t):
    """Prices a day and an hour before each start, from two as-of reads, with their drift."""
    hours = lambda h: F.col("start_ts") - F.expr(f"INTERVAL {h} HOURS")
    s = t.starts().select("entity", "start_id", hours(24).alias("day_before"), hours(1).alias("hour_before"))
    early = T.as_of(s, t.ticks(), "entity", "day_before", "ts", ["price"], "tick_id").select("entity", "start_id", "hour_before", F.col("as_of_price").alias("early"))
    both = T.as_of(early, t.ticks(), "entity", "hour_before", "ts", ["price"], "tick_id").withColumnRenamed("as_of_price", "late")
    status = F.when(F.col("early").isNull(), "NO_EARLY_PRICE").when(F.col("late").isNull(), "NO_PRICE").otherwise("OK")
    return rounded(both.select("entity", "start_id", "early", "late", (F.col("late") / F.col("early") - 1).alias("drift"), status.alias("status")))
