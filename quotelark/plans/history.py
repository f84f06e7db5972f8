"""Queries on strictly-prior features."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotelark.operators import gates as G
from quotelark.operators import history as H
from quotelark.plans.registry import query, rounded


@query("w1_last_n_form", "history", """
select team, match_id, day, count(*) over w as window_matches, round(avg(goals_for) over w, 6) as form_for, round(avg(goals_against) over w, 6) as form_against,
  round(case when count(*) over w >= 2 then stddev_pop(goals_for - goals_against) over w end, 5) as form_spread, row_number() over (partition by team order by day, match_id)::int as appearance
from history window w as (partition by team order by day, match_id rows between 5 preceding and 1 preceding)""")
def form(t):
    return rounded(H.form(t.history(), 5).withColumn("form_spread", F.round("form_spread", 5)))


@query("w1_venue_form", "history", """
, v as (select *, goals_against >= 3 as home from history)
select team, match_id, home, count(*) over w as window_matches, round(avg(goals_for) over w, 6) as form_for, round(avg(goals_against) over w, 6) as form_against from v window w as (partition by team, home order by day, match_id rows between 5 preceding and 1 preceding)""")
def venue_form(t):
    """Form of each team's home matches and of its away matches."""
    got = H.form(t.history().withColumn("home", F.col("goals_against") >= 3), 5, ["home"])
    return rounded(got.select("team", "match_id", "home", "window_matches", "form_for", "form_against"))


@query("w1_conversion", "history", """
, v as (select *, case when goals_against > 1 then goals_for + goals_against end as shots from history)
select team, match_id, round(avg(goals_for) over w / nullif(avg(shots) over w, 0), 6) as conversion from v window w as (partition by team order by day, match_id rows between 5 preceding and 1 preceding)""")
def conversion(t):
    rows = t.history().withColumn("shots", F.when(F.col("goals_against") > 1, F.col("goals_for") + F.col("goals_against")))
    return rounded(H.conversion(rows, 5, "goals_for", "shots"))


@query("w2_rolling_mean_min_periods", "history", """
select team, match_id, round(case when count(goals_for) over w >= 3 then avg(goals_for) over w end, 6) as rolling from history window w as (partition by team order by day, match_id rows between 10 preceding and 1 preceding)""")
def rolling(t):
    return rounded(t.history().select("team", "match_id", H.rolling_mean("goals_for", ["team"], ["day", "match_id"], 10, 3).alias("rolling")))


@query("w3_expanding_with_fallback", "history", """
, d as (select day, sum(goals_for) as s, count(*) as n, any_value(1) as one from history group by day)
select team, match_id, round(coalesce(avg(goals_for) over (partition by team order by day, match_id rows between unbounded preceding and 1 preceding),
  avg(goals_for) over (partition by league order by day, match_id, team rows between unbounded preceding and 1 preceding), 25.0::double), 6) as prior_mean from history""")
def expanding(t):
    own = F.avg("goals_for").over(H.prior(["team"], ["day", "match_id"]))
    rows = H.prior_sums(t.history(), "league", "day", ["match_id", "team"], {"_s": F.col("goals_for")})
    return rounded(rows.select("team", "match_id", F.coalesce(own, F.try_divide(F.col("_s"), F.col("prior_n")), F.lit(25.0)).alias("prior_mean")))


@query("w4_laplace_outcome_frequencies", "history", """
, h as (select *, case when goals_for > goals_against then 'H' when goals_for < goals_against then 'A' else 'D' end as res from history)
select league, day, match_id, team, round((coalesce(sum((res = 'H')::int) over w, 0) + 1) / (count(*) over w + 3.0), 10) as f_h, round((coalesce(sum((res = 'D')::int) over w, 0) + 1) / (count(*) over w + 3.0), 10) as f_d,
  round((coalesce(sum((res = 'A')::int) over w, 0) + 1) / (count(*) over w + 3.0), 10) as f_a from h window w as (partition by league order by day, match_id, team rows between unbounded preceding and 1 preceding)""")
def laplace(t):
    res = F.when(F.col("goals_for") > F.col("goals_against"), "H").when(F.col("goals_for") < F.col("goals_against"), "A").otherwise("D")
    return rounded(H.laplace_frequencies(t.history().withColumn("res", res), "league", ["day", "match_id", "team"], "res", ["H", "D", "A"], 1.0), 10)


@query("w5_attack_and_defence_strengths", "history", """
, s as (select *, avg(goals_for) over (partition by league order by day, match_id rows between unbounded preceding and 1 preceding) as base,
  coalesce(sum(goals_for) over t, 0) as gf, coalesce(sum(goals_against) over t, 0) as ga, count(*) over t as n from one_ window t as (partition by league, team order by day, match_id rows between unbounded preceding and 1 preceding))
select league, team, match_id, day, round(coalesce((gf / nullif(base, 0) + 5) / (n + 5), 1.0::double), 10) as attack, round(coalesce((ga / nullif(base, 0) + 5) / (n + 5), 1.0::double), 10) as defence from s""".replace("one_", "(select * from history qualify row_number() over (partition by league, day, match_id order by team) = 1) "))
def strengths(t):
    w = W.partitionBy("league", "day", "match_id").orderBy("team")
    one = t.history().withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    return rounded(H.strengths(one, 5.0), 10)


@query("w6_strictly_earlier_dates", "history", """
, d as (select team, day, sum(goals_for) as v, count(*) as n from history group by all), l as (select day, sum(goals_for) as v, count(*) as n from history group by day),
r as (select day, sum(v) over w / sum(n) over w as league_rate from l window w as (order by day rows between unbounded preceding and 1 preceding)),
p as (select team, day, coalesce(sum(v) over w, 0) as pv, coalesce(sum(n) over w, 0)::bigint as pn from d window w as (partition by team order by day rows between unbounded preceding and 1 preceding))
select team, day, pn as prior_n, round(league_rate, 6) as league_rate, round(coalesce((pv + 4 * league_rate) / (pn + 4), league_rate), 6) as shrunk_rate from p join r using (day)""")
def earlier(t):
    return rounded(H.earlier_dates(t.history(), "team", "day", "goals_for", 4.0))


@query("w7_congestion", "history", """
select a.team, a.match_id, a.day, (select count(*) from history b where b.team = a.team and b.day < a.day and b.day >= a.day - 14) as recent from history a""")
def congestion(t):
    return H.congestion(t.history(), 14)


@query("w8_rest_days", "history", "select team, match_id, day, least(coalesce(day - lag(day) over (partition by team order by day, match_id), 30), 30)::int as rest from history")
def rest(t):
    return H.rest_days(t.history(), 30)


@query("w9_prior_count", "history", "select team, match_id, least(row_number() over (partition by team order by day, match_id) - 1, 20)::int as seen from history")
def seen(t):
    return t.history().select("team", "match_id", F.least(F.row_number().over(W.partitionBy("team").orderBy("day", "match_id")) - 1, F.lit(20)).alias("seen"))




@query("w10_head_to_head", "history", """
, g as (select match_id, min(day) as day, min(team) as lo, max(team) as hi, (arg_max(team, (goals_for, team)) = min(team))::int as lo_won from history group by match_id having count(*) >= 2),
m as (select match_id, day, case when match_id % 2 = 0 then lo else hi end as a, case when match_id % 2 = 0 then hi else lo end as b, case when match_id % 2 = 0 then lo_won else 1 - lo_won end as a_won from g)
select x.match_id, x.a, x.b, (select count(*) from m y where ((y.a = x.a and y.b = x.b and y.a_won = 1) or (y.a = x.b and y.b = x.a and y.a_won = 0)) and (y.day, y.match_id) < (x.day, x.match_id)) as a_wins,
  (select count(*) from m y where ((y.a = x.a and y.b = x.b and y.a_won = 0) or (y.a = x.b and y.b = x.a and y.a_won = 1)) and (y.day, y.match_id) < (x.day, x.match_id)) as b_wins from m x""")
def head_to_head(t):
    g = t.history().groupBy("match_id").agg(F.min("day").alias("day"), F.min("team").alias("lo"), F.max("team").alias("hi"), F.max(F.struct("goals_for", "team"))["team"].alias("top"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    even, won = F.col("match_id") % 2 == 0, (F.col("top") == F.col("lo")).cast("int")
    m = g.select("match_id", "day", F.when(even, F.col("lo")).otherwise(F.col("hi")).alias("a"), F.when(even, F.col("hi")).otherwise(F.col("lo")).alias("b"), F.when(even, won).otherwise(1 - won).alias("a_won"))
    return H.head_to_head(m)


@query("w12_forward_fill", "ticks", """
, x as (select *, case when price > 20 then price end as v from ticks) select tick_id, entity, last_value(v ignore nulls) over (partition by entity order by ts, tick_id rows unbounded preceding) as filled from x""")
def fill(t):
    v = F.when(F.col("price") > 20, F.col("price"))
    return t.ticks().select("tick_id", "entity", F.last(v, ignorenulls=True).over(W.partitionBy("entity").orderBy("ts", "tick_id").rowsBetween(W.unboundedPreceding, 0)).alias("filled"))


@query("w13_state_after_last", "history", """
select team, count(*) as n, round(avg(goals_for), 6) as last_for from (select *, row_number() over (partition by team order by day desc, match_id desc) as r from history) where r <= 6 group by team having count(*) >= 3""")
def last_state(t):
    r = F.row_number().over(W.partitionBy("team").orderBy(F.desc("day"), F.desc("match_id")))
    return rounded(t.history().withColumn("r", r).where("r <= 6").groupBy("team").agg(F.count(F.lit(1)).alias("n"), F.avg("goals_for").alias("last_for")).where("n >= 3"))


@query("r3_r4_perspectives_and_back", "history", """
, d as (select match_id, team, goals_for - goals_against as diff from history) select match_id, count(*) as sides, round(max(diff) - min(diff), 6) as spread from d group by match_id""")
def perspectives(t):
    own = t.history().select("match_id", "team", (F.col("goals_for") - F.col("goals_against")).alias("diff"))
    return rounded(own.groupBy("match_id").agg(F.count(F.lit(1)).alias("sides"), (F.max("diff") - F.min("diff")).alias("spread")))


@query("r6_pivot", "bets", "select season, round(avg(p) filter (sport = 'A'), 6) as a, round(avg(p) filter (sport = 'N'), 6) as n, round(avg(p) filter (sport = 'R'), 6) as r from bets group by season")
def pivot(t):
    got = t.bets().groupBy("season").pivot("sport", ["A", "N", "R"]).agg(F.avg("p"))
    return rounded(got.select("season", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r")))


@query("g11_walk_forward_folds", "bets", """
, s as (select season, row_number() over (order by season) as i from (select distinct season from bets)), f as (select i as fold from s where i < (select max(i) from s))
select fold::int as fold, case when s.i <= fold then 'train' else 'evaluate' end as use, count(*) as n from bets join s using (season) join f on s.i <= fold + 1 group by all""")
def folds(t):
    return G.folds(t.bets(), "season").groupBy("fold", "use").agg(F.count(F.lit(1)).alias("n"))


@query("g12_chronology_check", "bets", """
select bet_id, day, before from (select *, lag(day) over (partition by event order by bet_id) as before from bets) where day < before""")
def chronology(t):
    return G.chronology_violations(t.bets(), "event", "day", "bet_id").select("bet_id", "day", "before")


@query("g10_sealed_holdout", "bets", """
select sport, count(*) as n from bets where not (sport = 'A' and day between date '1997-01-01' and date '1997-12-31') and not (sport = 'R' and day between date '1998-06-01' and date '1999-06-01') group by sport""")
def sealed(t):
    guards = t.spark.sql("select * from values ('A', date '1997-01-01', date '1997-12-31'), ('R', date '1998-06-01', date '1999-06-01') as g(sport, begin, end)")
    return G.masked(t.bets(), guards, "sport", "day").groupBy("sport").agg(F.count(F.lit(1)).alias("n"))
