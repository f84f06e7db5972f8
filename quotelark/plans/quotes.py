"""Queries from quotes to consensus, best price and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelark.functions import odds as O
from quotelark.operators import consensus as C
from quotelark.operators import gates as G
from quotelark.plans.registry import query, rounded
from quotelark.sources.driver_tables import OUTCOMES

COMMISSION = 0.02


def graded(p, odds, std):
    """The ladder over a consensus: too few books are bad data, no price to speak of is thin liquidity, a wide spread is a risk."""
    edge = (F.col(p) - 1 / F.col(odds)) * 100
    return G.grade(F.col("ev"), edge, F.col("books"), {"DATA_QUALITY": F.col("books") < 2, "LIQUIDITY": F.col(odds) <= 1.05}, F.col(std) > 0.04)


@query("flagship_daily_scan", "quotes fair", """
, cons as (select market, outcome, median(p) as median_p, count(*) as books, stddev_pop(p) as std_p from fair group by all having count(*) >= 2),
best as (select market, outcome, max(odds) as best_odds, arg_max(book, (odds, -book)) as best_book from quotes group by all),
priced as (select *, median_p * (best_odds - 1) * 0.98 - (1 - median_p) as ev, (median_p - 1 / best_odds) * 100 as edge, std_p > 0.04 as risk from cons join best using (market, outcome)),
graded as (select *, case when books >= 6 and std_p <= 0.02 then 'High' when books >= 4 and std_p <= 0.04 then 'Medium' else 'Low' end as label from priced)
select market, outcome, best_book, best_odds, round(median_p, 6) as median_p, round(ev, 6) as ev, label,
       case when books < 2 or best_odds <= 1.05 then 'Reject' when ev is null or ev < 0 then 'Reject' when ev < 0.02 then 'C' when ev >= 0.08 and edge >= 4 and books >= 5 and not risk then 'A+' when ev >= 0.05 and edge >= 3 and books >= 4 and not risk then 'A' else 'B' end as grade
from graded""")
def daily_scan(t):
    """Quotes to margin-free consensus, best price, expected value, label and grade."""
    q = t.quotes()
    rows = C.candidates(q, OUTCOMES, least_books=2).withColumn("ev", O.net_ev(F.col("median_p"), F.col("best_odds"), F.lit(COMMISSION))).withColumn("label", G.confidence(F.col("books"), F.col("std_p")))
    out = rows.withColumn("grade", graded("median_p", "best_odds", "std_p"))
    return rounded(out.select("market", "outcome", "best_book", "best_odds", "median_p", "ev", "label", "grade"))


@query("a1_complete_books", "quotes", """
select market, book, count(*) = 3 and bool_and(outcome in ('A', 'N', 'R')) as complete,
  array_to_string(list_filter(['A', 'N', 'R'], lambda x: not list_contains(list(outcome), x)), ',') as missing,
  array_to_string(list_sort(list_filter(list(outcome), lambda x: not list_contains(['A', 'N', 'R'], x))), ',') as unexpected
from quotes group by market, book""")
def complete_books(t):
    return C.complete_books(t.quotes(), OUTCOMES)


@query("a1_proportional_devig", "quotes fair", "select market, book, outcome, odds, round(p, 6) as p from fair")
def proportional(t):
    return rounded(C.fair_by_book(t.quotes(), OUTCOMES))


@query("a2_additive_devig", "quotes fair", """
, raw as (select q.market, q.book, q.outcome, greatest(0.0::double, 1 / q.odds - (w.s - 1) / 3) as x from quotes q join whole w using (market, book))
select market, book, outcome, round(x / sum(x) over (partition by market, book), 6) as p from raw""")
def additive(t):
    return rounded(C.fair_by_book(t.quotes(), OUTCOMES, "additive").drop("odds"))


def _root_sql(low: str, high: str, value: str) -> str:
    """Bisection by a recursive table: 60 halvings of [lo, hi] for a falling function."""
    return f""", recursive_roots as (
  with recursive step as (
    select market, book, list(odds order by outcome) as q, list(outcome order by outcome) as o, {low}::double as lo, {high}::double as hi, 0 as i from fair group by market, book
    union all
    select market, book, q, o, case when {value} > 0 then (lo + hi) / 2 else lo end, case when {value} > 0 then hi else (lo + hi) / 2 end, i + 1 from step where i < 60
  ) select market, book, q, o, (lo + hi) / 2 as r from step where i = 60)"""


@query("a2_power_devig", "quotes fair", _root_sql("0.01", "50", "list_sum(list_transform(q, lambda x: pow(1 / x, (lo + hi) / 2))) - 1") + """
, raw as (select market, book, unnest(o) as outcome, unnest(list_transform(q, lambda x: pow(1 / x, r))) as x from recursive_roots)
select market, book, outcome, round(x / sum(x) over (partition by market, book), 6) as p from raw""")
def power(t):
    return rounded(C.fair_by_book(t.quotes(), OUTCOMES, "power").drop("odds"))


@query("a2_odds_ratio_devig", "quotes fair", _root_sql("0.000001", "10000", "list_sum(list_transform(q, lambda x: 1 / ((lo + hi) / 2 * (x - 1) + 1))) - 1") + """
, raw as (select market, book, unnest(o) as outcome, unnest(list_transform(q, lambda x: 1 / (r * (x - 1) + 1))) as x from recursive_roots)
select market, book, outcome, round(x / sum(x) over (partition by market, book), 6) as p from raw""")
def odds_ratio(t):
    return rounded(C.fair_by_book(t.quotes(), OUTCOMES, "odds_ratio").drop("odds"))


@query("a2_shin_devig", "quotes fair", _root_sql("0", "0.999", "list_sum(list_transform(q, lambda x: (sqrt(pow((lo + hi) / 2, 2) + 4 * (1 - (lo + hi) / 2) / (x * x) / list_sum(list_transform(q, lambda y: 1 / y))) - (lo + hi) / 2) / (2 * (1 - (lo + hi) / 2)))) - 1") + """
, raw as (select market, book, unnest(o) as outcome, unnest(list_transform(q, lambda x: (sqrt(r * r + 4 * (1 - r) / (x * x) / list_sum(list_transform(q, lambda y: 1 / y))) - r) / (2 * (1 - r)))) as x from recursive_roots)
select market, book, outcome, round(x / sum(x) over (partition by market, book), 6) as p from raw""")
def shin(t):
    return rounded(C.fair_by_book(t.quotes(), OUTCOMES, "shin").drop("odds"))


@query("a3_consensus", "quotes fair", """
select market, outcome, round(median(p), 6) as median_p, round(avg(p), 6) as mean_p, round(stddev_pop(p), 6) as std_p, round(quantile_cont(p, 0.75) - quantile_cont(p, 0.25), 6) as iqr_p,
       round(min(p), 6) as min_p, round(max(p), 6) as max_p, count(*) as books from fair group by market, outcome""")
def consensus(t):
    return rounded(C.consensus(C.fair_by_book(t.quotes(), OUTCOMES)))


@query("a4_consensus_floor", "quotes fair", "select market, outcome, round(median(p), 6) as median_p, count(*) as books from fair group by all having count(*) >= 3")
def consensus_floor(t):
    return rounded(C.consensus(C.fair_by_book(t.quotes(), OUTCOMES), 3).select("market", "outcome", "median_p", "books"))


@query("a5_leave_one_out", "quotes fair", """
select a.market, a.book, a.outcome, a.odds, round(a.p, 6) as p, round((select avg(b.p) from fair b where b.market = a.market and b.outcome = a.outcome and b.book <> a.book), 6) as loo_p from fair a""")
def leave_one_out(t):
    return rounded(C.leave_one_out(C.fair_by_book(t.quotes(), OUTCOMES)))


@query("a6_mean_odds_consensus", "quotes fair", """
, m as (select market, outcome, avg(odds) as mean_odds, count(*) as books from fair group by all having count(*) >= 2)
select market, outcome, round(mean_odds, 6) as mean_odds, books, round(1 / mean_odds / sum(1 / mean_odds) over (partition by market), 6) as p from m""")
def mean_odds(t):
    return rounded(C.mean_odds_consensus(t.quotes(), OUTCOMES, 2))


@query("a7_book_margin", "quotes fair", "select book, round(avg(s - 1), 6) as margin, count(*) as markets from whole group by book")
def margins(t):
    return rounded(C.margins(t.quotes(), OUTCOMES))


@query("a7_price_dispersion", "quotes", """
select market, outcome, count(*) as books, round(max(odds) / median(odds), 6) as best_to_median, round(max(odds) / min(odds), 6) as best_to_worst from quotes group by all having count(*) >= 3""")
def dispersion(t):
    return rounded(C.dispersion(t.quotes()))


@query("j1_best_accepted_price", "quotes", """
select market, outcome, max(odds) as best_odds, arg_max(book, (odds, -book)) as best_book
from quotes where book in (select s_suppkey from supplier where s_acctbal > 0) group by all""")
def best_accepted(t):
    return C.best_price(t.quotes(), t.read("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("book")))


@query("w15_triplet_normalisation", "quotes", """
select market, book, outcome, case when count(*) over w = 3 then 'OK' else 'INCOMPLETE' end as status,
       round(case when count(*) over w = 3 then (1 / odds) / sum(1 / odds) over w end, 6) as norm_p
from quotes window w as (partition by market, book)""")
def triplets(t):
    return rounded(C.normalised_triplets(t.quotes().withColumn("p", 1 / F.col("odds")), ["market", "book"], OUTCOMES).select("market", "book", "outcome", "status", "norm_p"))


@query("g1_odds_validation", "quotes", """
, b as (select market, book, count(*) as n, min(odds) as low, sum(1 / odds) as s from quotes group by all)
select market, book, case when n <> 3 then 'COUNT' when low <= 1 then 'RANGE' when s < 0.9 or s > 1.5 then 'MARGIN' end as reason from b""")
def validation(t):
    return t.quotes().groupBy("market", "book").agg(F.collect_list("odds").alias("q")).select("market", "book", G.validation(F.col("q"), 3).alias("reason"))


@query("g2_g3_g4_labels_and_grades", "quotes fair", """
, c as (select market, outcome, median(p) as p, stddev_pop(p) as sd, count(*) as books, max(odds) as best_odds from fair group by all),
e as (select *, p * (best_odds - 1) - (1 - p) as ev, (p - 1 / best_odds) * 100 as edge, sd > 0.04 as risk, case when books >= 6 and sd <= 0.02 then 'High' when books >= 4 and sd <= 0.04 then 'Medium' else 'Low' end as label from c),
g as (select *, case when books < 2 or best_odds <= 1.05 then 'Reject' when ev is null or ev < 0 then 'Reject' when ev < 0.02 then 'C' when ev >= 0.08 and edge >= 4 and books >= 5 and not risk then 'A+' when ev >= 0.05 and edge >= 3 and books >= 4 and not risk then 'A' else 'B' end as grade from e)
select market, outcome, label, grade, case when grade in ('A+', 'A', 'B') and best_odds < 1.5 then 'C' else grade end as floored from g""")
def grades(t):
    fair = C.fair_by_book(t.quotes(), OUTCOMES)
    c = fair.groupBy("market", "outcome").agg(F.median("p").alias("p"), F.stddev_pop("p").alias("sd"), F.count(F.lit(1)).alias("books"), F.max("odds").alias("best_odds"))
    e = c.withColumn("ev", O.net_ev(F.col("p"), F.col("best_odds"), F.lit(0.0))).withColumn("label", G.confidence(F.col("books"), F.col("sd")))
    g = e.withColumn("grade", graded("p", "best_odds", "sd"))
    return g.select("market", "outcome", "label", "grade", G.payout_floor(F.col("grade"), F.col("best_odds"), 1.5).alias("floored"))


def rules():
    """Reason codes and what raises them."""
    ev = O.net_ev(F.col("p"), F.col("odds"), F.lit(COMMISSION))
    return {"LOW_ODDS": F.col("odds") < 1.8, "LOW_P": F.col("p") < 0.3, "NEGATIVE_EV": ev <= 0, "TOO_EARLY": F.col("season") > 1999}


RULES_SQL = """, why as (select *, list_filter([case when odds < 1.8 then 'LOW_ODDS' end, case when p < 0.3 then 'LOW_P' end,
  case when p * (odds - 1) * 0.98 - (1 - p) <= 0 then 'NEGATIVE_EV' end, case when season > 1999 then 'TOO_EARLY' end], lambda x: x is not null) as r from bets)"""


@query("g5_money_qualification", "bets", RULES_SQL + """
select bet_id, array_to_string(r, '|') as reasons, case when len(r) = 0 then case when sport = 'N' then 'PAPER_ONLY' else 'BET' end
  when len(r) = 1 and r[1] = 'TOO_EARLY' then 'WATCH' else 'REJECT' end as decision from why""")
def qualification(t):
    rows = t.bets().withColumn("r", G.reasons(rules()))
    return rows.select("bet_id", F.concat_ws("|", "r").alias("reasons"), G.qualify(F.col("r"), "TOO_EARLY", F.col("sport") == "N").alias("decision"))


@query("g6_candidate_decision", "bets", RULES_SQL + """
select bet_id, case when list_has_any(r, ['NEGATIVE_EV', 'LOW_ODDS']) then 'REJECT' when len(r) > 0 then 'WATCH' else 'PICK' end as decision from why""")
def decision(t):
    return t.bets().select("bet_id", G.decide(G.reasons(rules()), ["NEGATIVE_EV", "LOW_ODDS"]).alias("decision"))


@query("g9_cohort_by_reasons", "bets", RULES_SQL + """
, ok as (select *, row_number() over (partition by event order by day, bet_id) as n from why where len(list_filter(r, lambda x: x not in ('TOO_EARLY', 'LOW_P'))) = 0)
select event, bet_id, day from ok where n = 1""")
def cohort(t):
    rows = t.bets().where(G.only_reasons(G.reasons(rules()), ["TOO_EARLY", "LOW_P"]))
    first = rows.groupBy("event").agg(F.min(F.struct("day", "bet_id")).alias("x"))
    return first.select("event", "x.bet_id", "x.day")


@query("r7_reason_counts", "bets", RULES_SQL + "select code, count(*) as n from (select unnest(r) as code from why) group by code")
def reason_counts(t):
    return t.bets().select(F.explode(F.split(F.concat_ws("|", G.reasons(rules())), r"\|")).alias("code")).where("code <> ''").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("p1_p2_p3_price_columns", "bets", """
select bet_id, round(1 / odds, 6) as implied, round(p * (odds - 1) * 0.95 - (1 - p), 6) as net_ev, round(1 / (1 + (odds - 1) * 0.95), 6) as break_even,
       round(100 * (p - 1 / odds), 6) as edge_pp, round(1 + (odds - 1) * 0.95, 6) as net_odds, ceil(round((1 + (1 / p - 1) / 0.95) * 100, 9)) / 100 as min_odds from bets""")
def price_columns(t):
    p, o, c = F.col("p"), F.col("odds"), F.lit(0.05)
    least = F.ceil(F.round((1 + (1 / p - 1) / (1 - c)) * 100, 9)) / 100
    return rounded(t.bets().select("bet_id", O.implied(o).alias("implied"), O.net_ev(p, o, c).alias("net_ev"), O.break_even(o, c).alias("break_even"), (100 * (p - O.implied(o))).alias("edge_pp"), O.net_odds(o, c).alias("net_odds"), least.alias("min_odds")))


@query("p4_american_odds", "", "select o_orderkey, round(case when l > 0 then 1 + l / 100 when l < 0 then 1 + 100 / abs(l) end, 6) as decimal_odds from (select o_orderkey, ((floor(o_totalprice)::bigint % 900) - 450)::double as l from orders)")
def american(t):
    line = (F.pmod(F.floor("o_totalprice"), F.lit(900)) - 450).cast("double")
    return rounded(t.read("orders").select("o_orderkey", O.american_to_decimal(line).alias("decimal_odds")))


@query("p5_kelly_stakes", "bets", """
, k as (select bet_id, greatest(0.0::double, (p * (odds - 1) * 0.98 - (1 - p)) / ((odds - 1) * 0.98)) as f from bets)
select bet_id, round(f, 6) as kelly, case when 1000 * least(f * 0.25, 0.02) >= 1 then round(1000 * least(f * 0.25, 0.02), 2) else 0.0 end as stake from k""")
def stakes(t):
    p, o = F.col("p"), F.col("odds")
    return rounded(t.bets().select("bet_id", O.kelly(p, o, F.lit(COMMISSION)).alias("kelly"), O.stake("kelly", F.lit(1000.0), p, o, F.lit(COMMISSION)).alias("stake")))


@query("p6_profit", "bets", """
select bet_id, case when event % 7 = 0 then 'VOID' when y = 1 then 'WON' else 'LOST' end as status,
       round(case when event % 7 = 0 then 0.0 when y = 1 then 2 * (odds - 1) * 0.98 else -2.0 end, 6) as profit from bets""")
def profit(t):
    status = F.when(F.col("event") % 7 == 0, "VOID").when(F.col("y") == 1, "WON").otherwise("LOST")
    return rounded(t.bets().select("bet_id", status.alias("status"), O.pnl(status, F.col("odds"), F.lit(COMMISSION), F.lit(2.0)).alias("profit")))


@query("p7_market_outcomes", "history", """
select team, match_id, case when goals_for > goals_against then 'WON' else 'LOST' end as home, case when goals_for <= goals_against then 'WON' else 'LOST' end as x2,
  case when goals_for + goals_against = 30 then 'VOID' when goals_for + goals_against > 30 then 'WON' else 'LOST' end as over30,
  case when goals_for > 0 and goals_against > 0 then 'WON' else 'LOST' end as btts from history""")
def outcomes(t):
    h, a, line = F.col("goals_for"), F.col("goals_against"), F.lit(30.0)
    of = lambda m, s, name: O.outcome(F.lit(m), F.lit(s), h, a, line).alias(name)
    return t.history().select("team", "match_id", of("1X2", "home", "home"), of("DC", "X2", "x2"), of("OU", "over", "over30"), of("BTTS", "yes", "btts"))


@query("p8_asian_handicap", "history", """
, m as (select team, match_id, (goals_for - round(goals_against))::int as d from history)
select team, match_id, (case when d - 0.5 > 0 then 1.0 when d - 0.5 < 0 then 0.0 else 0.5 end)::double as half_line,
  ((case when d > 0 then 1.0 when d < 0 then 0.0 else 0.5 end + case when d - 0.5 > 0 then 1.0 else 0.0 end) / 2)::double as quarter_line from m""")
def handicap(t):
    margin = (F.col("goals_for") - F.round("goals_against")).cast("int")
    return t.history().select("team", "match_id", O.asian_handicap(margin, F.lit(-0.5)).alias("half_line"), O.asian_handicap(margin, F.lit(-0.25)).alias("quarter_line"))


@query("p17_three_way", "history", """
, e as (select team, match_id, (goals_for - goals_against) * 10 + 60 as edge from history)
select team, match_id, round(1 / (1 + pow(10, -(edge - 40) / 400)), 6) as home, round(1 / (1 + pow(10, -(edge + 40) / 400)) - 1 / (1 + pow(10, -(edge - 40) / 400)), 6) as draw,
  round(1 - 1 / (1 + pow(10, -(edge + 40) / 400)), 6) as away from e""")
def three_way(t):
    x = O.three_way(F.col("goals_for") * 10, F.col("goals_against") * 10, 60.0, 40.0)
    return rounded(t.history().select("team", "match_id", x.alias("x")).select("team", "match_id", "x.home", "x.draw", "x.away"))


@query("p18_goal_grid", "history", """
, r as (select team, match_id, 0.2 + goals_for / 25 as lh, 0.2 + goals_against / 25 as la from history),
g as (select x::int as x, y::int as y from range(0, 11) a(x), range(0, 11) b(y)),
m as (select team, match_id, lh, la, x, y, exp(-lh) * pow(lh, x) / gamma(x + 1) * exp(-la) * pow(la, y) / gamma(y + 1) as w from r, g)
select team, match_id, round(sum(w) filter (x > y) / sum(w), 6) as home, round(sum(w) filter (x = y) / sum(w), 6) as draw, round(sum(w) filter (x < y) / sum(w), 6) as away,
  round((1 - exp(-any_value(lh))) * (1 - exp(-any_value(la))), 6) as btts from m group by team, match_id""")
def goal_grid(t):
    rates = t.history().select("team", "match_id", (0.2 + F.col("goals_for") / 25).alias("lh"), (0.2 + F.col("goals_against") / 25).alias("la"))
    grid = rates.select("team", "match_id", "lh", "la", O.goal_grid(F.col("lh"), F.col("la"), 10).alias("g"))
    return rounded(grid.select("team", "match_id", "g.home", "g.draw", "g.away", O.both_score(F.col("lh"), F.col("la")).alias("btts")))
