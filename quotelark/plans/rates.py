"""Queries of base rates, dependence by cell, volumes, pair flags and models on expanding folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quotelark.operators import combos as K
from quotelark.operators import history as H
from quotelark.operators import models as M
from quotelark.plans.models import FOLD_FITS, MODELS, _long
from quotelark.plans.registry import query, rounded

ONE = "*"


@query("a28_sign_share", "bets", """
, c as (select sport, season, count(*) as n, sum((p >= 0.5)::int)::bigint as a, sum(y)::bigint as b, sum((p >= 0.5)::int * y)::bigint as ab from bets group by all)
select sport, count(*) as cells, count(*) filter (n * ab > a * b) as above, round(count(*) filter (n * ab > a * b) / count(*), 6) as above_share, round(sum(ab) / sum(a * b / n), 6) as ratio from c where n >= 20 group by sport""")
def sign_share(t):
    """In how many seasons of a sport two events come together more often than if they were independent, and how much more in all."""
    a = (F.col("p") >= 0.5).cast("long")
    cells = t.bets().groupBy("sport", "season").agg(F.count(ONE).alias("n"), F.sum(a).alias("a"), F.sum("y").alias("b"), F.sum(a * F.col("y")).alias("ab")).where("n >= 20")
    above = F.count_if(F.col("n") * F.col("ab") > F.col("a") * F.col("b"))
    return rounded(cells.groupBy("sport").agg(F.count(ONE).alias("cells"), above.alias("above"), (above / F.count(ONE)).alias("above_share"), (F.sum("ab") / F.sum(F.col("a") * F.col("b") / F.col("n"))).alias("ratio")))


@query("a36_rates_by_minutes", "bets", """
, r as (select team, sport, sum(y) as hits, sum(floor(odds * 10)) as minutes from bets where season < 1997 group by all), o as (select sport, sum(hits) / sum(minutes) as overall from r group by sport),
e as (select bet_id, sport, (coalesce(hits, 0) + 900 * overall) / (coalesce(minutes, 0) + 900) * floor(odds * 10) as expected from bets b join o using (sport) left join r using (team, sport) where season >= 1997)
select bet_id, round(expected, 6) as expected, round(1 - exp(-expected), 6) as at_least_1, round(1 - exp(-expected) * (1 + expected), 6) as at_least_2 from e""")
def rates_by_minutes(t):
    """Rates a minute from the training seasons, shrunk to the role's by 900 minutes, and Poisson chances of one and two in a row's minutes."""
    b = t.bets().withColumn("minutes", F.floor(F.col("odds") * 10))
    r = b.where("season < 1997").groupBy("team", "sport").agg(F.sum("y").alias("hits"), F.sum("minutes").alias("played"))
    o = r.groupBy("sport").agg((F.sum("hits") / F.sum("played")).alias("overall"))  # a row a role
    rate = (F.coalesce("hits", F.lit(0)) + 900 * F.col("overall")) / (F.coalesce("played", F.lit(0)) + 900)
    x = b.where("season >= 1997").join(F.broadcast(o), "sport").join(r, ["team", "sport"], "left").select("bet_id", (rate * F.col("minutes")).alias("expected"))
    e = F.col("expected")
    return rounded(x.select("bet_id", "expected", (1 - F.exp(-e)).alias("at_least_1"), (1 - F.exp(-e) * (1 + e)).alias("at_least_2")))


@query("x25_weekly_volume", "history", """
, w as (select league, year(day)::int as season, date_trunc('week', day) as week, count(distinct match_id) as matches from history group by all)
select league, season, count(*) as weeks, sum(matches)::bigint as matches, round(avg(matches), 6) as mean, max(matches) as most from w group by all""")
def weekly_volume(t):
    """Matches a week, by league and season."""
    w = t.history().groupBy("league", F.year("day").alias("season"), F.date_trunc("week", "day").alias("week")).agg(F.count_distinct("match_id").alias("matches"))
    return rounded(w.groupBy("league", "season").agg(F.count(ONE).alias("weeks"), F.sum("matches").alias("matches"), F.avg("matches").alias("mean"), F.max("matches").alias("most")))


@query("x12_draw_and_round_flags", "bets", """
, t as (select * from bets qualify row_number() over (partition by day order by p desc, bet_id) <= 2),
j as (select a.bet_id as bet_a, b.bet_id as bet_b, a.p * b.p as product, a.event = b.event as e, a.team = b.team as t, a.sport = b.sport and a.season = b.season and a.event % 8 = b.event % 8 as d, a.sport = b.sport and b.day <> a.day as r, a.sport = b.sport and a.day = b.day as s
  from t a join t b on b.day between a.day and a.day + 3 and (a.day < b.day or a.bet_id < b.bet_id))
select bet_a, bet_b, round(product, 6) as product_p, array_to_string(list_filter([case when e then 'SAME_EVENT' end, case when t then 'SAME_PARTICIPANT' end, case when d then 'SAME_TOURNAMENT_DRAW' end, case when r then 'SAME_COMPETITION_ROUND' end, case when s then 'SAME_DAY_SAME_SPORT' end], lambda x: x is not null), '|') as flags,
  case when e or t or d then 'BLOCKED' when r or s then 'UNVALIDATED' else 'ASSUMED' end as status from j""")
def round_flags(t):
    """Pairs of a day's best candidates with those of the same and the next three days (72 hours), all flags of dependence, and what they mean."""
    pool = K.top_n(t.bets(), ["day"], [F.desc("p"), F.col("bet_id")], 2)
    a, b = (pool.select(*[F.col(c).alias(f"{c}_{s}") for c in ("bet_id", "day", "season", "event", "team", "sport", "p")]) for s in "ab")
    near = a.withColumn("on", F.explode(F.sequence("day_a", F.date_add("day_a", 3))))
    both = near.join(b, F.col("on") == F.col("day_b")).where("day_a < day_b or bet_id_a < bet_id_b")
    same = lambda c: F.col(f"{c}_a") == F.col(f"{c}_b")
    draw = same("sport") & same("season") & (F.col("event_a") % 8 == F.col("event_b") % 8)
    rules = {"SAME_EVENT": same("event"), "SAME_PARTICIPANT": same("team"), "SAME_TOURNAMENT_DRAW": draw, "SAME_COMPETITION_ROUND": same("sport") & ~same("day"), "SAME_DAY_SAME_SPORT": same("sport") & same("day")}
    flags = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    status = F.when(F.arrays_overlap(flags, F.array(*map(F.lit, list(rules)[:3]))), "BLOCKED").when(F.size(flags) > 0, "UNVALIDATED").otherwise("ASSUMED")
    return rounded(both.select(F.col("bet_id_a").alias("bet_a"), F.col("bet_id_b").alias("bet_b"), (F.col("p_a") * F.col("p_b")).alias("product_p"), F.concat_ws("|", flags).alias("flags"), status.alias("status")))


@query("d4_missing_and_duplicates", "", """
with o as (select *, count(*) over (partition by o_custkey, o_orderdate::date) as same from orders)
select o_orderpriority as division, count(*) as rows, count(*) filter (o_orderstatus = 'P') as missing, count(*) filter (same > 1) as duplicated, round(count(*) filter (o_orderstatus = 'P') / count(*), 6) as missing_share from o group by 1""")
def missing_and_duplicates(t):
    """By division: rows without a statistic, and rows that share a team and a day. Pairs are counted first, so no window holds a group."""
    o = t.read("orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("division")).agg(F.count(ONE).alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("missing"))
    all_ = o.groupBy("o_custkey", "day").agg(F.sum("n").alias("same"))
    found = o.join(all_, ["o_custkey", "day"]).groupBy("division").agg(F.sum("n").alias("rows"), F.sum("missing").alias("missing"), F.coalesce(F.sum(F.when(F.col("same") > 1, F.col("n"))), F.lit(0)).alias("duplicated"))
    return rounded(found.withColumn("missing_share", F.col("missing") / F.col("rows")))


def expanding(t):
    """Ridge logistic predictions of every season but the first two, each by a fit on all earlier ones."""
    return M.expanding_folds(t.bets(), "season", lambda train, test: M.logistic(train, test, ["p", "odds"], "y"), 2)


@query("m1_expanding_folds")
def logistic_folds(t):
    return rounded(expanding(t).select("bet_id", "season", F.col("chances")[1].alias("p_model")))


@query("m2_multinomial_folds")
def multinomial_folds(t):
    b = t.bets().withColumn("kind", F.when(F.col("sport") == "A", 0).when(F.col("sport") == "N", 1).otherwise(2))
    got = M.expanding_folds(b, "season", lambda train, test: M.logistic(train, test, ["p", "odds"], "kind", family="multinomial"), 2)
    return rounded(got.select("bet_id", "season", *[F.col("chances")[k].alias(name) for k, name in enumerate(("p_a", "p_n", "p_r"))]))


@query("m5_models_on_folds")
def pooled_models(t):
    """The fitted model, the raw chances and the price on the same pooled bets of all folds."""
    rows = expanding(t).select("y", F.col("chances")[1].alias("fitted"), F.col("p").alias("raw"), F.least(F.lit(0.95), 1 / F.col("odds")).alias("price"))
    long_ = rows.unpivot(["y"], ["fitted", "raw", "price"], "model", "q")
    q, y = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("q"))), F.col("y")
    return rounded(long_.groupBy("model").agg(F.count(ONE).alias("n"), F.avg((q - y) * (q - y)).alias("brier"), F.avg(-F.when(y == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss")))


@query("c15_card_sizes", "bets", """
, t as (select *, row_number() over (partition by day order by p desc, bet_id) as r from bets qualify r <= 5),
c as (select k, day, exp(sum(ln(p))) as joint, min(y) as won, exp(sum(ln(odds))) as price, avg(y * odds - 1) as singles from t, range(2, 6) g(k) where r <= k group by k, day having count(*) = k)
select k as legs, count(*) as days, round(avg(joint), 6) as joint_p, round(avg(won), 6) as won, round((sum(won) - sum(joint)) / sqrt(sum(joint * (1 - joint))), 4) as z, round(avg(won * price - 1), 5) as card_return, round(avg(singles), 6) as singles_return,
  round(avg(joint * ln(1 + 0.02 * (price - 1)) + (1 - joint) * ln(0.98)), 6) as expected_growth, round(avg(case when won = 1 then ln(1 + 0.02 * (price - 1)) else ln(0.98) end), 6) as made_growth from c group by k""")
def card_sizes(t):
    """The same days' likeliest legs as cards of two to five: what they promise, what they win, and what growth either means."""
    top = K.top_n(t.bets(), ["day"], [F.desc("p"), F.col("bet_id")], 5).withColumn("k", F.explode(F.sequence(F.greatest("place", F.lit(2)), F.lit(5))))
    product = lambda c: F.exp(F.sum(F.log(c)))
    c = top.groupBy("k", "day").agg(F.count(ONE).alias("n"), product("p").alias("joint"), F.min("y").alias("won"), product("odds").alias("price"), F.avg(F.col("y") * F.col("odds") - 1).alias("singles")).where("n = k")
    win = F.log(1 + 0.02 * (F.col("price") - 1))
    joint, lose = F.col("joint"), F.lit(0.98)
    return rounded(c.groupBy(F.col("k").cast("long").alias("legs")).agg(
        F.count(ONE).alias("days"), F.avg("joint").alias("joint_p"), F.avg("won").alias("won"), F.round((F.sum("won") - F.sum("joint")) / F.sqrt(F.sum(joint * (1 - joint))), 4).alias("z"),
        F.round(F.avg(F.col("won") * F.col("price") - 1), 5).alias("card_return"), F.avg("singles").alias("singles_return"),
        F.avg(joint * win + (1 - joint) * F.log(lose)).alias("expected_growth"), F.avg(F.when(F.col("won") == 1, win).otherwise(F.log(lose))).alias("made_growth"),
    ))


@query("c18_estimator_choice", "bets", FOLD_FITS + MODELS + """, l as (select model, season < 1997 as early, q, y, -case when y = 1 then ln(q) else ln(1 - q) end as loss from m),
s as (select model, avg(loss) filter (early) as development, avg(loss) filter (not early) as holdout, avg((q - y) ** 2) filter (not early) as brier, avg(q) filter (not early and y = 1) - avg(q) filter (not early and y = 0) as separation, max(loss) filter (not early) as worst from l group by model)
select model, round(development, 6) as development, round(holdout, 6) as holdout, round(brier, 6) as brier, round(separation, 6) as separation, round(worst, 6) as worst, row_number() over (order by round(development, 9), model) = 1 as chosen from s""")
def estimator_choice(t):
    """The estimator of the least log loss on development seasons, and how each does on the later ones: loss, separation and largest miss."""
    long_ = _long(t)
    loss = -F.when(F.col("y") == 1, F.log("q")).otherwise(F.log(1 - F.col("q")))
    l = long_.withColumn("loss", loss).withColumn("early", F.col("season") < 1997)
    late = lambda c, more=F.lit(True): F.when(~F.col("early") & more, c)
    s = l.groupBy("model").agg(
        F.avg(F.when(F.col("early"), F.col("loss"))).alias("development"), F.avg(late(F.col("loss"))).alias("holdout"), F.avg(late(F.pow(F.col("q") - F.col("y"), 2))).alias("brier"),
        (F.avg(late(F.col("q"), F.col("y") == 1)) - F.avg(late(F.col("q"), F.col("y") == 0))).alias("separation"), F.max(late(F.col("loss"))).alias("worst"),
    )
    best = s.agg(F.min(F.struct(F.round("development", 9), "model"))["model"].alias("best"))  # a row an estimator, then one
    return rounded(s.crossJoin(F.broadcast(best)).withColumn("chosen", F.col("model") == F.col("best")).drop("best"))


def over_lines(lines):
    """A function of rates: the Poisson chances of more than each line, p<line>; a term is the one before it times rate / k, for a batch at once."""

    @F.pandas_udf(", ".join(f"p{k} double" for k in lines))
    def run(rate: pd.Series) -> pd.DataFrame:
        r = rate.to_numpy(float)
        term = np.exp(-r)
        total, out = term.copy(), {}
        for k in range(max(lines) + 1):
            if k:
                term *= r / k
                total += term
            if k in lines:
                out[f"p{k}"] = 1 - total
        return pd.DataFrame(out)

    return run


@query("c20_lines_and_estimators", "history", """
, r as (select *, avg(goals_for) over (partition by team order by day, match_id rows between 10 preceding and 1 preceding) as last10, avg(goals_for) over (partition by team order by day, match_id rows between unbounded preceding and 1 preceding) as career, count(*) over (partition by team order by day, match_id rows between unbounded preceding and 1 preceding) as n from history),
e as (unpivot (select league, goals_for, last10, career from r where n >= 5 and last10 > 0) on last10, career into name estimator value rate),
p as (select estimator, line, (goals_for > line)::int as y, 1 - list_sum(list_transform(range(line + 1), lambda k: exp(-rate + k * ln(rate) - lgamma(k + 1)))) as p from e, (values (20), (25), (30), (40)) g(line))
select estimator, line, count(*) as n, round(avg(p), 5) as mean_p, round(avg(y), 6) as rate, round(avg((p - y) ** 2), 5) as brier, round(1 - avg((p - y) ** 2) / (avg(y) * (1 - avg(y))), 4) as skill from p group by all""")
def lines_and_estimators(t):
    """Poisson chances of more than four lines from a team's last ten matches and from all before, on the same matches, and their skill."""
    w, every = H.prior(["team"], ["day", "match_id"], 10), H.prior(["team"], ["day", "match_id"])
    h = t.history(teams_together=True)
    r = h.withColumn("last10", F.avg("goals_for").over(w)).withColumn("career", F.avg("goals_for").over(every)).withColumn("n", F.count(ONE).over(every)).where("n >= 5 and last10 > 0")
    e = r.unpivot(["goals_for"], ["last10", "career"], "estimator", "rate")
    lines = (20, 25, 30, 40)
    p = e.select("estimator", "goals_for", over_lines(lines)(F.col("rate")).alias("p"))
    y = lambda k: (F.col("goals_for") > k).cast("int")
    of = lambda k: F.struct(F.lit(k).alias("line"), F.avg(f"p.p{k}").alias("mean_p"), F.avg(y(k)).alias("rate"), F.avg(F.pow(F.col(f"p.p{k}") - y(k), 2)).alias("brier"))
    wide = p.groupBy("estimator").agg(F.count(ONE).alias("n"), F.array(*map(of, lines)).alias("x"))  # a row an estimator
    share, brier = F.col("x.rate"), F.col("x.brier")
    return rounded(wide.select("estimator", "n", F.explode("x").alias("x")).select("estimator", "x.line", "n", F.round("x.mean_p", 5).alias("mean_p"), share.alias("rate"), F.round(brier, 5).alias("brier"), F.round(1 - brier / (share * (1 - share)), 4).alias("skill")))
