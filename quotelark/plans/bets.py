"""Queries on predictions, outcomes and returns."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotelark.functions.odds import logit, sigmoid
from quotelark.functions.text import band, hash_id, iso_week, sample_unit, season
from quotelark.operators import combos as K
from quotelark.operators import history as H
from quotelark.operators import metrics as M
from quotelark.plans.registry import query, rounded

EDGES = [0.0, 0.2, 0.4, 0.6, 0.8]


@query("a9_brier_and_log_loss", "bets", """
select sport, count(*) as n, round(avg((p - y) * (p - y)), 6) as brier,
       round(avg(-(y * ln(least(greatest(p, 1e-6::double), (1 - 1e-6)::double)) + (1 - y) * ln(1 - least(greatest(p, 1e-6::double), (1 - 1e-6)::double)))), 6) as log_loss from bets group by sport""")
def scores(t):
    return rounded(t.bets().groupBy("sport").agg(F.count(F.lit(1)).alias("n"), M.brier(F.col("p"), F.col("y")).alias("brier"), M.log_loss(F.col("p"), F.col("y")).alias("log_loss")))


BINS = """, binned as (select *, {bin} as bin from bets)
select bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(y), 6) as rate from binned group by bin"""


@query("a10_equal_count_bins_first", "bets", BINS.format(bin="(ntile(10) over (order by p, bet_id) - 1)::int"))
def bins_first(t):
    return rounded(M.calibration_table(M.equal_count_bins(t.bets().select("bet_id", "p", "y"), [F.col("p"), F.col("bet_id")], 10)))


@query("a10_equal_count_bins_last", "bets", BINS.format(bin="(10 - ntile(10) over (order by p desc, bet_id desc))::int"))
def bins_last(t):
    return rounded(M.calibration_table(M.equal_count_bins(t.bets().select("bet_id", "p", "y"), [F.col("p"), F.col("bet_id")], 10, "last")))


@query("a10_calibration_error", "bets", """
, binned as (select ntile(10) over (partition by sport order by p, bet_id) as bin, * from bets), b as (select sport, bin, count(*) as n, avg(p) as mp, avg(y) as r from binned group by all)
select sport, round(sum(n * abs(mp - r)) / sum(n), 6) as ece from b group by sport""")
def ece(t):
    table = M.calibration_table(M.equal_count_bins(t.bets(), [F.col("p"), F.col("bet_id")], 10, by=["sport"]), ["sport", "bin"])
    return rounded(table.groupBy("sport").agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece")))


@query("a11_a13_reliability_bands", "bets", """
, b as (select case when p >= 0.8 then 4 when p >= 0.6 then 3 when p >= 0.4 then 2 when p >= 0.2 then 1 else 0 end::int as band, p, y from bets), a as (select band, count(*) as n, sum(y)::bigint as k, avg(p) as mp from b group by band)
select band, n, k, round(mp, 6) as mean_p, round((k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) as low,
  round((k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) as high from a""")
def reliability(t):
    got = t.bets().groupBy(band(F.col("p"), EDGES).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"), F.avg("p").alias("mean_p"))
    ci = got.withColumn("ci", M.wilson(F.col("k"), F.col("n")))
    return rounded(ci.select("band", "n", "k", "mean_p", "ci.low", "ci.high"))


@query("a12_threshold_table", "bets", """
select threshold::double as threshold, count(*) as n, round(avg(y), 6) as rate from bets, (values (0.2), (0.4), (0.6), (0.8)) v(threshold) where p >= threshold group by threshold""")
def threshold_table(t):
    return rounded(M.thresholds(t.bets(), [0.2, 0.4, 0.6, 0.8]))


@query("a14_auc", "bets", """
, r as (select sport, y, rank() over w + (count(*) over (partition by sport, p) - 1) / 2.0 as rk from bets window w as (partition by sport order by p))
select sport, round((sum(rk) filter (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) as auc from r group by sport""")
def auc(t):
    return rounded(M.auc(t.bets(), ["sport"]))


@query("a16_effect_size", "bets", """
, s as (select sport, count(*) filter (y = 1) as na, count(*) filter (y = 0) as nb, avg(odds) filter (y = 1) as ma, avg(odds) filter (y = 0) as mb, var_pop(odds) filter (y = 1) as va, var_pop(odds) filter (y = 0) as vb from bets group by sport)
select sport, round(case when na >= 5 and nb >= 5 then (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) end, 6) as d from s""")
def effect(t):
    return rounded(t.bets().groupBy("sport").agg(M.cohens_d(F.col("odds"), F.col("y") == 1).alias("d")))


@query("a18_performance_rollup", "bets", """
select sport, season, grouping(sport)::int as all_sports, grouping(season)::int as all_seasons, count(*) as bets, round(sum(staked), 6) as staked, round(sum(profit), 6) as profit, round(sum(profit) / sum(staked), 6) as roi, round(avg(y), 6) as hit_rate
from bets group by grouping sets ((), (sport), (season), (sport, season))""")
def rollup(t):
    b = t.bets()
    return rounded(
        b.groupingSets([[], ["sport"], ["season"], ["sport", "season"]], "sport", "season").agg(
            F.grouping("sport").cast("int").alias("all_sports"), F.grouping("season").cast("int").alias("all_seasons"), F.count(F.lit(1)).alias("bets"), F.sum("staked").alias("staked"),
            F.sum("profit").alias("profit"), (F.sum("profit") / F.sum("staked")).alias("roi"), F.avg("y").alias("hit_rate"),
        )
    )


@query("a20_concentration", "bets", "select event, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as share from bets group by event")
def concentration(t):
    per = t.bets().groupBy("event").agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    return rounded(per.crossJoin(F.broadcast(total)).select("event", "n", (F.col("n") / F.col("total")).alias("share")), 9)


@query("a21_return_statistics", "bets", """
select season, count(*) as bets, round(sum(profit), 6) as profit, round(avg(profit), 6) as mean_profit, round(median(profit), 6) as median_profit, round(sum(profit) / sum(staked), 6) as roi, round(avg(odds * p - 1), 6) as mean_clv from bets group by season""")
def return_stats(t):
    middle = M.percentiles(t.bets(), ["season"], "profit", [0.5]).select("season", F.col("q")[0].alias("median_profit"))
    sums = t.bets().groupBy("season").agg(F.count(F.lit(1)).alias("bets"), F.sum("profit").alias("profit"), F.avg("profit").alias("mean_profit"), (F.sum("profit") / F.sum("staked")).alias("roi"), F.avg(F.col("odds") * F.col("p") - 1).alias("mean_clv"))
    return rounded(sums.join(middle, "season"))


@query("a22_edge_atlas", "bets", """
, b as (select *, case when p >= 0.8 then 4 when p >= 0.6 then 3 when p >= 0.4 then 2 when p >= 0.2 then 1 else 0 end::int as band, case when season < 1998 then 'discovery' else 'confirmation' end as period, p * odds - 1 as ev from bets)
select sport, band, period, count(*) as n, round(avg(profit), 6) as mean_return, round(regr_slope(profit, ev), 5) as slope, round(quantile_cont(ev, 0.25), 6) as ev_q1, round(quantile_cont(ev, 0.75), 6) as ev_q3 from b group by sport, band, period""")
def atlas(t):
    b = t.bets().withColumn("ev", F.col("p") * F.col("odds") - 1).withColumn("period", F.when(F.col("season") < 1998, "discovery").otherwise("confirmation"))
    b, by = b.withColumn("band", band(F.col("p"), EDGES)), ["sport", "band", "period"]
    got = b.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("profit").alias("mean_return"), F.round(F.regr_slope("profit", "ev"), 5).alias("slope")).join(M.percentiles(b, by, "ev", [0.25, 0.75]), by)
    return rounded(got.select("sport", "band", "period", "n", "mean_return", "slope", F.col("q")[0].alias("ev_q1"), F.col("q")[1].alias("ev_q3")))


def _poisson_sql(u: str) -> str:
    total, term, out = 0.0, 0.36787944117144233, []
    for i in range(9):
        total += term
        out.append(f"({u} >= {total!r}::double)::int")
        term /= i + 1
    return " + ".join(out)


@query("a23_cluster_bootstrap", "bets", f"""
, c as (select sport, event, sum(profit) as v, sum(staked) as w from bets group by all), d as (select *, unnest(range(20)) as draw from c),
k as (select *, ('0x' || substr(md5('boot|' || event || '|' || draw), 1, 12))::bigint / 281474976710656.0::double as u from d), m as (select *, {_poisson_sql('u')} as k from k)
select sport, draw::int as draw, round(sum(k * v) / sum(k * w), 6) as estimate from m group by sport, draw""")
def bootstrap(t):
    return rounded(M.bootstrap(t.bets(), "event", F.col("profit"), F.col("staked"), 20, ["sport"]))


def _draws_sql(value: str, weight: str, by: str = "sport") -> str:
    return f"""
, c as (select {by}, event, sum({value}) as v, sum({weight}) as w from bets group by all), d as (select *, unnest(range(40)) as draw from c),
k as (select *, ('0x' || substr(md5('boot|' || event || '|' || draw), 1, 12))::bigint / 281474976710656.0::double as u from d), m as (select *, {_poisson_sql('u')} as k from k),
e as (select {by}, draw, sum(k * v) / sum(k * w) as estimate from m group by all)"""


INTERVAL_SQL = "round(avg(estimate), 6) as mean, round(quantile_cont(estimate, 0.025), 6) as low, round(quantile_cont(estimate, 0.975), 6) as high"


def _interval(draws, by):
    """Mean and 95 % percentile interval of the estimates of a bounded number of draws."""
    q = F.percentile("estimate", F.array(F.lit(0.025), F.lit(0.975)))
    return rounded(draws.groupBy(*by).agg(F.avg("estimate").alias("mean"), q.alias("q")).select(*by, "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high")))


@query("a23_mean_interval", "bets", _draws_sql("y - p", "1") + "select sport, " + INTERVAL_SQL + " from e group by sport")
def mean_interval(t):
    return _interval(M.bootstrap(t.bets(), "event", F.col("y") - F.col("p"), F.lit(1), 40, ["sport"]), ["sport"])


@query("a23_paired_difference", "bets", _draws_sql("(p - y) ** 2 - (least(0.95, 1 / odds) - y) ** 2", "1") + "select sport, " + INTERVAL_SQL + " from e group by sport")
def paired_interval(t):
    """Squared errors of the model and of the price on the same bets."""
    square = lambda c: F.pow(c - F.col("y"), 2)
    loss = square(F.col("p")) - square(F.least(F.lit(0.95), 1 / F.col("odds")))
    return _interval(M.bootstrap(t.bets(), "event", loss, F.lit(1), 40, ["sport"]), ["sport"])


@query("a23_two_sample_difference", "bets", _draws_sql("profit", "staked") + ", t as (select draw, max(estimate) filter (sport = 'A') - max(estimate) filter (sport = 'R') as estimate from e group by draw) select " + INTERVAL_SQL + " from t")
def two_sample(t):
    of = lambda s: F.max(F.when(F.col("sport") == s, F.col("estimate")))
    draws = M.bootstrap(t.bets(), "event", F.col("profit"), F.col("staked"), 40, ["sport"])
    return _interval(draws.groupBy("draw").agg((of("A") - of("R")).alias("estimate")), [])


@query("a27_correlation", "bets", "select sport, round(coalesce(corr(p, odds), 0), 6) as r from bets group by sport")
def correlation(t):
    return rounded(t.bets().groupBy("sport").agg(F.coalesce(F.corr("p", "odds"), F.lit(0.0)).alias("r")))


@query("a28_dependence", "bets", """
, x as (select season, (p >= 0.5)::int as a, y as b from bets)
select season, count(*) as n, round(avg(a), 6) as p_a, round(avg(b), 6) as p_b, round(avg(a * b), 6) as p_ab, round(avg(a * b) / (avg(a) * avg(b)), 6) as ratio, round(avg(a * b) / avg(b), 6) as a_given_b from x group by season""")
def dependence(t):
    return rounded(K.dependence(t.bets().select("season", (F.col("p") >= 0.5).cast("int").alias("a"), F.col("y").alias("b")), ["season"], "a", "b"))


@query("a29_pair_and_triple_totals", "bets", """
, r as (select event, count(*) as n, sum(y - p) as s1, sum((y - p) ** 2) as s2, sum((y - p) ** 3) as s3 from bets group by event)
select event, n, round((s1 * s1 - s2) / 2, 6) as pair_total, round((s1 ** 3 - 3 * s1 * s2 + 2 * s3) / 6, 6) as triple_total from r""")
def power_sums(t):
    return rounded(K.power_sums(t.bets(), "event", F.col("y") - F.col("p")))


@query("a30_dispersion_index", "bets", """
, d as (select day, sum(y) as l, sum(p) as q, sum(p * (1 - p)) as v from bets group by day) select round(sum((l - q) ** 2) / sum(v), 6) as dispersion, count(*) as days from d""")
def dispersion(t):
    d = t.bets().groupBy("day").agg((F.sum("y") - F.sum("p")).alias("r"), F.sum(F.col("p") * (1 - F.col("p"))).alias("v"))
    return rounded(d.agg((F.sum(F.col("r") * F.col("r")) / F.sum("v")).alias("dispersion"), F.count(F.lit(1)).alias("days")))


@query("a31_effective_sample_size", "bets", ", w as (select event, sum(staked) as w from bets group by event) select round(sum(w) * sum(w) / sum(w * w), 6) as n_eff from w")
def n_eff(t):
    return rounded(K.effective_size(t.bets().groupBy("event").agg(F.sum("staked").alias("w"))))


@query("a32_exposure", "bets", ", e as (select event, sum(odds) as amount from bets group by event) select event, round(amount, 6) as amount, round(amount / sum(amount) over (), 9) as share, amount = max(amount) over () as largest from e")
def exposure(t):
    got = K.exposure(t.bets(), "event", "odds")
    return got.select("event", F.round("amount", 6).alias("amount"), F.round("share", 9).alias("share"), "largest")


@query("a34_number_correct", "bets", """
, f as (select event, p, row_number() over (partition by event order by bet_id) as r from bets), l as (select event, list(p order by r) as q from f where r <= 3 group by event having count(*) = 3)
select event, round((1 - q[1]) * (1 - q[2]) * (1 - q[3]), 6) as p0, round(q[1] * (1 - q[2]) * (1 - q[3]) + (1 - q[1]) * q[2] * (1 - q[3]) + (1 - q[1]) * (1 - q[2]) * q[3], 6) as p1, round(q[1] * q[2] * q[3], 6) as p3 from l""")
def number_correct(t):
    first = K.top_n(t.bets(), ["event"], [F.col("bet_id")], 3)
    legs = first.groupBy("event").agg(F.sort_array(F.collect_list(F.struct("place", "p")))["p"].alias("q")).where(F.size("q") == 3)
    d = legs.select("event", K.number_correct(F.col("q")).alias("d"))
    return rounded(d.select("event", F.col("d")[0].alias("p0"), F.col("d")[1].alias("p1"), F.col("d")[3].alias("p3")))


@query("a34_holm", "bets", """
, t as (select season as test, round(1.0 / (1 + abs(sum(y - p))), 9) as p_value from bets group by season), r as (select *, least(1.0::double, (count(*) over () - row_number() over (order by p_value, test) + 1) * p_value) as raw from t)
select test, round(p_value, 6) as p_value, round(max(raw) over (order by p_value, test), 6) as adjusted from r""")
def holm(t):
    tests = t.bets().groupBy(F.col("season").alias("test")).agg(F.round(1 / (1 + F.abs(F.sum(F.col("y") - F.col("p")))), 9).alias("p_value"))
    return rounded(M.holm(tests.withColumn("all", F.lit(1)), ["all"]).drop("all"))


@query("a39_gate_grid", "bets", """
select g.o::double as min_odds, e.e::double as min_ev, count(*) as bets, round(sum(profit) / sum(staked), 6) as roi from bets, (values (1.5), (2.0), (3.0)) g(o), (values (0.0), (0.1), (0.3)) e(e) where odds >= g.o and p * odds - 1 >= e.e group by all""")
def gate_grid(t):
    cells = t.spark.createDataFrame([(o, e) for o in (1.5, 2.0, 3.0) for e in (0.0, 0.1, 0.3)], "min_odds double, min_ev double")
    at = t.bets().withColumn("o", F.when(F.col("odds") >= 3, 3).when(F.col("odds") >= 2, 2).when(F.col("odds") >= 1.5, 1)).withColumn("ev", F.col("p") * F.col("odds") - 1)
    level = at.withColumn("e", F.when(F.col("ev") >= 0.3, 3).when(F.col("ev") >= 0.1, 2).when(F.col("ev") >= 0, 1)).where("o is not null and e is not null")
    cell = level.groupBy("o", "e").agg(F.count(F.lit(1)).alias("n"), F.sum("profit").alias("s"), F.sum("staked").alias("k"))  # nine rows, whatever the bets
    need = cells.withColumn("no", F.when(F.col("min_odds") >= 3, 3).when(F.col("min_odds") >= 2, 2).otherwise(1)).withColumn("ne", F.when(F.col("min_ev") >= 0.3, 3).when(F.col("min_ev") >= 0.1, 2).otherwise(1))
    return rounded(need.join(F.broadcast(cell), (F.col("o") >= F.col("no")) & (F.col("e") >= F.col("ne"))).groupBy("min_odds", "min_ev").agg(F.sum("n").alias("bets"), (F.sum("s") / F.sum("k")).alias("roi")))


@query("p9_p10_p13_p20_scalars", "bets", """
select bet_id, case when p >= 0.8 then 4 when p >= 0.6 then 3 when p >= 0.4 then 2 when p >= 0.2 then 1 else 0 end::int as band, substr(sha256(sport || '|' || event || '|' || bet_id), 1, 16) as id,
  round(('0x' || substr(sha256('s|' || bet_id), 1, 12))::bigint / 281474976710656.0::double, 9) as u, case when month(day) >= 7 then year(day) || '/' || lpad(((year(day) + 1) % 100)::varchar, 2, '0') else (year(day) - 1) || '/' || lpad((year(day) % 100)::varchar, 2, '0') end as season_label,
  isoyear(day) || '-W' || lpad(week(day)::varchar, 2, '0') as iso_week, round(ln(p / (1 - p)), 6) as logit, round(1 / (1 + exp(-odds)), 6) as sigmoid from bets""")
def scalars(t):
    c = F.col
    return t.bets().select("bet_id", band(c("p"), EDGES).alias("band"), hash_id(c("sport"), c("event").cast("string"), c("bet_id").cast("string")).alias("id"), F.round(sample_unit(c("bet_id"), "s"), 9).alias("u"), season(c("day")).alias("season_label"), iso_week(c("day")).alias("iso_week"), F.round(logit(c("p")), 6).alias("logit"), F.round(sigmoid(c("odds")), 6).alias("sigmoid"))


@query("w14_keep_first", "bets", "select event, day, bet_id from (select *, row_number() over (partition by event, day order by bet_id) as r from bets) where r = 1")
def keep_first(t):
    return t.bets().groupBy("event", "day").agg(F.min("bet_id").alias("bet_id"))


@query("w16_likeliest_per_event", "bets", "select event, arg_max(bet_id, (p, -bet_id)) as bet_id, max(p) as p from bets group by event")
def likeliest(t):
    best = t.bets().groupBy("event").agg(F.max(F.struct("p", (-F.col("bet_id")).alias("b"))).alias("x"))
    return best.select("event", (-F.col("x.b")).alias("bet_id"), "x.p")


@query("w17_running_drawdown", "bets", """
, b as (select event, bet_id, day, 10 + sum(profit) over w as balance from bets window w as (partition by event order by day, bet_id rows unbounded preceding)),
p as (select *, greatest(10.0::double, max(balance) over (partition by event order by day, bet_id rows unbounded preceding)) as peak from b)
select event, bet_id, round(balance, 6) as balance, round(peak, 6) as peak, round(peak - balance, 6) as fall from p""")
def drawdown(t):
    return rounded(H.drawdown(t.bets(), ["event"], ["day", "bet_id"], 10.0).select("event", "bet_id", "balance", "peak", "fall"))


@query("w18_losing_streak", "bets", """
, r as (select event, y, row_number() over (partition by event order by day, bet_id) - sum(1 - y) over (partition by event order by day, bet_id) as island from bets), n as (select event, island, count(*) as n from r where y = 0 group by all)
select event, max(n) as streak from n group by event""")
def streak(t):
    return H.losing_streak(t.bets().withColumn("lost", 1 - F.col("y")), ["event"], ["day", "bet_id"])


@query("w19_daily_cap", "bets", """
, o as (select *, row_number() over (partition by day, event order by p desc, bet_id) as e from bets), d as (select *, row_number() over (partition by day order by p desc, bet_id) as place from o where e = 1)
select bet_id, day, event, place::int as place from d where place <= 5""")
def daily_cap(t):
    return H.daily_cap(t.bets(), "day", "event", [F.desc("p"), F.col("bet_id")], 5.0, 1.0).select("bet_id", "day", "event", "place")


@query("w20_disjoint_triples", "bets", """
, r as (select *, (row_number() over (partition by sport, day order by md5(bet_id::varchar)) - 1) // 3 as card from bets)
select sport, day, card::int as card, round(exp(sum(ln(p))), 6) as joint_p, round(exp(sum(ln(odds))), 6) as price, min(y) as won from r group by all having count(*) = 3""")
def triples(t):
    return rounded(K.disjoint_tuples(t.bets(), ["sport", "day"], F.md5(F.col("bet_id").cast("string").cast("binary")), 3))


@query("w21_group_relative", "bets", "select bet_id, round(odds - avg(odds) over (partition by sport, season), 6) as relative from bets")
def relative(t):
    """Means are taken by group and joined back: a group of any size stays spread."""
    mean = t.bets().groupBy("sport", "season").agg(F.avg("odds").alias("mean"))
    return rounded(t.bets().join(mean, ["sport", "season"]).select("bet_id", (F.col("odds") - F.col("mean")).alias("relative")))


@query("w22_rank_slices", "bets", """
, r as (select season, bet_id, row_number() over (partition by season order by odds, bet_id) as r, count(*) over (partition by season) as n from bets)
select season, bet_id, least((r - 1) // greatest(n // 4, 1), 3)::int as slice, case when r <= n // 2 then 'low' else 'high' end as half from r""")
def slices(t):
    x = M.group_rank(t.bets(), ["season"], [F.col("odds"), F.col("bet_id")]).select("season", "bet_id", (F.col("rank") + 1).alias("r"), F.col("_n").alias("n"))
    return x.select("season", "bet_id", F.least(F.floor((F.col("r") - 1) / F.greatest(F.floor(F.col("n") / 4), F.lit(1))), F.lit(3)).cast("int").alias("slice"), F.when(F.col("r") <= F.floor(F.col("n") / 2), "low").otherwise("high").alias("half"))


@query("t1_t2_board_ranking", "bets", "select day, bet_id, row_number() over (partition by day order by p desc, event, bet_id)::int as place from bets")
def board(t):
    return t.bets().select("day", "bet_id", F.row_number().over(W.partitionBy("day").orderBy(F.desc("p"), "event", "bet_id")).alias("place"))


@query("t3_largest_misses", "bets", "select bet_id, p, y from bets where (p >= 0.5) <> (y = 1) order by abs(p - y) desc, bet_id limit 25")
def misses(t):
    return t.bets().where((F.col("p") >= 0.5) != (F.col("y") == 1)).orderBy(F.abs(F.col("p") - F.col("y")).desc(), "bet_id").limit(25).select("bet_id", "p", "y")


@query("t4_top_n_per_group", "bets", "select team, bet_id, place::int as place from (select *, row_number() over (partition by team order by p * odds desc, bet_id) as place from bets) where place <= 3")
def top3(t):
    return K.top_n(t.bets(), ["team"], [(F.col("p") * F.col("odds")).desc(), F.col("bet_id")], 3).select("team", "bet_id", "place")


@query("t6_main_line", "bets", "select event, arg_min(odds, (abs(p - 0.5), odds)) as main_line from bets group by event")
def main_line(t):
    best = t.bets().groupBy("event").agg(F.min(F.struct(F.abs(F.col("p") - 0.5).alias("d"), "odds")).alias("x"))
    return best.select("event", F.col("x.odds").alias("main_line"))


@query("j20_bounded_pairs", "bets", """
, t as (select * from (select *, row_number() over (partition by team order by p desc, bet_id) as place from bets) where place <= 6)
select a.team, a.event as event_a, b.event as event_b, round(a.p * b.p, 6) as joint_p, round(a.odds * b.odds, 6) as joint_odds, round(a.p * b.p * a.odds * b.odds - 1, 6) as ev from t a join t b using (team) where a.place < b.place and a.event <> b.event""")
def bounded_pairs(t):
    pool = K.top_n(t.bets(), ["team"], [F.desc("p"), F.col("bet_id")], 6)
    return rounded(K.pairs(pool, "team", "event", "p", "odds"))


@query("j21_books_pricing_all_legs", "bets quotes", """
, l as (select distinct team as card, event as market from (select *, row_number() over (partition by team order by bet_id) as r from bets) where r <= 2),
k as (select card, count(*) as k from l group by card), q as (select market, book, max(odds) as odds from quotes group by all),
b as (select card, book, count(distinct market) as n, exp(sum(ln(odds))) as price from l join q using (market) group by all)
select card, count(*) as books, round(min(price), 6) as low, round(median(price), 6) as mid, round(max(price), 6) as high from b join k using (card) where n = k group by card""")
def all_legs(t):
    legs = K.top_n(t.bets(), ["team"], [F.col("bet_id")], 2).select(F.col("team").alias("card"), F.col("event").alias("market")).distinct()
    return rounded(K.price_all(legs, t.quotes().groupBy("market", "book").agg(F.max("odds").alias("odds")), "card", "market"))


@query("j27_common_sample", "bets", """
, c as (select event from bets where sport in ('A', 'N', 'R') group by event having count(distinct sport) = 3) select sport, count(*) as n, round(avg((p - y) * (p - y)), 6) as brier from bets where event in (select event from c) group by sport""")
def common_sample(t):
    b = t.bets()
    common = b.groupBy("event").agg(F.count_distinct("sport").alias("n")).where("n = 3").select("event")
    return rounded(b.join(common, "event", "left_semi").groupBy("sport").agg(F.count(F.lit(1)).alias("n"), M.brier(F.col("p"), F.col("y")).alias("brier")))
