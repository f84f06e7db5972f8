"""Queries of fitting jobs and streams."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotelark.operators import models as M
from quotelark.operators.consensus import fair_by_book
from quotelark.plans.registry import query, rounded
from quotelark.scratch import new_path
from quotelark.sinks.ledger import read
from quotelark.streaming import ledgers as S


@query("a15_calibration_slope", "bets", """
, v as (select sport, p, count(*) as n, sum(y) as pos, ln(p / (1 - p)) as x from bets group by sport, p),
fit as (with recursive s as (
  select distinct sport, 0.0::double as a, 1.0::double as b, 0 as i from v
  union all
  select sport, a - (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1), b - (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1), i + 1 from (
    select s.sport, s.a, s.b, s.i, sum(n * q * (1 - q)) as h0, sum(n * q * (1 - q) * x) as h1, sum(n * q * (1 - q) * x * x) as h2, sum(n * q - pos) as g0, sum((n * q - pos) * x) as g1
    from (select s.*, v.n, v.pos, v.x, 1 / (1 + exp(-(s.a + s.b * v.x))) as q from s join v using (sport) where s.i < 12) s group by s.sport, s.a, s.b, s.i)
) select sport, a, b from s where i = 12)
select sport, round(a, 6) as intercept, round(b, 6) as slope from fit""")
def slope(t):
    return rounded(M.calibration_slope(t.bets(), "sport"))


@query("m4_blend_grid", "bets", """
select (s / 20.0)::double as w, round(avg(-case when y = 1 then ln(s / 20.0::double * p + (1 - s / 20.0::double) * least(0.95::double, 1 / odds)) else ln(1 - (s / 20.0::double * p + (1 - s / 20.0::double) * least(0.95::double, 1 / odds))) end), 6) as log_loss
from bets, range(0, 21) g(s) group by s""")
def blend(t):
    return rounded(M.blend_grid(t.bets().withColumn("q", F.least(F.lit(0.95), 1 / F.col("odds"))), "p", "q", 20))


@query("m1_logistic_walk_forward")
def logistic(t):
    """Ridge logistic on seasons before 1999, scored on later ones."""
    b = t.bets()
    return rounded(M.logistic(b.where("season < 1999"), b.where("season >= 1999"), ["p", "odds"], "y").select("bet_id", F.col("chances")[1].alias("p_model")))


FOLD_FITS = """
, v as (select s.season as fold, b.p, count(*) as n, sum(b.y) as pos, ln(b.p / (1 - b.p)) as x from bets b join (select distinct season from bets) s on b.season < s.season group by all),
fit as (with recursive s as (
  select distinct fold, 0.0::double as a, 1.0::double as b, 0 as i from v
  union all
  select fold, a - (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1), b - (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1), i + 1 from (
    select s.fold, s.a, s.b, s.i, sum(n * q * (1 - q)) as h0, sum(n * q * (1 - q) * x) as h1, sum(n * q * (1 - q) * x * x) as h2, sum(n * q - pos) as g0, sum((n * q - pos) * x) as g1
    from (select s.*, v.n, v.pos, v.x, 1 / (1 + exp(-(s.a + s.b * v.x))) as q from s join v using (fold) where s.i < 12) s group by s.fold, s.a, s.b, s.i)
) select fold, a, b from s where i = 12)
"""


@query("m5_pooled_walk_forward", "bets", FOLD_FITS + """select season, count(*) as n, round(avg(-case when y = 1 then ln(m) else ln(1 - m) end), 6) as model_loss, round(avg(-case when y = 1 then ln(p) else ln(1 - p) end), 6) as raw_loss
from (select b.*, 1 / (1 + exp(-(f.a + f.b * ln(b.p / (1 - b.p))))) as m from bets b join fit f on b.season = f.fold) group by season""")
def pooled(t):
    """Each season by a fit on all earlier ones; predictions are pooled and compared on the same bets."""
    got = M.walk_forward(t.bets(), "season")
    loss = lambda p: F.avg(-F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - F.col(p))))
    return rounded(got.groupBy("season").agg(F.count(F.lit(1)).alias("n"), loss("model_p").alias("model_loss"), loss("p").alias("raw_loss")))


MODELS = """, o as (select b.season, b.y, 1 / (1 + exp(-(f.a + f.b * ln(b.p / (1 - b.p))))) as recalibrated, b.p as raw, least(0.95, 1 / b.odds) as price from bets b join fit f on b.season = f.fold), m as (unpivot o on recalibrated, raw, price into name model value q)
"""


def _long(t):
    """Walk-forward predictions of the three models on the same bets, a row each."""
    rows = M.walk_forward(t.bets(), "season").select("season", "y", F.col("model_p").alias("recalibrated"), F.col("p").alias("raw"), F.least(F.lit(0.95), 1 / F.col("odds")).alias("price"))
    return rows.unpivot(["season", "y"], ["recalibrated", "raw", "price"], "model", "q")


@query("c17_models_on_folds", "bets", FOLD_FITS + MODELS + """select model, count(*) as n, round(avg((q - y) ** 2), 6) as brier, round(avg(-case when y = 1 then ln(q) else ln(1 - q) end), 6) as log_loss, round(avg(q - y), 6) as bias from m group by model""")
def compare_models(t):
    q, y = F.col("q"), F.col("y")
    return rounded(_long(t).groupBy("model").agg(F.count("*").alias("n"), F.avg(F.pow(q - y, 2)).alias("brier"), F.avg(-F.when(y == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"), F.avg(q - y).alias("bias")))


@query("c18_error_analysis", "bets", FOLD_FITS + MODELS + """select model, least(floor(q * 5), 4)::int as band, count(*) as n, round(avg(q), 6) as mean_p, round(avg(y), 6) as rate, round(max(abs(q - y)), 6) as worst from m group by all""")
def error_analysis(t):
    """Reliability by band and the largest miss, for each estimator."""
    band_ = F.least(F.floor(F.col("q") * 5), F.lit(4)).cast("int")
    return rounded(_long(t).groupBy("model", band_.alias("band")).agg(F.count("*").alias("n"), F.avg("q").alias("mean_p"), F.avg("y").alias("rate"), F.max(F.abs(F.col("q") - F.col("y"))).alias("worst")))


@query("m6_implied_goal_rates", "quotes fair", """
, m as (select market, avg(p) filter (outcome = 'A') as p_home, avg(p) filter (outcome = 'R') as p_away, 0.3 + avg(p) filter (outcome = 'N') as p_over from fair group by market),
g as (select i * 0.25::double as l, k, exp(-i * 0.25::double) * pow(i * 0.25::double, k) / factorial(k::int) as pk from range(1, 17) a(i), range(0, 11) b(k)),
c as (select a.l as h, b.l as w, sum(a.pk * b.pk) filter (a.k > b.k) as ph, sum(a.pk * b.pk) filter (a.k < b.k) as pa, sum(a.pk * b.pk) filter (a.k + b.k > 2.5) as po from g a, g b group by all),
e as (select market, h, w, (ph - p_home) ** 2 + (pa - p_away) ** 2 + (po - p_over) ** 2 as e from m, c)
select market, arg_min(h, (e, h, w)) as lambda_home, arg_min(w, (e, h, w)) as lambda_away, round(min(e), 6) as error from e group by market""")
def implied(t):
    of = lambda o: F.avg(F.when(F.col("outcome") == o, F.col("p")))
    m = fair_by_book(t.quotes(), ("A", "N", "R")).groupBy("market").agg(of("A").alias("p_home"), of("R").alias("p_away"), (0.3 + of("N")).alias("p_over"))
    return rounded(M.implied_rates(m, ["market"], 16, 0.25))


@query("m8_rating_step_calibration")
def step_calibration(t):
    """Each step size replays the ratings; the one of the least log loss is marked."""
    g = t.history().groupBy("league", "match_id").agg(F.min("day").alias("day"), F.min("team").alias("a"), F.max("team").alias("b"), F.max(F.struct("goals_for", "team"))["team"].alias("top"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    g = g.withColumn("a_won", (F.col("top") == F.col("a")).cast("int"))
    loss = F.avg(-F.when(F.col("a_won") == 1, F.log("p")).otherwise(F.log(1 - F.col("p"))))
    tried = [M.replay_ratings(g, "league", k).agg(F.lit(k).alias("k"), loss.alias("log_loss"), F.count(F.lit(1)).alias("n")) for k in (5.0, 10.0, 20.0, 40.0)]
    every = reduce(DataFrame.unionByName, tried)
    return rounded(every.withColumn("best", F.col("log_loss") == F.min("log_loss").over(W.partitionBy("n"))))  # a row a step size


@query("m2_multinomial")
def multinomial(t):
    b = t.bets().withColumn("kind", F.when(F.col("sport") == "A", 0).when(F.col("sport") == "N", 1).otherwise(2))
    got = M.logistic(b.where("season < 1999"), b.where("season >= 1999"), ["p", "odds"], "kind", family="multinomial")
    return rounded(got.select("bet_id", F.col("chances")[0].alias("p_a"), F.col("chances")[1].alias("p_n"), F.col("chances")[2].alias("p_r")))


@query("m3_poisson_rates")
def poisson(t):
    h = t.history().withColumn("x", F.col("goals_against") / 10)
    return rounded(M.poisson_rates(h.where("day < date '1999-01-01'"), h.where("day >= date '1999-01-01'"), ["x"], "goals_for").select("team", "match_id", "rate"), 4)


@query("m7_rating_replay")
def ratings(t):
    g = t.history().groupBy("league", "match_id").agg(F.min("day").alias("day"), F.min("team").alias("a"), F.max("team").alias("b"), F.max(F.struct("goals_for", "team"))["team"].alias("top"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return rounded(M.replay_ratings(g.withColumn("a_won", (F.col("top") == F.col("a")).cast("int")), "league"))


@query("q2_stream_append_unique", "", "select user_id, event_type, date_trunc('day', ts) as day, arg_min(event_id, event_id) as event_id from events group by all")
def stream_append(t):
    """A stream of files into a ledger that keeps the first row of each key, whatever the batches."""
    where = new_path(t.spark)
    events = t.read("events")
    keyed = S.read_files(t.spark, f"{t.dir}/events.parquet*", events.schema).select("user_id", "event_type", F.date_trunc("day", "ts").cast("timestamp").alias("day"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
    S.append_to_ledger(keyed, f"{where}/rows", ["user_id", "event_type", "day"], ["event_id"], f"{where}/state", "day").awaitTermination()
    return read(t.spark, f"{where}/rows", keyed.schema).select("user_id", "event_type", "day", "event_id")


@query("q8_stream_daily_counts", "", "select user_id, date_trunc('day', ts) as begin, count(*) as n from events group by all")
def stream_counts(t):
    path, events = new_path(t.spark), t.read("events")
    rows = S.read_files(t.spark, f"{t.dir}/events.parquet*", events.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = S.counters(rows, "ts", "user_id").withColumn("key", F.concat_ws("|", F.col("user_id").cast("string"), F.col("begin").cast("string")))
    S.upserts(counts, f"{path}/rows", f"{path}/state").awaitTermination()
    return S.latest_rows(t.spark, f"{path}/rows", "key").drop("key")


@query("m3_dispersion", "history", """
, m as (select *, avg(goals_for) over (partition by team) as rate from history) select league, round(greatest(0.0, sum((goals_for - rate) ** 2 - rate) / sum(rate * rate)), 6) as alpha from m group by league""")
def negative_binomial(t):
    """Dispersion about each team's own rate."""
    rate = t.history().groupBy("team").agg(F.avg("goals_for").alias("rate"))
    return rounded(M.dispersion(t.history().join(rate, "team"), "goals_for", "league"))
