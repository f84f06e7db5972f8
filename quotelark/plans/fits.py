"""Queries of replays, likelihood fits, distinct picks and cards that overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelark.operators import combos as K
from quotelark.operators import models as M
from quotelark.operators import ratings as R
from quotelark.operators import selection as X
from quotelark.operators.consensus import fair_by_book
from quotelark.plans.registry import query, rounded
from quotelark.scratch import cut

STEPS, MARGINS = (10.0, 20.0, 40.0), (0.0, 50.0, 100.0, 150.0)


def matches(t):
    """Two teams of a league that met in an order, the one of the lower number at home."""
    g = t.history().groupBy("league", "match_id").agg(F.min("day").alias("day"), F.min(F.struct("team", "goals_for")).alias("a"), F.max(F.struct("team", "goals_for")).alias("b"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return g.select("match_id", "day", F.year("day").alias("season"), F.col("a.team").alias("home"), F.col("b.team").alias("away"), (F.col("a.goals_for") - F.col("b.goals_for")).cast("double").alias("margin"))


def replayed(t, rules):
    m = matches(t)
    m = cut(m.withColumn("match_id", F.col("match_id") * 1000 + F.col("home")))
    pool = R.pools(m)
    return R.replay(m.join(pool, m["home"] == pool["player"]).drop("player"), rules)


#: The replay as SQL: a step for each match of a pool, with the ratings of all its teams in one list.
REPLAY = """
, g as (select league, match_id, min(day) as day, min((team, goals_for)) as a, max((team, goals_for)) as b from history group by all having count(*) >= 2),
m as (select league, match_id * 1000 + a[1] as match_id, day, year(day)::int as season, a[1] as home, b[1] as away, (a[2] - b[2])::double as margin from g),
edges as (select home as x, away as y from m union select away, home from m),
pools as (with recursive r(x, y) as (select x, x from edges union select r.x, e.y from r join edges e on r.y = e.x) select x as player, min(y) as pool from r group by x),
n as (select p.pool, m.*, (dense_rank() over (order by season))::int as s, row_number() over (partition by p.pool order by day, match_id) as i from m join pools p on p.player = m.home),
t as (select pool, player, (row_number() over (partition by pool order by player))::int as k from pools),
o as (select n.*, a.k as h, b.k as w from n join t a on a.pool = n.pool and a.player = n.home join t b on b.pool = n.pool and b.player = n.away),
z as (select pool, list_transform(range(0, count(*)), lambda x: 1500.0::double) as r from t group by pool),
run as (with recursive run(pool, step, i, s, r, match_id, season, result, rh, ra, p) as (
  select pool, k.step, 0::bigint, 0, r, null::bigint, null::int, null::int, null::double, null::double, null::double from z, (values (10.0::double), (20.0::double), (40.0::double)) k(step)
  union all
  select pool, step, i, s, list_transform(r, lambda v, j: case when j = h then v + move when j = w then v - move else v end), match_id, season, result, rh, ra, p from (
    select *, step * (case when margin > 0 then 1.0::double when margin < 0 then 0.0::double else 0.5::double end - p) as move from (
      select *, 1 / (1 + pow(10.0::double, -(rh + 60 - ra) / 400)) as p from (
        select q.pool, q.step, o.i, o.s, q.r, o.match_id, o.season, sign(o.margin)::int as result, o.margin, o.h, o.w, q.r[o.h] as rh, q.r[o.w] as ra from (
          select run.pool, run.step, run.i, case when run.s in (0, x.s) then run.r else list_transform(run.r, lambda v: 1500 + (v - 1500) * pow(0.75::double, x.s - run.s)) end as r
          from run join o x on x.pool = run.pool and x.i = run.i + 1) q join o on o.pool = q.pool and o.i = q.i + 1)))
) select * from run where i > 0)
"""


@query("m7_rating_replay_by_pool", "history", REPLAY + "select pool, match_id, step, round(rh, 4) as rating_home, round(ra, 4) as rating_away, round(p, 6) as p from run")
def replay(t):
    """Three step sizes in one pass, ratings drawn to the mean between seasons; each pool of teams that met is one task."""
    got = replayed(t, R.Ratings(steps=STEPS, home=60.0))
    return got.select("pool", "match_id", "step", (F.round("rating_home", 4) + 0.0).alias("rating_home"), (F.round("rating_away", 4) + 0.0).alias("rating_away"), F.round("p", 6).alias("p"))


@query("m8_draw_margin_calibration", "history", REPLAY + """
, l as (select step, g.margin, avg(-ln(greatest(1e-15, case when result > 0 then h when result < 0 then 1 - d else d - h end))) as log_loss, count(*) as n from (
  select step, g.margin, result, 1 / (1 + pow(10.0::double, -(rh + 60 - ra - g.margin) / 400)) as h, 1 / (1 + pow(10.0::double, -(rh + 60 - ra + g.margin) / 400)) as d from run, (values (0.0::double), (50.0::double), (100.0::double), (150.0::double)) g(margin)) g group by all)
select step, margin, round(log_loss, 6) as log_loss, n, margin = arg_min(margin, (log_loss, margin)) over (partition by step) as best from l""")
def margins(t):
    """Step sizes by draw margins, all from one replay."""
    return rounded(R.draw_margins(replayed(t, R.Ratings(steps=STEPS, home=60.0)), MARGINS, 60.0))


@query("m7_rating_replay_by_margin")
def replay_by_margin(t):
    """Steps that grow with the margin; a team reverts towards 1505 when its own season changes."""
    return rounded(replayed(t, R.Ratings(steps=(20.0,), home=75.0, mean=1505.0, own_seasons=True, by_margin=True)).drop("step"))


@query("m3_dispersion_by_likelihood", "history", """
, m as (select league, goals_for::bigint as y, avg(goals_for) over (partition by team) as rate from history),
u as (select league, j::double as v, count(*)::double as a, 0.0::double as b, true as over from m, range(0, 5000) g(j) where j < y group by all union all select league, rate, count(*), sum(y), false from m group by league, rate),
f as (with recursive s as (
  select distinct league, ln(0.0001::double) as low, ln(3.0::double) as high, 0 as i from u
  union all
  select league, low + (high - low) * greatest(k - 1, 0) / 15, low + (high - low) * least(k + 1, 15) / 15, i + 1 from (
    select league, low, high, i, arg_max(k, (l, -k)) as k from (
      select s.league, low, high, i, k, sum(case when over then a * ln(r + v) else a * r * ln(r) - (a * r + b) * ln(r + v) end) as l
      from (select s.*, k, exp(-(low + (high - low) * k / 15)) as r from s, range(0, 16) g(k) where i < 7) s join u using (league) group by s.league, low, high, i, k) group by league, low, high, i)
) select league, exp((low + high) / 2) as alpha from s where i = 7)
select league, round(alpha, 5) as alpha from f""")
def likelihood(t):
    """Dispersion about each team's own rate, of greatest likelihood."""
    rate = t.history().groupBy("team").agg(F.avg("goals_for").alias("rate"))
    return rounded(R.negative_binomial(t.history().join(rate, "team"), "goals_for", "league"), 5)


@query("m6_refined_goal_rates", "quotes fair", """
, m as (select market, avg(p) filter (outcome = 'A') as p_home, avg(p) filter (outcome = 'R') as p_away, 0.3 + avg(p) filter (outcome = 'N') as p_over from fair group by market),
g as (select i, i * 0.05::double as l, k, exp(-i * 0.05::double) * pow(i * 0.05::double, k) / factorial(k::int) as pk from range(1, 86) a(i), range(0, 11) b(k)),
c as (select a.i, b.i as j, sum(a.pk * b.pk) filter (a.k > b.k) as ph, sum(a.pk * b.pk) filter (a.k < b.k) as pa, sum(a.pk * b.pk) filter (a.k + b.k > 2.5) as po from g a, g b group by all),
e as (select market, i, j, (ph - p_home) ** 2 + (pa - p_away) ** 2 + (po - p_over) ** 2 as e from m, c where i % 5 = 0 and j % 5 = 0 and i <= 80 and j <= 80),
b as (select market, arg_min(i, (e, i, j)) as bi, arg_min(j, (e, i, j)) as bj, min(e) as coarse from e group by market),
f as (select m.market, c.i, c.j, coarse, (ph - p_home) ** 2 + (pa - p_away) ** 2 + (po - p_over) ** 2 as e from b join m using (market) join c on c.i between bi - 5 and bi + 5 and c.j between bj - 5 and bj + 5)
select market, round(arg_min(i, (e, i, j)) * 0.05::double, 6) as lambda_home, round(arg_min(j, (e, i, j)) * 0.05::double, 6) as lambda_away, round(min(e), 7) as error, round(min(coarse), 7) as coarse_error from f group by market""")
def refined(t):
    of = lambda o: F.avg(F.when(F.col("outcome") == o, F.col("p")))
    m = fair_by_book(t.quotes(), ("A", "N", "R")).groupBy("market").agg(of("A").alias("p_home"), of("R").alias("p_away"), (0.3 + of("N")).alias("p_over"))
    return rounded(M.refined_rates(m, ["market"], 16, 0.25, 5), 7)


@query("t4_distinct_participants", "bets", """
, o as (select *, row_number() over (partition by day order by p * odds desc, bet_id) as i from bets), d as (select day, max(i) as n from o group by day),
g as (with recursive g(day, i, used, bet_id, took) as (
  select day, 0::bigint, []::varchar[], null::bigint, false from d
  union all
  select g.day, o.i, case when list_has_any(g.used, ['t' || o.team, 'e' || o.event]) then g.used else list_concat(g.used, ['t' || o.team, 'e' || o.event]) end, o.bet_id, not list_has_any(g.used, ['t' || o.team, 'e' || o.event])
  from g join o on o.day = g.day and o.i = g.i + 1
) select day, i, bet_id from g where took), k as (select *, row_number() over (partition by day order by i) as place, count(*) over (partition by day) as n from g)
select day, bet_id, place::int as place, greatest(n - 3, 0) as left from k where place <= 3""")
def distinct_participants(t):
    """The best three bets of a day that share neither team nor event; `left` counts those that the limit leaves."""
    who = F.array(F.concat(F.lit("t"), F.col("team").cast("string")), F.concat(F.lit("e"), F.col("event").cast("string")))
    return X.distinct_top(t.bets(), ["day"], F.struct((-F.col("p") * F.col("odds")).alias("v"), F.col("bet_id").alias("b")), "bet_id", who, 3)


@query("w20_cards_without_repeats", "bets", """
, r as (select *, (row_number() over (partition by sport, day order by md5(bet_id::varchar)) - 1) // 3 as card from bets), c as (select sport, day, card, count(distinct team) as k, exp(sum(ln(p))) as joint_p, min(y) as won from r group by all having count(*) = 3)
select sport, day, card::int as card, round(joint_p, 6) as joint_p, won, dropped from (select *, count(*) filter (k < 3) over (partition by sport, day) as dropped from c) where k = 3""")
def whole_cards(t):
    return rounded(X.cards_without_repeats(t.bets(), ["sport", "day"], F.md5(F.col("bet_id").cast("string").cast("binary")), 3, "team"))


def card_legs(t):
    """The first four events of each order as a card; a leg's chance is that of its event and side, a card's weight its number of legs."""
    total, n = F.sum(F.round(F.col("p") * 10_000).cast("long")), F.count("p")
    side = t.bets().groupBy("event", "sport").agg((F.floor((2 * total + n) / (2 * n)) / 10_000).alias("p"))  # whole numbers: no order of a sum shows where a mean lies half-way
    legs = t.bets().groupBy(F.floor(F.col("bet_id") / 100).alias("card"), "event").agg(F.min_by("sport", "bet_id").alias("sport"), F.min("bet_id").alias("bet_id"))
    first = K.top_n(legs, ["card"], [F.col("bet_id")], 4)
    size = first.groupBy("card").agg(F.count(F.lit(1)).alias("w"))
    return first.join(side, ["event", "sport"]).join(size, "card")


@query("a31_overlapping_cards", "bets", """
, side as (select event, sport, round(avg(p), 4) as p from bets group by all), l as (select bet_id // 100 as card, event, arg_min(sport, bet_id) as sport, min(bet_id) as bet_id from bets group by all),
f as (select *, row_number() over (partition by card order by bet_id) as r, from l), c as (select f.card, f.event, f.sport, side.p from f join side using (event, sport) where r <= 4),
s as (select card, count(*)::double as w, exp(sum(ln(p))) as pj from c group by card),
j as (select a.card as x, b.card as y, exp(sum(ln(b.p))) as shared, bool_and(a.sport = b.sport) as agree from c a join c b on a.event = b.event and a.card <> b.card group by all),
k as (select sx.w * sy.w * (case when agree then sx.pj * sy.pj / shared else 0 end - sx.pj * sy.pj) / sqrt(sx.pj * (1 - sx.pj) * sy.pj * (1 - sy.pj)) as v from j join s sx on sx.card = x join s sy on sy.card = y)
select (select count(*) from s) as cards, round((select sum(w) ** 2 from s) / ((select sum(w * w) from s) + (select sum(v) from k)), 4) as n_eff""")
def overlapping(t):
    """Cards that share legs, counted by how much they say together."""
    return rounded(X.overlap_size(card_legs(t), "card", "event", "sport", "p", "w", 4), 4)


@query("a33_log_growth", "bets", """
, f as (select *, row_number() over (partition by event order by bet_id) as r from bets), l as (select event, list(p order by r) as p, list(odds order by r) as o, count(*)::int as n from f where r <= 5 group by event having count(*) >= 2),
x as (select event, n, k, list_product(list_transform(range(0, n), lambda i: case when (k >> i) & 1 = 1 then p[i + 1] else 1 - p[i + 1] end)) as q,
  case when k = (1 << n) - 1 then list_product(o) - 1 else -1.0 end as a, list_sum(list_transform(range(0, n), lambda i: case when (k >> i) & 1 = 1 then o[i + 1] - 1 else -1.0 end)) / n as b,
  list_sum(list_transform(list_filter(range(1, (1 << n)::bigint), lambda m: bit_count(m::int) = 2), lambda m: case when (m & k) = m then list_product(list_transform(range(0, n), lambda i: case when (m >> i) & 1 = 1 then o[i + 1] else 1.0 end)) - 1 else -1.0 end)) / (n * (n - 1) / 2) as c
  from l, range(0, 32) g(k) where k < (1 << n))
select event, n as legs, round(sum(q * ln(1 + 0.02 * a)), 6) as card, round(sum(q * ln(1 + 0.02 * b)), 6) as singles, round(sum(q * ln(1 + 0.02 * c)), 6) as doubles from x group by all""")
def log_growth(t):
    """Expected log growth of the first five bets of an event as one card, as singles and as all doubles, over all outcomes."""
    first = K.top_n(t.bets(), ["event"], [F.col("bet_id")], 5)
    legs = first.groupBy("event").agg(F.sort_array(F.collect_list(F.struct("place", "p", "odds"))).alias("x")).where(F.size("x") >= 2)
    of = lambda lines: X.growth(F.col("x"), 0.02, lines)
    return rounded(legs.select("event", F.size("x").alias("legs"), of(None).alias("card"), of(1).alias("singles"), of(2).alias("doubles")))


@query("a34_loser_rank", "bets", """
, f as (select *, row_number() over (partition by event order by bet_id) as r from bets), l as (select event, list(p order by p desc, bet_id) as p, list(y order by p desc, bet_id) as y from f where r <= 4 group by event having count(*) = 4),
x as (select *, list_product(p) as whole, list_sum(y) as wins from l), u as (select r, p[r] as q, y[r] as y, whole, wins from x, range(1, 5) g(r) where wins < 4),
s as (select r as rank, count(*) as failed, count(*) filter (wins = 3 and y = 0) as observed, sum((1 - q) * whole / q / (1 - whole)) as expected from u group by r)
select rank::int as rank, failed, observed, round(expected, 6) as expected, round((observed - expected) / sqrt(failed * (expected / failed) * (1 - expected / failed)), 6) as z from s""")
def loser_rank(t):
    """Which leg was the only loser of the failed sets of four, against the chances."""
    first = K.top_n(t.bets(), ["event"], [F.col("bet_id")], 4)
    order = F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("m"), "bet_id", "p", "y")))
    sets = first.groupBy("event").agg(order.alias("x")).where(F.size("x") == 4)
    return rounded(X.loser_ranks(sets.select("event", F.col("x.p").alias("p"), F.col("x.y").alias("y")), "p", "y", 4))
