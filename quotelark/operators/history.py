"""Strictly-prior features: every frame ends before the current row, or before its date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def prior(by: Sequence[str], order: Sequence[str], rows: int | None = None):
    """The last `rows` rows before the current one, or all of them."""
    start = W.unboundedPreceding if rows is None else -rows
    return W.partitionBy(*by).orderBy(*order).rowsBetween(start, -1)


def prior_sums(rows: DataFrame, by: str, day: str, order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """rows with sums over all earlier rows of the group (by day, then order), and `prior_n`, their number.

    Few groups may hold all rows, so sums are carried over days (a row a group and day), and only a day's rows are sorted.
    """
    valued = rows.select("*", *[v.alias(f"_{k}") for k, v in values.items()])
    daily = valued.groupBy(by, day).agg(*[F.sum(f"_{k}").alias(f"_d{k}") for k in values], F.count(F.lit(1)).alias("_dn"))
    w = prior([by], [day])
    carried = daily.select(F.col(by).alias("_by"), F.col(day).alias("_day"), *[F.sum(f"_d{k}").over(w).alias(f"_c{k}") for k in [*values, "n"]])
    inside = prior([by, day], order)
    zero = lambda c: F.coalesce(c, F.lit(0))
    within = valued.select("*", *[F.sum(f"_{k}").over(inside).alias(f"_w{k}") for k in values], F.count(F.lit(1)).over(inside).alias("_wn"))
    both = within.join(carried, (F.col(by) == F.col("_by")) & (F.col(day) == F.col("_day")))
    return both.select(*rows.columns, *[(zero(F.col(f"_w{k}")) + zero(F.col(f"_c{k}"))).alias(k) for k in values], (F.col("_wn") + zero(F.col("_cn"))).alias("prior_n"))


def rolling_mean(value: str, by: Sequence[str], order: Sequence[str], rows: int, least: int = 1) -> Column:
    """Mean of the last rows; null under `least` values. Nulls count as rows of the frame, not as values."""
    w = prior(by, order, rows)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def form(history: DataFrame, rows: int, context: Sequence[str] = ()) -> DataFrame:
    """Last-N form of each team, or of each team in a context (its home matches, its away matches): matches seen, goals for and against, spread of the difference."""
    w = prior(["team", *context], ["day", "match_id"], rows)
    diff = F.col("goals_for") - F.col("goals_against")
    return history.select(
        "team", "match_id", "day",
        F.count(F.lit(1)).over(w).alias("window_matches"), F.avg("goals_for").over(w).alias("form_for"), F.avg("goals_against").over(w).alias("form_against"),
        F.when(F.count(diff).over(w) >= 2, F.stddev_pop(diff).over(w)).alias("form_spread"),
        (F.row_number().over(W.partitionBy("team", *context).orderBy("day", "match_id"))).alias("appearance"), *context,
    )


def conversion(history: DataFrame, rows: int, goals: str, shots: str) -> DataFrame:
    """Mean goals over mean shots of the last rows; nulls are skipped inside them, no shots give null."""
    w = prior(["team"], ["day", "match_id"], rows)
    return history.select("team", "match_id", F.try_divide(F.avg(goals).over(w), F.avg(shots).over(w)).alias("conversion"))


def earlier_dates(rows: DataFrame, by: str, day: str, value: str, pseudo: float) -> DataFrame:
    """Rate over strictly earlier dates, shrunk to the rate of all groups on earlier dates; rows of one day never see each other.

    Values are summed by (group, day) and by day first, so the windows run over days.
    """
    daily = rows.groupBy(by, day).agg(F.sum(value).alias("v"), F.count(F.lit(1)).alias("n"))
    own = W.partitionBy(by).orderBy(day).rowsBetween(W.unboundedPreceding, -1)
    league = rows.groupBy(day).agg(F.sum(value).alias("lv"), F.count(F.lit(1)).alias("ln")).withColumn("year", F.year(day))
    years = league.groupBy("year").agg(F.sum("lv").alias("yv"), F.sum("ln").alias("yn"))
    y = W.partitionBy(F.lit(1)).orderBy("year").rowsBetween(W.unboundedPreceding, -1)  # a row a year
    carried = years.select("year", F.coalesce(F.sum("yv").over(y), F.lit(0.0)).alias("cv"), F.coalesce(F.sum("yn").over(y), F.lit(0)).alias("cn"))
    d = W.partitionBy("year").orderBy(day).rowsBetween(W.unboundedPreceding, -1)
    rate = league.join(F.broadcast(carried), "year").select(
        F.col(day), F.try_divide(F.coalesce(F.sum("lv").over(d), F.lit(0.0)) + F.col("cv"), F.coalesce(F.sum("ln").over(d), F.lit(0)) + F.col("cn")).alias("league_rate")
    )
    state = daily.select(by, day, F.coalesce(F.sum("v").over(own), F.lit(0.0)).alias("pv"), F.coalesce(F.sum("n").over(own), F.lit(0)).alias("pn")).join(rate, day)
    shrunk = (F.col("pv") + pseudo * F.col("league_rate")) / (F.col("pn") + pseudo)
    return state.select(by, day, F.col("pn").alias("prior_n"), "league_rate", F.coalesce(shrunk, F.col("league_rate")).alias("shrunk_rate"))


def congestion(history: DataFrame, days: int) -> DataFrame:
    """Matches of the team in the `days` days before; the same day is not before."""
    at = F.datediff("day", F.lit("1970-01-01"))
    w = W.partitionBy("team").orderBy("d").rangeBetween(-days, -1)
    return history.withColumn("d", at).select("team", "match_id", "day", F.count(F.lit(1)).over(w).alias("recent"))


def rest_days(history: DataFrame, cap: int) -> DataFrame:
    w = W.partitionBy("team").orderBy("day", "match_id")
    gap = F.datediff("day", F.lag("day").over(w))
    return history.select("team", "match_id", "day", F.least(F.coalesce(gap, F.lit(cap)), F.lit(cap)).alias("rest"))


def laplace_frequencies(rows: DataFrame, by: str, order: Sequence[str], outcome: str, values: Sequence[str], alpha: float) -> DataFrame:
    """Smoothed outcome frequencies over earlier rows of the group; order begins with the day."""
    sums = prior_sums(rows, by, order[0], order[1:], {f"_f{v}": (F.col(outcome) == v).cast("int") for v in values})
    return sums.select(by, *order, *[((F.col(f"_f{v}") + alpha) / (F.col("prior_n") + alpha * len(values))).alias(f"f_{v.lower()}") for v in values])


def strengths(matches: DataFrame, pseudo: float) -> DataFrame:
    """Attack and defence ratios to the league before each match, shrunk to 1 with pseudo-matches: running sums, no loop."""
    league = prior_sums(matches, "league", "day", ["match_id"], {"_goals": F.col("goals_for")})
    base = F.when(F.col("prior_n") > 0, F.col("_goals") / F.col("prior_n"))
    w = prior(["league", "team"], ["day", "match_id"])

    def ratio(value: str) -> Column:
        s, n = F.coalesce(F.sum(value).over(w), F.lit(0.0)), F.count(F.lit(1)).over(w)
        return F.coalesce((s / F.when(base > 0, base) + pseudo) / (n + pseudo), F.lit(1.0))

    return league.select("league", "team", "match_id", "day", ratio("goals_for").alias("attack"), ratio("goals_against").alias("defence"))


def head_to_head(matches: DataFrame) -> DataFrame:
    """Earlier wins of the current a and b against each other, whichever side they had."""
    w = prior(["pair"], ["day", "match_id"])
    keyed = matches.withColumn("pair", F.concat_ws("|", F.least("a", "b"), F.greatest("a", "b"))).withColumn("low_won", ((F.col("a") <= F.col("b")) == (F.col("a_won") == 1)).cast("int"))
    low, n = F.coalesce(F.sum("low_won").over(w), F.lit(0)), F.count(F.lit(1)).over(w)
    first = F.col("a") <= F.col("b")
    return keyed.select("match_id", "a", "b", F.when(first, low).otherwise(n - low).alias("a_wins"), F.when(first, n - low).otherwise(low).alias("b_wins"))


def drawdown(bets: DataFrame, by: Sequence[str], order: Sequence[str], start: float = 0.0) -> DataFrame:
    """Running balance, its peak (from the opening balance) and the fall from it."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    cum = bets.withColumn("balance", start + F.sum("profit").over(w))
    peak = cum.withColumn("peak", F.greatest(F.lit(start), F.max("balance").over(w)))
    return peak.withColumn("fall", F.col("peak") - F.col("balance"))


def losing_streak(bets: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Longest run of losses: gaps and islands."""
    w = W.partitionBy(*by).orderBy(*order)
    runs = bets.withColumn("island", F.row_number().over(w) - F.sum("lost").over(w))
    lost = runs.where("lost = 1").groupBy(*by, "island").agg(F.count(F.lit(1)).alias("n"))
    return lost.groupBy(*by).agg(F.max("n").alias("streak"))


def daily_cap(bets: DataFrame, day: str, event: str, order: Sequence[Column], cap: float, stake: float) -> DataFrame:
    """One bet an event, best first, while the day's flat stakes stay within the cap."""
    once = bets.withColumn("_e", F.row_number().over(W.partitionBy(day, event).orderBy(*order))).where("_e = 1").drop("_e")
    return once.withColumn("place", F.row_number().over(W.partitionBy(day).orderBy(*order))).where(F.col("place") <= int(cap // stake))
