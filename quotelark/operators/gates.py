"""Labels, grades and decisions with their reasons. Every failed rule is named; nothing is dropped silently."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRADES = ("A+", "A", "B", "C", "Reject")


def reasons(rules: Mapping[str, Column]) -> Column:
    """Codes of the rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules.items()]))


def validation(odds: Column, expected: int) -> Column:
    """Why a book's odds can't be used: count, range or margin; null if they can."""
    total = F.aggregate(odds, F.lit(0.0), lambda s, o: s + 1 / o)
    return F.when(F.size(odds) != expected, "COUNT").when(F.exists(odds, lambda o: o <= 1), "RANGE").when((total < 0.9) | (total > 1.5), "MARGIN")


def confidence(books: Column, std: Column, many: int = 6, some: int = 4, tight: float = 0.02, loose: float = 0.04) -> Column:
    return F.when((books >= many) & (std <= tight), "High").when((books >= some) & (std <= loose), "Medium").otherwise("Low")


#: Fixed values of the ladder: net EV, edge in percentage points and books that each grade needs at least.
RUNGS = {"A+": (0.08, 4.0, 5), "A": (0.05, 3.0, 4)}
B_EV, C_EV = 0.02, 0.0


def grade(ev: Column, edge_pp: Column, books: Column, hard: Mapping[str, Column], info_risk: Column, rungs: Mapping[str, tuple] = RUNGS, b_ev: float = B_EV, c_ev: float = C_EV) -> Column:
    """A hard gate (stale price, unlike rules, thin liquidity, bad data) rejects, then too little EV; below B's EV it is C.

    A+ and A need EV, edge, books and no material information risk; all else that passed is B.
    """
    out = F.when(F.size(reasons(hard)) > 0, "Reject").when(ev.isNull() | (ev < c_ev), "Reject").when(ev < b_ev, "C")
    for name, (least_ev, least_edge, least_books) in rungs.items():
        out = out.when((ev >= least_ev) & (edge_pp >= least_edge) & (books >= least_books) & ~info_risk, name)
    return out.otherwise("B")


def evidence_grade(p: Column, sigma: Column, odds: Column, state: Column, least_state: int) -> Column:
    """A+ if EV is positive at p - 1.645 sigma and there is enough evidence, A at p - sigma, B at p, else NONE."""
    return F.when(p * odds <= 1, "NONE").when(((p - 1.645 * sigma) * odds > 1) & (state >= least_state), "A+").when((p - sigma) * odds > 1, "A").otherwise("B")


def data_quality(books: Column, age_minutes: Column, many: int = 4, some: int = 2, fresh: float = 720.0, old: float = 1380.0) -> tuple[Column, Column]:
    """(label, reasons it isn't the best) by number of books and age of the quotes."""
    label = F.when((books >= many) & (age_minutes <= fresh), "GOOD").when((books >= some) & (age_minutes <= old), "FAIR").otherwise("POOR")
    return label, reasons({"FEW_BOOKS": books < many, "OLD_QUOTE": age_minutes > fresh})


def liquidity(stake: Column, available: Column) -> Column:
    return F.when(available.isNull(), "UNKNOWN").when(available >= stake, "LIQUID").otherwise("THIN")


def payout_floor(graded: Column, odds: Column, least: float) -> Column:
    return F.when(graded.isin("A+", "A", "B") & (odds < least), "C").otherwise(graded)


def qualify(why: Column, horizon_code: str, paper: Column) -> Column:
    """BET without reasons, WATCH if only the horizon failed, PAPER_ONLY where money is off, else REJECT."""
    return F.when(F.size(why) == 0, F.when(paper, "PAPER_ONLY").otherwise("BET")).when((F.size(why) == 1) & F.array_contains(why, horizon_code), "WATCH").otherwise("REJECT")


def decide(why: Column, hard: Sequence[str], multi: str | None = None) -> Column:
    """A hard reason rejects; `multi` alone makes a leg of a multi; any other reason is watched."""
    out = F.when(F.arrays_overlap(why, F.array(*map(F.lit, hard))), "REJECT")
    if multi:
        out = out.when((F.size(why) == 1) & F.array_contains(why, multi), "MULTI")
    return out.when(F.size(why) > 0, "WATCH").otherwise("PICK")


def best_of_latest(rows: DataFrame, key: str, ts: str, value: str, tie: str) -> DataFrame:
    """Of each key's latest snapshot, the row of the largest value."""
    latest = rows.withColumn("_m", F.max(ts).over(W.partitionBy(key))).where(F.col(ts) == F.col("_m")).drop("_m")
    return latest.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(value), tie))).where("_r = 1").drop("_r")


def due(targets: DataFrame, done: DataFrame, key: str, start: str, now: Column, minutes: int) -> DataFrame:
    """Targets that start within the window after now and are not done."""
    ahead = F.unix_micros(F.col(start).cast("timestamp")) - F.unix_micros(now.cast("timestamp"))
    return targets.where((ahead > 0) & (ahead <= minutes * 60_000_000)).join(done, key, "left_anti")


def only_reasons(why: Column, allowed: Sequence[str]) -> Column:
    return F.size(F.array_except(why, F.array(*map(F.lit, allowed)))) == 0


def masked(rows: DataFrame, guards: DataFrame, key: str, day: str, most: int = 10_000) -> DataFrame:
    """rows without those in a sealed period (key, begin, end). Up to `most` periods are broadcast; more are joined on their key."""
    g = guards.select(F.col(key).alias("_k"), "begin", "end")
    g = F.broadcast(g) if g.limit(most + 1).count() <= most else g
    return rows.join(g, (F.col(key) == F.col("_k")) & F.col(day).between(F.col("begin"), F.col("end")), "left_anti")


def folds(rows: DataFrame, season: str) -> DataFrame:
    """Expanding walk-forward folds: fold i trains on the first i seasons and evaluates the next."""
    names = rows.select(season).distinct()
    order = names.withColumn("i", F.row_number().over(W.orderBy(season)))  # a row a season
    table = order.select(F.col("i").alias("fold"), (F.col("i") + 1).alias("next"))
    placed = rows.join(F.broadcast(order), season)
    use = F.when(F.col("i") <= F.col("fold"), "train").when(F.col("i") == F.col("next"), "evaluate")
    last = order.agg(F.max("i").alias("m"))
    return placed.join(F.broadcast(table.crossJoin(last).where("fold < m").drop("m")), F.col("i") <= F.col("next")).withColumn("use", use).drop("i", "next")


def chronology_violations(rows: DataFrame, by: str, at: str, seq: str) -> DataFrame:
    """Rows whose time is before that of the row ahead of them in sequence."""
    w = W.partitionBy(by).orderBy(seq)
    return rows.withColumn("before", F.lag(at).over(w)).where(F.col(at) < F.col("before"))


def window_violations(rows: DataFrame, as_of: str, dates: str) -> DataFrame:
    """Rows whose window (an array of dates) holds the as-of date or a later one, with the first such date."""
    late = F.array_min(F.filter(dates, lambda d: d >= F.col(as_of)))
    return rows.withColumn("violation", late).where("violation is not null")


def test_period_violations(development: DataFrame, day: str, start: str) -> DataFrame:
    """Development rows that lie in the test period."""
    return development.where(F.col(day) >= F.lit(start).cast("date"))
