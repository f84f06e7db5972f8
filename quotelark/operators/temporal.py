"""Joins in time: as-of, interval, nearest and latest, with statuses instead of guesses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotelark.operators.metrics import percentiles


def micros(ts: str | Column) -> Column:
    """Microseconds of a timestamp with or without a zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def as_of(asks: DataFrame, facts: DataFrame, key: str, at: str, ts: str, values: Sequence[str], tie: str) -> DataFrame:
    """asks with the last fact of their key at or before `at`: values as as_of_<value>, and as_of_ts.

    Both sides are united and read once by a window, so the work is a sort by (key, time), whatever the number of matches.
    """
    left = asks.withColumn("_t", F.col(at)).withColumn("_ask", F.lit(1)).withColumn("_tie", F.lit(None).cast(facts.schema[tie].dataType)).withColumn("_v", F.lit(None).cast(facts.select(F.struct(F.col(ts).alias("ts"), *values)).schema[0].dataType))
    right = facts.select(F.col(key), F.col(ts).alias("_t"), F.lit(0).alias("_ask"), F.col(tie).alias("_tie"), F.struct(F.col(ts).alias("ts"), *values).alias("_v"))
    w = W.partitionBy(key).orderBy("_t", "_ask", F.col("_tie").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_l", F.last("_v", ignorenulls=True).over(w)).where("_ask = 1")
    return both.select(*asks.columns, F.col("_l.ts").alias("as_of_ts"), *[F.col(f"_l.{v}").alias(f"as_of_{v}") for v in values])


def horizons(events: DataFrame, start: str, hours: Sequence[float]) -> DataFrame:
    """events with a row for each horizon: `hours_before` and the `cutoff` that many hours before the start."""
    grid = F.explode(F.array(*[F.lit(float(h)) for h in hours]))
    return events.withColumn("hours_before", grid).withColumn("cutoff", F.col(start) - F.make_dt_interval(secs=(F.col("hours_before") * 3600).cast("decimal(18,6)")))


def last_in_interval(entries: DataFrame, facts: DataFrame, key: str, after: str, before: str, ts: str, value: str, tie: str) -> DataFrame:
    """entries with the last fact strictly between `after` and `before`; null where there is none."""
    found = as_of(entries.withColumn("_before", F.col(before) - F.expr("INTERVAL '0.000001' SECOND")), facts, key, "_before", ts, [value], tie).drop("_before")
    inside = F.col("as_of_ts") > F.col(after)
    return found.withColumn("last_ts", F.when(inside, F.col("as_of_ts"))).withColumn(f"last_{value}", F.when(inside, F.col(f"as_of_{value}"))).drop("as_of_ts", f"as_of_{value}")


def latest_or_conflict(observations: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """The value of the latest observation; CONFLICT where that time has several."""
    newest = observations.groupBy(key).agg(F.max(ts).alias("latest"))
    at = observations.join(newest, key).where(F.col(ts) == F.col("latest")).groupBy(key, "latest").agg(F.count_distinct(value).alias("n"), F.max(value).alias("v"))
    return at.select(key, "latest", F.when(F.col("n") == 1, F.col("v")).alias(value), F.when(F.col("n") > 1, "CONFLICT").otherwise("OK").alias("status"))


def nearest_other_day(rows: DataFrame, key: str, day: str) -> DataFrame:
    """Days to the nearest other date of the same key."""
    w = W.partitionBy(key).orderBy(day)
    days = rows.select(key, day).distinct()
    before, after = F.datediff(day, F.lag(day).over(w)), F.datediff(F.lead(day).over(w), day)
    return days.withColumn("nearest", F.least(before, after))


def link_within(left: DataFrame, right: DataFrame, key: str, left_day: str, right_day: str, days: int, left_id: str, right_id: str) -> DataFrame:
    """MATCHED, AMBIGUOUS or UNMATCHED for each left row, by rows of the same key within `days`.

    Dates are bucketed by `days`, and a right row enters three buckets, so the range becomes an equi-join.
    """
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / max(days, 1))
    a = left.withColumn("_b", bucket(F.col(left_day)))
    b = right.select(F.col(key), F.col(right_id), F.col(right_day).alias("_day")).withColumn("_b", F.explode(F.array(*[bucket(F.col("_day")) + k for k in (-1, 0, 1)])))
    near = a.join(b, [key, "_b"]).where(F.abs(F.datediff(left_day, "_day")) <= days)
    found = near.groupBy(left_id).agg(F.count_distinct(right_id).alias("n"), F.min(right_id).alias("match"))
    out = left.join(found, left_id, "left").withColumn("candidates", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("candidates") == 1, "MATCHED").when(F.col("candidates") > 1, "AMBIGUOUS").otherwise("UNMATCHED")
    return out.withColumn("status", status).withColumn("match", F.when(F.col("candidates") == 1, F.col("match"))).drop("n")


def coverage(priced: DataFrame, limit_hours: float) -> DataFrame:
    """Share priced at all, share fresh, and median age, by horizon (few horizons, each with all entities)."""
    age = (micros("cutoff") - micros("as_of_ts")) / 3.6e9
    some = F.col("as_of_ts").isNotNull()
    aged = priced.withColumn("age", age)
    shares = aged.groupBy("hours_before").agg(F.count(F.lit(1)).alias("asked"), F.avg(some.cast("int")).alias("raw_share"), F.avg((some & (F.col("age") <= limit_hours)).cast("int")).alias("fresh_share"))
    middle = percentiles(aged, ["hours_before"], "age", [0.5]).select("hours_before", F.col("q")[0].alias("median_age"))
    return shares.join(middle, "hours_before", "left")
