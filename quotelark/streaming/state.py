"""Keyed state of streams that outlives batches and ends by itself: what is kept for a key goes when event time has passed it by.

State lives in RocksDB on the executors, with changes in the checkpoint, so its size isn't bounded by their memory and a lost executor
takes none of it along. Rows older than the watermark are dropped by the engine before they get here; a key's state ends where no
row of the key can be in time any more, so no result depends on state that has ended.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB; the session's own setting is as before afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


#: Buckets that keys fall into by a hash. One call of Python serves all of a bucket's keys in a batch, as calls cost far more than rows.
BUCKETS = 32


def bucketed(rows: DataFrame, key: Sequence[str], buckets: int) -> DataFrame:
    return rows.withColumn("_key", F.to_json(F.struct(*key))).withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))


def keep(state: GroupState, ends: Sequence[int], *values: Sequence) -> None:
    """What is open past the watermark stays in the state until the next of its ends; the state goes when nothing is."""
    now = state.getCurrentWatermarkMs()
    left = [k for k, end in enumerate(ends) if end > now]
    if left:
        state.update(([ends[k] for k in left], *([v[k] for k in left] for v in values)))
        state.setTimeoutTimestamp(min(ends[k] for k in left))
    elif state.exists:
        state.remove()


def first_of_key(rows: DataFrame, key: Sequence[str], order: Sequence[str], ts: str, ends: str, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """rows with `status`: KEPT for one row a key, the first by `order` of the first batch that has the key, and SKIPPED for all others.

    `ends` is a time after which no row of the key can come. State: each key that is still open, and its end.
    """
    columns = [c for c in rows.columns if c != ends]
    schema = StructType([*(f for f in rows.schema if f.name != ends), StructField("status", StringType())])

    def choose(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was_open = dict(zip(*map(list, reversed(state.get)))) if state.exists else {}
        if state.hasTimedOut:
            keep(state, list(was_open.values()), list(was_open))
            return
        best = None
        for frame in frames:
            old = frame["_key"].isin(was_open.keys())
            if old.any():
                yield frame.loc[old, columns].assign(status="SKIPPED")
            fresh = frame[~old] if best is None else pd.concat([best, frame[~old]])
            fresh = fresh.sort_values(list(order), kind="stable")
            again = fresh.duplicated("_key")
            if again.any():
                yield fresh.loc[again, columns].assign(status="SKIPPED")
            best = fresh[~again]
        if best is not None and len(best):
            was_open |= dict(zip(best["_key"], best[ends].tolist()))
            yield best[columns].assign(status="KEPT")
        keep(state, list(was_open.values()), list(was_open))

    keyed = bucketed(rows.withColumn(ends, F.unix_millis(ends)), key, buckets).withWatermark(ts, late).groupBy("_bucket")
    return keyed.applyInPandasWithState(choose, schema, "ends array<long>, open array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def latest_observed(rows: DataFrame, key: Sequence[str], seen: str, value: str, late: str = "1 day", idle: str = "30 days", buckets: int = BUCKETS) -> DataFrame:
    """(key, seen, found, status, value) whenever a key's latest observation changes, in update mode.

    `value` becomes text; it is null in a CONFLICT, where several values (their number is `found`) were seen at the latest time. State: a
    key's latest time and the values seen then; older ones go at once. A key that has been still for `idle` is forgotten: what it
    last said stays in the output, and a newer observation begins anew.
    """
    fields, idle_ms = {f.name: f for f in rows.schema}, int(pd.Timedelta(idle).total_seconds() * 1000)
    schema = StructType().add("_key", "string").add("_seen", "long").add("found", "long").add("status", "string").add(value, "string")

    def follow(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {k: (at, frozenset(found)) for _, k, at, found in zip(*state.get)} if state.exists else {}
        before = dict(known)
        if not state.hasTimedOut:
            for frame in frames:
                newest = frame.groupby("_key")["_seen"].transform("max")
                last = frame[frame["_seen"] == newest].drop_duplicates(["_key", value])
                for k, some in last.groupby("_key"):
                    at, values = int(some["_seen"].iat[0]), frozenset(some[value].dropna())
                    was = known.get(k)
                    if was is None or at >= was[0]:
                        known[k] = (at, values | was[1] if was and was[0] == at else values)
        changed = [(k, at, len(found), "OK" if len(found) == 1 else "CONFLICT", next(iter(found)) if len(found) == 1 else None) for k, (at, found) in known.items() if before.get(k) != (at, found)]
        if changed:
            yield pd.DataFrame(changed, columns=["_key", "_seen", "found", "status", value])
        keep(state, [at // 1000 + idle_ms for at, _ in known.values()], list(known), [at for at, _ in known.values()], [sorted(found) for _, found in known.values()])

    text = rows.select(*key, seen, F.unix_micros(seen).alias("_seen"), F.col(value).cast("string").alias(value)).withWatermark(seen, late)
    kept = "ends array<long>, keys array<string>, seen array<long>, found array<array<string>>"
    changed = bucketed(text, key, buckets).groupBy("_bucket").applyInPandasWithState(follow, schema, kept, "update", GroupStateTimeout.EventTimeTimeout)
    of = F.from_json("_key", StructType([fields[k] for k in key]))
    return changed.select(*(of[k].alias(k) for k in key), F.timestamp_micros("_seen").alias(seen), "found", "status", value)
