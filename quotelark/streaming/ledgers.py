"""Structured Streaming forms of the ledgers: idempotent appends, upserts, joins and counters; state with an end is in state.py."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelark.sinks.ledger import append_unique


def read_files(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def appended(rows: DataFrame, path: str, checkpoint: str):
    """Everything that comes, as Parquet, each row once."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserts(rows: DataFrame, path: str, checkpoint: str):
    """Each micro-batch's changed rows into a folder of its own; latest_rows() reads the last one of each key."""
    return rows.writeStream.outputMode("update").foreachBatch(lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{path}/{k:08d}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_rows(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last row that upserts() wrote for each key."""
    rows = spark.read.parquet(f"{path}/*")
    fields = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), "batch").alias("x")).select(key, "x.*")


def scan_records(rows: DataFrame, path: str, checkpoint: str, scan: str, ts: str, started: str):
    """One record for each scan, failures too: the scan is taken if it lies at or after the workflow's start, never an older one."""

    def record(batch: DataFrame, k: int) -> None:
        one = batch.groupBy("entity", scan).agg(F.max(started).alias(started), F.count(F.lit(1)).alias("rows"), F.max(ts).alias("last"))
        status = F.when(F.col(started).isNull(), "NO_START").when(F.col(scan) < F.col(started), "OLD").otherwise("USABLE")
        one.withColumn("status", status).withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{path}/{k:08d}")

    return rows.writeStream.foreachBatch(record).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_to_ledger(rows: DataFrame, path: str, key: Sequence[str], order: Sequence[str], checkpoint: str, within: str | None = None):
    """Appends each key once. The ledger's anti-join admits keys, however late their rows are; no state is kept, so none is lost.

    within: the key's column that partitions the ledger, so that a micro-batch reads the folders of its own values only.
    """
    return rows.writeStream.foreachBatch(lambda batch, _: append_unique(batch, path, key, order, within) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quotes_before_start(entries: DataFrame, quotes: DataFrame, key: str, entry_ts: str, start_ts: str, quote_ts: str, late: str = "1 hour", horizon: str = "7 days") -> DataFrame:
    """Stream-stream join of entries with quotes strictly between entry and start; the horizon bounds the state of both sides."""
    a = entries.withWatermark(entry_ts, late).withColumnRenamed(key, "_key")
    b = quotes.withWatermark(quote_ts, late)
    inside = (F.col(quote_ts) > F.col(entry_ts)) & (F.col(quote_ts) < F.col(start_ts)) & (F.col(quote_ts) < F.col(entry_ts) + F.expr(f"INTERVAL {horizon}"))
    return a.join(b, (F.col("_key") == F.col(key)) & inside).drop("_key")


def captures(targets: DataFrame, quotes: DataFrame, key: str, start: str, ts: str, before: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Each target with its quotes of the last `before` its start; a target that gets none comes out with nulls.

    A left outer stream-stream join: the range bounds the state of both sides, and a target without a match is given up, and put out,
    once the watermark says that no quote of its range can come any more. `targets` and `quotes` share no other column name.
    """
    a = targets.withColumnRenamed(key, "_key").withWatermark(start, late)
    b = quotes.withWatermark(ts, late)
    inside = (F.col(ts) >= F.col(start) - F.expr(f"INTERVAL {before}")) & (F.col(ts) < F.col(start))
    return a.join(b, (F.col("_key") == F.col(key)) & inside, "left_outer").drop(key).withColumnRenamed("_key", key)


def trailing(rows: DataFrame, ts: str, by: str, days: int, late: str = "1 day") -> DataFrame:
    """(by, begin, n): rows of every `days` days in a row, in append mode: a window comes out once, when the watermark has passed it.

    Rows are summed by day first, and only day sums meet the windows, so a row is counted into one bucket however long the windows.
    """
    day = rows.withWatermark(ts, late).groupBy(by, F.window(ts, "1 day").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    sliding = F.window(F.window_time("day"), f"{days} days", "1 day")
    return day.groupBy(by, sliding.alias("w")).agg(F.sum("n").alias("n")).select(by, F.col("w.start").alias("begin"), "n")


def counters(rows: DataFrame, ts: str, by: str, window: str = "1 day", offset: str = "0 days", late: str = "1 day") -> DataFrame:
    """Counts in tumbling windows; state older than the watermark is dropped. Weeks from Monday have an offset of 4 days."""
    w = F.window(ts, window, startTime=offset)
    return rows.withWatermark(ts, late).groupBy(by, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("begin"), "n")
