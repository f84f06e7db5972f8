"""Append-only ledgers and derived tables as Parquet."""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The ledger so far; one that isn't there yet is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_unique(rows: DataFrame, path: str, key: Sequence[str], order: Sequence[str], within: str | None = None) -> int:
    """Appends rows whose key the ledger hasn't; of rows with one key the first by `order`. First write wins; returns rows added.

    within: a column of the key (a day, say) whose values partition the ledger. An append then reads the keys of its own values'
    folders only, so its cost goes with what it brings and not with the ledger's age.
    """
    spark = rows.sparkSession
    first = rows.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r").persist()
    held = read(spark, path, rows.schema).select(*key)
    if within:
        values = [r[0] for r in first.select(within).distinct().collect()]  # a row a folder that the rows touch
        known = [v for v in values if v is not None]
        held = held.where(F.col(within).isin(known) | (F.col(within).isNull() if len(known) < len(values) else F.lit(False)))
    same = [first[k].eqNullSafe(held[k]) for k in key]
    new = first.join(held, reduce(Column.__and__, same), "left_anti").select(*rows.columns).persist()
    added = new.count()
    if added:
        (new.write.partitionBy(within) if within else new.write).mode("append").parquet(path)
    new.unpersist()
    first.unpersist()
    return added


def upgraded_ids(rows: DataFrame, ledger: DataFrame, key: str, validated: str) -> DataFrame:
    """A validated row whose id a research row holds gets a derived id, once."""
    held = ledger.where(~F.col(validated)).select(key).distinct().withColumn("_held", F.lit(True))
    derived = F.substring(F.sha2(F.concat(F.col(key), F.lit("|validated")), 256), 1, 16)
    out = rows.join(held, key, "left").withColumn(key, F.when(F.col("_held") & F.col(validated), derived).otherwise(F.col(key))).drop("_held")
    return out.join(ledger.select(key), key, "left_anti")


def days_done(spark: SparkSession, path: str, day: str) -> list[str]:
    """The days that write_days() has finished, from the names of their folders."""
    try:
        return sorted(r[0] for r in spark.read.parquet(path).select(F.col(day).cast("string")).distinct().collect())  # a row a day
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return []


def write_days(rows: DataFrame, path: str, day: str) -> list:
    """Writes days that aren't there, each as a whole partition; returns them. Finished days are left alone."""
    spark = rows.sparkSession
    try:
        done = spark.read.parquet(path).select(F.col(day).cast("string").alias("d")).distinct()
        left = rows.join(done, F.col(day).cast("string") == F.col("d"), "left_anti")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        left = rows
    days = [r[0] for r in left.select(day).distinct().orderBy(day).collect()]
    if days:
        left.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    return days


def rebuild(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def contract(ranked: DataFrame, path: str, columns: Sequence[str], qualified: str) -> None:
    """The ranked rows as JSON, and the qualified ones as CSV beside them."""
    ranked.select(*columns).write.mode("overwrite").json(os.path.join(path, "all"))
    ranked.where(qualified).select(*columns).write.mode("overwrite").csv(os.path.join(path, "qualified"), header=True)


def result_set(bets: DataFrame, path: str, run: str, day: str, profit: str, p: str, won: str) -> None:
    """The tables of backtest runs, each partitioned by run: bets, profit by day, and calibration by tenths of p."""
    daily = bets.groupBy(run, day).agg(F.sum(profit).alias(profit))
    bands = bets.groupBy(run, F.floor(F.col(p) * 10).alias("band")).agg(F.avg(p).alias("mean_p"), F.sum(won).alias("won"), F.count(F.lit(1)).alias("n"))
    for name, table in (("bets", bets), ("bankroll", daily), ("calibration", bands)):
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(os.path.join(path, name))


def superseding(settled: DataFrame, ledger: DataFrame, key: str, evidence: Sequence[str]) -> DataFrame:
    """Rows to append: the same evidence adds none; changed evidence adds one that names the row it supersedes."""
    id_ = F.substring(F.sha2(F.concat_ws("|", F.col(key).cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in evidence]), 256), 1, 16)
    latest = ledger.groupBy(key).agg(F.max_by("settlement_id", "seq").alias("supersedes"), F.max("seq").alias("last"))
    new = settled.withColumn("settlement_id", id_).join(latest, key, "left").where(F.col("supersedes").isNull() | (F.col("supersedes") != F.col("settlement_id")))
    return new.withColumn("seq", F.coalesce("last", F.lit(0)) + 1).drop("last")


def settle(bets: DataFrame, outcomes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """bets with settlement columns filled from outcomes, for pending rows only."""
    got = outcomes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    pending = F.col("status") == "PENDING"
    joined = bets.join(got, key, "left")
    return joined.select(*[F.when(pending, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in bets.columns])
