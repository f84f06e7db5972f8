"""Registration of queries over the driver tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelark.sources.driver_tables import Tables, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, ctes: str = "", sql: str | None = None):
    """Registers a function of Tables. ctes names the shared tables that the SQL begins with."""

    def register(function: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_ctes(ctes, sql) if ctes else sql
        return function

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All doubles rounded, so that the order of a sum doesn't show; a negative zero becomes zero."""
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def mean_of_chances(p: str) -> Column:
    """The mean of chances of four decimals, to six: whole numbers are summed and rounded once, so no order of a sum shows in a tie."""
    return F.expr(f"(200 * sum(cast(round(`{p}` * 10000) as bigint)) + count(`{p}`)) div (2 * count(`{p}`))") / F.lit(1e6)
