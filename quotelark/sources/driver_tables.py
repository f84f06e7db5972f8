"""The engine's concepts as projections of the driver tables: quotes, bets, history and ticks. CTES holds the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOMES = ("A", "N", "R")


class Tables:
    #: What a task gets of a table's files.
    TASK_BYTES = 2 << 20

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def parts(self, name: str) -> int:
        """Tasks of TASK_BYTES of a table's files each, at least as many as a shuffle makes."""
        size = int(str(self.read(name)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-size // self.TASK_BYTES))

    def spread(self, rows: DataFrame, name: str, *keys: str) -> DataFrame:
        """rows, made of a table, dealt by keys over parts() tasks, so that a task's memory doesn't grow with the table; groups and windows by
        these and further keys find their rows in place. Tables that a shuffle's own tasks hold stay as they are."""
        n = self.parts(name)
        return rows.repartition(n, *keys) if n > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else rows

    def lines(self, *keys: str) -> DataFrame:
        return self.spread(self.read("lineitem"), "lineitem", *keys)

    def quotes(self) -> DataFrame:
        """One price for each market, book and outcome."""
        odds = F.round(1 + F.col("l_tax") * 10 + F.col("l_discount") + F.col("l_quantity") / 50, 4)
        return self.lines("l_partkey", "l_suppkey").groupBy(F.col("l_partkey").alias("market"), F.col("l_suppkey").alias("book"), F.col("l_returnflag").alias("outcome")).agg(F.max(odds).alias("odds"))

    def bets(self) -> DataFrame:
        """One bet for each order line, with its chance p, odds and outcome y."""
        return (
            self.lines("l_orderkey", "l_linenumber")
            .groupBy("l_orderkey", "l_linenumber")
            .agg(
                F.min(F.to_date("l_shipdate")).alias("day"), F.min("l_returnflag").alias("sport"), F.min("l_partkey").alias("event"), F.min("l_suppkey").alias("team"),
                F.round(0.05 + F.max("l_discount") * 9, 4).alias("p"), F.round(1.2 + F.max("l_tax") * 20 + F.max("l_quantity") / 50, 4).alias("odds"),
                F.max((F.col("l_linestatus") == "F").cast("int")).alias("y"),
            )
            .select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("bet_id"), "day", F.year("day").alias("season"), "sport", "event", "team", "p", "odds", "y")
            .withColumn("staked", F.lit(1.0))
            .withColumn("profit", F.when(F.col("y") == 1, F.col("odds") - 1).otherwise(-1.0))
        )

    def history(self, teams_together: bool = False) -> DataFrame:
        """One row for each team and match. teams_together: a team's rows lie in one task, for what runs over each team's days anyway."""
        return (
            self.lines("l_suppkey", *([] if teams_together else ["l_orderkey"]))
            .groupBy(F.col("l_suppkey").alias("team"), F.col("l_orderkey").alias("match_id"))
            .agg(F.min(F.to_date("l_shipdate")).alias("day"), F.sum("l_quantity").alias("goals_for"), F.round(F.sum("l_tax") * 100, 4).alias("goals_against"))
            .withColumn("league", F.col("team") % 5)
        )

    def ticks(self) -> DataFrame:
        """Price observations of an entity over time."""
        return self.read("events").select(F.col("event_id").alias("tick_id"), F.col("user_id").alias("entity"), "ts", F.round(1 + F.col("value"), 4).alias("price"), F.col("event_type").alias("source"), "props")

    def starts(self) -> DataFrame:
        """One event start for each entity and week of the ticks."""
        week = F.date_trunc("week", "ts")
        return self.read("events").groupBy(F.col("user_id").alias("entity"), week.alias("week")).agg(F.max("ts").alias("start_ts"), F.min("ts").alias("entry_ts"), F.max("event_id").alias("start_id"))


CTES = {
    "quotes": """quotes as (
  select l_partkey as market, l_suppkey as book, l_returnflag as outcome, max(round(1 + l_tax * 10 + l_discount + l_quantity / 50, 4)) as odds
  from lineitem group by all)""",
    "bets": """bets as (
  select l_orderkey * 100 + l_linenumber as bet_id, min(l_shipdate)::date as day, year(min(l_shipdate))::int as season, min(l_returnflag) as sport, min(l_partkey) as event, min(l_suppkey) as team,
         round(0.05 + max(l_discount) * 9, 4) as p, round(1.2 + max(l_tax) * 20 + max(l_quantity) / 50, 4) as odds, max((l_linestatus = 'F')::int) as y,
         1.0::double as staked, case when max((l_linestatus = 'F')::int) = 1 then round(1.2 + max(l_tax) * 20 + max(l_quantity) / 50, 4) - 1 else -1.0::double end as profit
  from lineitem group by l_orderkey, l_linenumber)""",
    "history": """history as (
  select l_suppkey as team, l_orderkey as match_id, min(l_shipdate)::date as day, sum(l_quantity) as goals_for, round(sum(l_tax) * 100, 4) as goals_against, l_suppkey % 5 as league
  from lineitem group by l_suppkey, l_orderkey)""",
    "ticks": """ticks as (select event_id as tick_id, user_id as entity, ts, round(1 + value, 4) as price, event_type as source, props from events)""",
    "starts": """starts as (select user_id as entity, date_trunc('week', ts) as week, max(ts) as start_ts, min(ts) as entry_ts, max(event_id) as start_id from events group by all)""",
    "fair": """whole as (
  select market, book, sum(1 / odds) as s from quotes group by all having count(*) = 3
), fair as (
  select q.market, q.book, q.outcome, q.odds, 1 / q.odds / w.s as p from quotes q join whole w using (market, book))""",
}


def with_ctes(names: str, body: str) -> str:
    return "with " + ",\n".join(CTES[n] for n in names.split()) + "\n" + body
