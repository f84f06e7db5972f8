"""Scans of quote, result, message and ledger files. Schemas are declared; nothing is inferred."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotelark.sources.archives import opened

LONG_ODDS = "market_id string, event string, selection string, bookmaker string, decimal_odds double"
EXCHANGE = "market_id string, exchange string, selection string, decimal_odds double, available_size_gbp double, commission double"
ODDS_FEED = (
    "id string, sport_key string, commence_time timestamp, home_team string, away_team string, "
    "bookmakers array<struct<key:string,last_update:timestamp,markets:array<struct<key:string,outcomes:array<struct<name:string,price:double,point:double>>>>>>"
)
SCORES = "id string, completed boolean, home_team string, away_team string, scores array<struct<name:string,score:string>>"
MESSAGES = (
    "pt bigint, mc array<struct<id:string,marketDefinition:struct<eventId:string,marketTime:timestamp,marketType:string,status:string,"
    "runners:array<struct<id:bigint,name:string,sortPriority:int>>>,rc:array<struct<id:bigint,ltp:double,batb:array<array<double>>,batl:array<array<double>>>>>>"
)


def long_odds(spark: SparkSession, path: str) -> DataFrame:
    """One row a quote; prices of 1 or less are kept for validation to name."""
    return spark.read.schema(LONG_ODDS).csv(path, header=True).withColumnsRenamed({"market_id": "market", "selection": "outcome", "bookmaker": "book", "decimal_odds": "odds"})


def first_metadata(quotes: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """The first row's metadata for each market."""
    return quotes.groupBy("market").agg(F.min(F.struct(order, *columns)).alias("x")).select("market", *[f"x.{c}" for c in columns])


def exchange_prices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXCHANGE).csv(path, header=True)


def match_day(text: Column) -> Column:
    """dd/MM/yyyy or dd/MM/yy."""
    long_, short = F.try_to_timestamp(text, F.lit("dd/MM/yyyy")), F.try_to_timestamp(text, F.lit("dd/MM/yy"))
    return F.to_date(F.when(F.length(text) > 8, long_).otherwise(short))


def results(spark: SparkSession, path: str, schema: str, goals: tuple[str, str] = ("FTHG", "FTAG"), day: str = "Date") -> DataFrame:
    """Season files with drifting columns: rows without both goals are dropped, and each keeps its file."""
    raw = spark.read.schema(schema).option("enforceSchema", False).csv(path, header=True)
    return raw.where(F.col(goals[0]).isNotNull() & F.col(goals[1]).isNotNull()).withColumn("day", match_day(F.col(day))).withColumn("file", F.col("_metadata.file_name"))


def odds_feed(spark: SparkSession, path: str, market: str = "h2h") -> DataFrame:
    """Nested feed to one row a quote. A book's second quote of an outcome is skipped; names become home, away or draw."""
    events = spark.read.schema(ODDS_FEED).json(path)
    books = events.select("id", "commence_time", "home_team", "away_team", F.posexplode("bookmakers").alias("at", "b"))
    quotes = books.select("id", "commence_time", "home_team", "away_team", "at", F.col("b.key").alias("book"), F.col("b.last_update").alias("ts"), F.explode("b.markets").alias("m")).where(F.col("m.key") == market)
    rows = quotes.select("*", F.posexplode("m.outcomes").alias("k", "o"))
    outcome = F.when(F.col("o.name") == F.col("home_team"), "home").when(F.col("o.name") == F.col("away_team"), "away").when(F.lower("o.name") == "draw", "draw")
    named = rows.select(F.col("id").alias("market"), "book", outcome.alias("outcome"), F.col("o.price").alias("odds"), "ts", "commence_time", "at", "k").where("outcome is not null")
    first = named.groupBy("market", "book", "outcome").agg(F.min(F.struct("at", "k", "odds", "ts", "commence_time")).alias("x"))
    return first.select("market", "book", "outcome", "x.odds", "x.ts", "x.commence_time")


def scores(spark: SparkSession, path: str) -> DataFrame:
    """(id, completed, home, away): invalid or missing scores are null."""
    raw = spark.read.schema(SCORES).json(path)
    of = lambda team: F.get(F.filter("scores", lambda s: s["name"] == F.col(team)), 0)["score"].try_cast("int")
    return raw.select("id", F.coalesce("completed", F.lit(False)).alias("completed"), of("home_team").alias("home"), of("away_team").alias("away"))


def messages(spark: SparkSession, path: str) -> DataFrame:
    """One row for each (line, market change), with its publish time; compressed text is split by Spark's codecs."""
    raw = spark.read.schema(MESSAGES).json(path)
    return raw.select("pt", F.timestamp_millis("pt").alias("published"), F.explode("mc").alias("m")).select("pt", "published", F.col("m.id").alias("market_id"), F.col("m.marketDefinition").alias("definition"), F.col("m.rc").alias("changes"))


def bad_ladders(rows: DataFrame) -> DataFrame:
    """Messages with a ladder entry that hasn't three numbers."""
    return rows.where(F.exists("changes", lambda c: F.exists(F.coalesce(F.concat(F.coalesce(c["batb"], F.array()), F.coalesce(c["batl"], F.array())), F.array()), lambda e: F.size(e) != 3)))


def market_index(rows: DataFrame) -> DataFrame:
    """Per market: the last non-null definition fields, runner names, message counts and the price points in time order."""
    last = lambda field: F.max_by(f"definition.{field}", F.when(F.col(f"definition.{field}").isNotNull(), F.col("pt"))).alias(field)
    heads = rows.groupBy("market_id").agg(last("eventId"), last("marketTime"), last("marketType"), last("status"), last("runners"), F.count(F.lit(1)).alias("n_messages"))
    points = rows.select("market_id", "pt", F.explode("changes").alias("c")).where("c.ltp is not null").select("market_id", F.struct("pt", F.col("c.id").alias("runner"), F.col("c.ltp").alias("ltp")).alias("p"))
    series = points.groupBy("market_id").agg(F.sort_array(F.collect_list("p")).alias("prices"))
    return heads.join(series, "market_id", "left").withColumn("n_price_points", F.coalesce(F.size("prices"), F.lit(0)))


def price_points(index: DataFrame) -> DataFrame:
    return index.select("market_id", F.explode("prices").alias("p")).select("market_id", "p.runner", "p.ltp", F.timestamp_millis("p.pt").alias("ts"))


def manifest(spark: SparkSession, path: str, name: str = "([^/]+)$") -> DataFrame:
    """Name (a part of the path), size and SHA-256 of raw files. Tasks hash them a megabyte at a time, so a file may have any size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")  # a listing; no content

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            digests = []
            for uri in frame["path"]:
                digest = hashlib.sha256()
                with opened(uri) as stream:
                    while block := stream.read(1 << 20):
                        digest.update(block)
                digests.append(digest.hexdigest())
            yield frame.assign(sha256=digests)

    spread = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInPandas(run, "path string, length long, sha256 string").select(F.regexp_extract("path", name, 1).alias("name"), F.col("length").alias("size"), "sha256")


def manifest_check(found: DataFrame, frozen: DataFrame) -> DataFrame:
    both = found.alias("f").join(frozen.alias("z"), "name", "full_outer")
    status = F.when(F.col("f.sha256").isNull(), "MISSING").when(F.col("z.sha256").isNull(), "UNEXPECTED").when(F.col("f.sha256") == F.col("z.sha256"), "OK").otherwise("CHANGED")
    return both.select("name", status.alias("status"))


def wide_to_long(rows: DataFrame, keys: Sequence[str], books: Mapping[str, Sequence[str]], outcomes: Sequence[str]) -> DataFrame:
    """Wide bookmaker columns to quotes: all blank is absent; partly invalid sets are labelled REJECTED. books: name to its columns."""
    parts = F.array(*[F.struct(F.lit(b).alias("book"), F.array(*[F.col(c).cast("double") for c in cols]).alias("q")) for b, cols in books.items()])
    sets = rows.select(*keys, F.explode(parts).alias("s")).where(F.exists("s.q", lambda x: x.isNotNull()))
    status = F.when(F.forall("s.q", lambda x: F.coalesce(x > 1, F.lit(False))), "OK").otherwise("REJECTED")
    labelled = sets.select(*keys, "s.book", status.alias("status"), F.arrays_zip(F.array(*map(F.lit, outcomes)).alias("outcome"), F.col("s.q").alias("odds")).alias("z"))
    return labelled.select(*keys, "book", "status", F.explode("z").alias("x")).select(*keys, "book", "status", "x.outcome", "x.odds")


def feed_statuses(spark: SparkSession, path: str, outcomes: Sequence[str] = ("home", "draw", "away"), market: str = "h2h") -> DataFrame:
    """Every price of the nested feed with a status: OK, or why it is skipped (UNKNOWN_NAME, SECOND_QUOTE, INCOMPLETE)."""
    events = spark.read.schema(ODDS_FEED).json(path)
    books = events.select("id", "home_team", "away_team", F.posexplode("bookmakers").alias("at", "b")).select("id", "home_team", "away_team", "at", F.col("b.key").alias("book"), F.explode("b.markets").alias("m"))
    rows = books.where(F.col("m.key") == market).select("*", F.posexplode("m.outcomes").alias("k", "o"))
    outcome = F.when(F.col("o.name") == F.col("home_team"), "home").when(F.col("o.name") == F.col("away_team"), "away").when(F.lower("o.name") == "draw", "draw")
    named = rows.select(F.col("id").alias("market"), "book", outcome.alias("outcome"), F.col("o.price").alias("odds"), "at", "k")
    nth = F.row_number().over(W.partitionBy("market", "book", "outcome").orderBy("at", "k"))
    seen = F.size(F.collect_set("outcome").over(W.partitionBy("market", "book")))
    status = F.when(F.col("outcome").isNull(), "UNKNOWN_NAME").when(F.col("nth") > 1, "SECOND_QUOTE").when(F.col("seen") < len(outcomes), "INCOMPLETE").otherwise("OK")
    return named.withColumn("nth", nth).withColumn("seen", seen).select("market", "book", "outcome", "odds", status.alias("status"))


def history_scan(spark: SparkSession, path: str, schema: str, divisions: Sequence[str], goals: tuple[str, str] = ("FTHG", "FTAG"), day: str = "Date") -> DataFrame:
    """Files of <division>/<season>: both come from the path, dates in either format, other divisions are left out."""
    raw = spark.read.schema(schema).option("recursiveFileLookup", True).csv(path, header=True).withColumn("_p", F.col("_metadata.file_path"))
    part = lambda k: F.regexp_extract("_p", rf"{k}=([^/]+)/", 1)
    rows = raw.withColumn("division", part("division")).withColumn("season", part("season").cast("int")).drop("_p")
    return rows.where(F.col("division").isin(*divisions) & F.col(goals[0]).isNotNull() & F.col(goals[1]).isNotNull()).withColumn("day", match_day(F.col(day)))


def ledger_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All monthly shards <month>/ of a ledger; blanks are null."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("nullValue", "").csv(path, header=True)


def player_rows(lineups: DataFrame, events: DataFrame, key: Sequence[str], tags: Mapping[str, Sequence[str]]) -> DataFrame:
    """Players of each match with counts of their tagged events: unused substitutes (no minutes) are dropped, missing counts are 0."""
    counts = events.groupBy(*key).agg(*[F.count(F.when(F.arrays_overlap("tags", F.array(*map(F.lit, names))), 1)).alias(c) for c, names in tags.items()])
    return lineups.where("minutes > 0").join(counts, list(key), "left").fillna(0, list(tags))


def primary_and_archive(primary: DataFrame, archive: DataFrame, names: DataFrame, cutoff: str) -> DataFrame:
    """Games of two sources: the archive only before the cutoff, names by season, ties and unmapped teams dropped, the primary's row first.

    names (raw, first_season, last_season, team) is a small dimension.
    """
    both = primary.withColumn("rank", F.lit(0)).unionByName(archive.where(F.col("day") < F.lit(cutoff).cast("date")).withColumn("rank", F.lit(1))).where("home_score <> away_score")
    for side in ("home", "away"):
        of = names.select(F.col("raw").alias("_raw"), "first_season", "last_season", F.col("team").alias(f"{side}_team"))
        both = both.join(F.broadcast(of), (F.col(side) == F.col("_raw")) & F.col("season").between(F.col("first_season"), F.col("last_season"))).drop("_raw", "first_season", "last_season")
    best = both.groupBy("day", "home_team", "away_team").agg(F.min(F.struct("rank", "home_score", "away_score")).alias("x"))
    return best.select("day", "home_team", "away_team", "x.home_score", "x.away_score", F.when(F.col("x.rank") == 0, "PRIMARY").otherwise("ARCHIVE").alias("source"))


def two_way(rows: DataFrame, keys: Sequence[str], books: Mapping[str, tuple[str, str]], summaries: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Two-way columns to (keys, book, side, odds): a book needs both sides above 1, each side of a summary stands for itself."""
    valid = lambda c: F.when(F.col(c) > 1, F.col(c))
    whole = [F.when(valid(a).isNotNull() & valid(b).isNotNull(), F.array(F.struct(F.lit(n).alias("book"), F.lit("a").alias("side"), F.col(a).alias("odds")), F.struct(F.lit(n).alias("book"), F.lit("b").alias("side"), F.col(b).alias("odds")))) for n, (a, b) in books.items()]
    alone = [F.array(F.when(valid(c).isNotNull(), F.struct(F.lit(n).alias("book"), F.lit(s).alias("side"), F.col(c).alias("odds")))) for n, pair in summaries.items() for s, c in zip("ab", pair)]
    return rows.select(*keys, F.explode(F.array_compact(F.flatten(F.array_compact(F.array(*whole, *alone))))).alias("x")).select(*keys, "x.book", "x.side", "x.odds")


def series(rows: DataFrame, keys: Sequence[str], price: str, at: str) -> DataFrame:
    """Parallel arrays to price points, without null prices or times, in time order (`nth`)."""
    points = rows.select(*keys, F.explode(F.arrays_zip(F.col(price).alias("price"), F.col(at).alias("at"))).alias("x")).select(*keys, "x.price", "x.at").where("price is not null and at is not null")
    return points.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy("at", "price")))
