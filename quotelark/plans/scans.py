"""Scans of files, reshapes and ledgers. The files are written from the driver tables into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelark.operators.consensus import fair_by_book
from quotelark.plans.registry import query, rounded
from quotelark.scratch import new_path
from quotelark.sinks import ledger as K
from quotelark.sources import archives as A
from quotelark.sources import files as S


def stored(df, kind="csv", by=(), header=True):
    path = new_path(df.sparkSession)
    out = df.write.partitionBy(*by) if by else df.write
    (out.option("header", header) if kind == "csv" else out).format(kind).save(path)
    return path


@query("s1_long_odds_csv", "quotes", """
, m as (select market, min((book, outcome)) as first from quotes group by market)
select q.market::varchar as market, book::varchar as book, outcome, odds, count(*) over (partition by q.market, book) as book_outcomes, first[2] as first_outcome from quotes q join m using (market)""")
def long_odds(t):
    """Quotes grouped by market and book, with each market's first row."""
    text = t.quotes().select(F.col("market").cast("string").alias("market_id"), F.lit("e").alias("event"), F.col("outcome").alias("selection"), F.col("book").cast("string").alias("bookmaker"), F.col("odds").alias("decimal_odds"))
    rows = S.long_odds(t.spark, stored(text)).withColumn("order", F.struct(F.col("book").cast("long"), "outcome"))
    sizes = rows.groupBy("market", "book").agg(F.count(F.lit(1)).alias("book_outcomes"))
    heads = S.first_metadata(rows, "order", ["outcome"]).select("market", F.col("outcome").alias("first_outcome"))
    return rows.join(sizes, ["market", "book"]).join(heads, "market").select("market", "book", "outcome", "odds", "book_outcomes", "first_outcome")


@query("s2_exchange_csv", "", """
select l_partkey::varchar as market_id, 'X' || l_linenumber as exchange, l_returnflag as selection, 1 + max(l_tax) * 10 as decimal_odds, sum(l_quantity) as available_size_gbp, min(l_discount) as commission from lineitem group by all""")
def exchange_csv(t):
    rows = t.read("lineitem").groupBy(F.col("l_partkey").cast("string").alias("market_id"), F.concat(F.lit("X"), "l_linenumber").alias("exchange"), F.col("l_returnflag").alias("selection")).agg(
        (1 + F.max("l_tax") * 10).alias("decimal_odds"), F.sum("l_quantity").alias("available_size_gbp"), F.min("l_discount").alias("commission")
    )
    return S.exchange_prices(t.spark, stored(rows))


def season_rows(t):
    """Match rows of seasons; orders in progress have no goals yet."""
    day, goals = F.to_date("o_orderdate"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") % 7)
    text = F.when(F.year("o_orderdate") >= 2000, F.date_format(day, "dd/MM/yy")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    return t.read("orders").select(text.alias("Date"), F.col("o_orderkey").alias("Match"), goals.alias("FTHG"), (F.col("o_orderkey") % 5).alias("FTAG"), F.substring("o_orderpriority", 1, 1).alias("division"), F.year("o_orderdate").alias("season"))


@query("s3_results_csv", "", """
select o_orderkey as "Match", o_orderdate::date as day, o_custkey % 7 as "FTHG", o_orderkey % 5 as "FTAG" from orders where o_orderstatus <> 'P'""")
def results_csv(t):
    """Seasons in folders of their own, with dates in two formats; rows without both goals are dropped."""
    path = stored(season_rows(t), by=["division", "season"])
    return S.results(t.spark, f"{path}/*/*", "Date string, Match long, FTHG long, FTAG long").where("file is not null").select("Match", "day", "FTHG", "FTAG")


@query("s11_history_csv_by_path", "", """
select substr(o_orderpriority, 1, 1) as division, year(o_orderdate)::int as season, count(*) as matches, min(o_orderdate)::date as first_day, sum(o_custkey % 7)::bigint as goals from orders where o_orderstatus <> 'P' and substr(o_orderpriority, 1, 1) in ('1', '2', '4') group by all""")
def history_csv(t):
    rows = S.history_scan(t.spark, stored(season_rows(t), by=["division", "season"]), "Date string, Match long, FTHG long, FTAG long", ["1", "2", "4"])
    return rows.groupBy("division", "season").agg(F.count(F.lit(1)).alias("matches"), F.min("day").alias("first_day"), F.sum("FTHG").alias("goals"))


@query("s4_nested_odds_feed", "", """
with r as (select l_partkey as market, l_suppkey as book, l_returnflag as outcome, 1 + l_tax * 10 as odds, row_number() over (partition by l_partkey, l_suppkey, l_returnflag order by l_orderkey, l_linenumber) as nth from lineitem),
s as (select *, count(distinct outcome) over (partition by market, book) as seen from r)
select market::varchar as market, book::varchar as book, case outcome when 'A' then 'home' when 'N' then 'draw' else 'away' end as outcome, round(odds, 6) as odds, case when nth > 1 then 'SECOND_QUOTE' when seen < 3 then 'INCOMPLETE' else 'OK' end as status from s""")
def nested_feed(t):
    """The nested feed of markets, books and outcomes; every skipped price has a row that says why."""
    outcome = F.struct(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.when(F.col("l_returnflag") == "N", "Draw").otherwise(F.col("l_returnflag")).alias("name"), (1 + F.col("l_tax") * 10).alias("price"))
    books = t.read("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sort_array(F.collect_list(outcome)).alias("o"))
    market = F.struct(F.lit("h2h").alias("key"), F.transform("o", lambda o: F.struct(o["name"].alias("name"), o["price"].alias("price"))).alias("outcomes"))
    book = F.struct(F.col("l_suppkey").cast("string").alias("key"), F.array(market).alias("markets"))
    feed = books.groupBy(F.col("l_partkey").cast("string").alias("id")).agg(F.collect_list(book).alias("bookmakers")).select("id", F.lit("A").alias("home_team"), F.lit("R").alias("away_team"), "bookmakers")
    return rounded(S.feed_statuses(t.spark, stored(feed, "json")))


@query("s5_scores_json", "", """
select o_orderkey::varchar as id, o_orderstatus = 'F' as completed, case when o_orderstatus <> 'P' then (o_custkey % 7)::int end as home, (o_orderkey % 5)::int as away from orders""")
def scores_json(t):
    score = lambda name, s: F.struct(F.lit(name).alias("name"), s.alias("score"))
    home = F.when(F.col("o_orderstatus") != "P", (F.col("o_custkey") % 7).cast("string")).otherwise("n/a")
    feed = t.read("orders").select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "F", True).alias("completed"), F.lit("H").alias("home_team"), F.lit("W").alias("away_team"), F.array(score("H", home), score("W", (F.col("o_orderkey") % 5).cast("string"))).alias("scores"))
    return S.scores(t.spark, stored(feed, "json"))


def nearest_milli(ts: str):
    """A time in whole milliseconds, the nearest."""
    return F.floor((F.unix_micros(F.col(ts).cast("timestamp")) + 500) / 1000)


def message_feed(t):
    """Events as exchange messages: one change each, a ladder of three numbers (two for an error), a definition on each view."""
    e = t.read("events")
    ladder = F.array(F.when(F.col("event_type") == "error", F.array(F.lit(0.0), F.col("value"))).otherwise(F.array(F.lit(0.0), F.col("value"), F.lit(5.0))))
    change = F.struct((F.col("event_id") % 2).alias("id"), F.when(F.col("event_type") != "click", F.round(F.col("value") + 1, 4)).alias("ltp"), ladder.alias("batb"))
    definition = F.when(F.col("event_type") == "view", F.struct(F.col("event_id").cast("string").alias("eventId"), F.lit("OPEN").alias("status")))
    entry = F.struct(F.concat(F.lit("1."), "user_id").alias("id"), definition.alias("marketDefinition"), F.array(change).alias("rc"))
    return e.select(nearest_milli("ts").alias("pt"), F.array(entry).alias("mc"))


@query("s6_message_scan", "", """
select '1.' || user_id as market_id, count(*) as messages, count(*) filter (event_type = 'error') as bad_ladders, epoch_ms(max(ts)) as last_pt from events group by 1""")
def message_scan(t):
    rows = S.messages(t.spark, stored(message_feed(t), "json"))
    bad = S.bad_ladders(rows).groupBy("market_id").agg(F.count(F.lit(1)).alias("bad"))
    return rows.groupBy("market_id").agg(F.count(F.lit(1)).alias("messages"), F.max("pt").alias("last_pt")).join(bad, "market_id", "left").select("market_id", "messages", F.coalesce("bad", F.lit(0)).alias("bad_ladders"), "last_pt")


@query("s7_market_compaction", "", """
select '1.' || user_id as market_id, count(*) as n_messages, count(*) filter (event_type <> 'click')::int as n_price_points, arg_max(event_id, (epoch_ms(ts))) filter (event_type = 'view')::varchar as "eventId",
 round(sum(round(value + 1, 4)) filter (event_type <> 'click'), 3) as ltp_sum from events group by 1""")
def compaction(t):
    index = S.market_index(S.messages(t.spark, stored(message_feed(t), "json")))
    total = F.aggregate("prices", F.lit(0.0), lambda s, p: s + p["ltp"])
    return rounded(index.select("market_id", "n_messages", "n_price_points", "eventId", total.alias("ltp_sum")), 3)


@query("r8_price_points", "", """
select '1.' || user_id as market_id, (event_id % 2)::bigint as runner, round(value + 1, 4) as price, epoch_ms(ts) as at, row_number() over (partition by user_id, event_id % 2 order by epoch_ms(ts), round(value + 1, 4)) as nth from events where event_type <> 'click'""")
def points(t):
    """Parallel arrays of prices and times, nulls among them, to price points in time order."""
    e = t.read("events").select(F.concat(F.lit("1."), "user_id").alias("market_id"), (F.col("event_id") % 2).alias("runner"), F.when(F.col("event_type") != "click", F.round(F.col("value") + 1, 4)).alias("price"), nearest_milli("ts").alias("at"))
    arrays = e.groupBy("market_id", "runner").agg(F.collect_list(F.struct("price", "at")).alias("x")).select("market_id", "runner", F.col("x.price").alias("price"), F.col("x.at").alias("at"))
    return S.series(arrays, ["market_id", "runner"], "price", "at")


@query("s8_file_manifest", "", """
with f as (select n_name as name, string_agg(c_custkey || ',' || c_mktsegment || chr(10), '' order by c_custkey) as content from customer join nation on c_nationkey = n_nationkey group by 1)
select name, length(content)::bigint as size, sha256(content) as sha256, case when n_regionkey = 0 then 'CHANGED' else 'OK' end as status from f join nation on n_name = name""")
def manifest(t):
    """Raw files of one nation each, their sizes and hashes, against a frozen list (in which the first region's hashes differ)."""
    nations = t.read("nation").select("n_nationkey", F.col("n_name").alias("name"), "n_regionkey")
    rows = t.read("customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("name", "c_custkey", F.concat_ws(",", F.col("c_custkey").cast("string"), "c_mktsegment").alias("value"))
    path = new_path(t.spark)
    rows.repartition("name").sortWithinPartitions("name", "c_custkey").select("name", "value").write.partitionBy("name").text(path)
    found = S.manifest(t.spark, f"{path}/*/*.txt", r"name=([^/]+)/")
    frozen = found.join(F.broadcast(nations), "name").select("name", F.when(F.col("n_regionkey") == 0, F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"))
    return found.select("name", "size", "sha256").join(S.manifest_check(found, frozen), "name")


@query("s10_player_rows", "", """
with l as (select user_id, ts::date as day, max(value) as minutes from events group by all)
select l.user_id, l.day, round(minutes, 4) as minutes, count(*) filter (event_type in ('click', 'purchase')) as shots, count(*) filter (event_type = 'purchase') as goals from l join events e on e.user_id = l.user_id and e.ts::date = l.day where minutes > 10 group by all""")
def players(t):
    """A match file for each day holds players (with minutes) and tagged events; players without minutes are dropped."""
    e = t.read("events").withColumn("day", F.to_date("ts"))
    lineup = e.groupBy("day", "user_id").agg(F.max("value").alias("m")).groupBy("day").agg(F.collect_list(F.struct("user_id", F.when(F.col("m") > 10, F.col("m")).otherwise(0.0).alias("minutes"))).alias("players"))
    tagged = e.groupBy("day").agg(F.collect_list(F.struct("user_id", F.array("event_type").alias("tags"))).alias("events"))
    path = stored(lineup.join(tagged, "day"), "json")
    raw = t.spark.read.schema("day date, players array<struct<user_id:long,minutes:double>>, events array<struct<user_id:long,tags:array<string>>>").json(path)
    lineups, events = raw.select("day", F.inline("players")), raw.select("day", F.inline("events"))
    return rounded(S.player_rows(lineups, events, ["day", "user_id"], {"shots": ["click", "purchase"], "goals": ["purchase"]}).select("user_id", "day", "minutes", "shots", "goals"), 4)


@query("s12_two_sources_of_games", "", """
with g as (select o_orderdate::date as day, year(o_orderdate)::int as season, c_nationkey as home, o_orderkey % 25 as away, o_custkey % 9 as home_score, o_orderkey % 8 as away_score, o_orderstatus from orders join customer on o_custkey = c_custkey),
b as (select *, 0 as rank from g where o_orderstatus <> 'F' union all select *, 1 from g where day < date '1998-01-01'),
m as (select b.*, h.n_name as home_team, a.n_name as away_team from b join nation h on h.n_nationkey = home and (h.n_regionkey <> 0 or season >= 1997) join nation a on a.n_nationkey = away and (a.n_regionkey <> 0 or season >= 1997) where home_score <> away_score),
w as (select day, home_team, away_team, min((rank, home_score, away_score)) as x from m group by all)
select day, home_team, away_team, x[2] as home_score, x[3] as away_score, case when x[1] = 0 then 'PRIMARY' else 'ARCHIVE' end as source from w""")
def games(t):
    """CSV of the primary source and JSON of an archive; the first region's names are known from 1997 on."""
    g = t.read("orders").join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.to_date("o_orderdate").alias("day"), F.year("o_orderdate").alias("season"), F.col("c_nationkey").cast("long").alias("home"), (F.col("o_orderkey") % 25).cast("long").alias("away"),
        (F.col("o_custkey") % 9).cast("long").alias("home_score"), (F.col("o_orderkey") % 8).cast("long").alias("away_score"), "o_orderstatus",
    )
    schema = "day date, season int, home long, away long, home_score long, away_score long"
    primary = t.spark.read.schema(schema).csv(stored(g.where("o_orderstatus <> 'F'").drop("o_orderstatus")), header=True)
    archive = t.spark.read.schema(schema).json(stored(g.drop("o_orderstatus"), "json"))
    names = t.read("nation").select(F.col("n_nationkey").alias("raw"), F.when(F.col("n_regionkey") == 0, 1997).otherwise(0).alias("first_season"), F.lit(9999).alias("last_season"), F.col("n_name").alias("team"))
    return S.primary_and_archive(primary, archive, names, "1998-01-01")


@query("s13_ledger_shards", "bets", "select strftime(day, '%Y-%m') as month, count(*) as rows, count(case when y = 1 then odds end) as settled, round(sum(case when y = 1 then odds end), 4) as odds from bets group by 1")
def shards(t):
    """A ledger in monthly folders; odds of lost bets are blank there and null when read."""
    b = t.bets().select("bet_id", F.date_format("day", "yyyy-MM").alias("month"), F.col("month").alias("shard"), F.when(F.col("y") == 1, F.col("odds")).alias("odds"))
    rows = S.ledger_shards(t.spark, stored(b, by=["shard"]), "bet_id long, month string, odds double")
    return rounded(rows.groupBy("month").agg(F.count(F.lit(1)).alias("rows"), F.count("odds").alias("settled"), F.sum("odds").alias("odds")), 4)


WIDE = [f"{m}{t}" for m in ("B1", "B2", "B3", "B4") for t in "OC"]


@query("r1_wide_books_to_long", "", """
with q as (select l_partkey as market, 'B' || l_linenumber as book, case when l_linestatus = 'O' then 'opening' else 'closing' end as timing, l_returnflag as outcome, max(round(l_tax * 50, 4)) as odds from lineitem where l_linenumber <= 4 group by all),
s as (select market, book, timing, coalesce(bool_and(odds > 1) and count(*) = 3, false) as ok from q group by all),
o as (select unnest(['A', 'N', 'R']) as outcome)
select s.market, s.book, s.timing, o.outcome, q.odds, case when ok then 'OK' else 'REJECTED' end as status from s cross join o left join q on (q.market, q.book, q.timing, q.outcome) = (s.market, s.book, s.timing, o.outcome)""")
def wide_books(t):
    """Columns <book><timing><outcome> of a wide file to quotes; sets that aren't whole and above 1 are labelled."""
    cell = F.concat(F.lit("B"), "l_linenumber", F.when(F.col("l_linestatus") == "O", "O").otherwise("C"), "l_returnflag")
    columns = [f"{w}{o}" for w in WIDE for o in "ANR"]
    wide = t.read("lineitem").withColumn("cell", cell).groupBy(F.col("l_partkey").alias("market")).pivot("cell", columns).agg(F.max(F.round(F.col("l_tax") * 50, 4)))
    rows = t.spark.read.schema("market long, " + ", ".join(f"{c} double" for c in columns)).csv(stored(wide), header=True)
    long = S.wide_to_long(rows, ["market"], {w: [f"{w}{o}" for o in "ANR"] for w in WIDE}, ["A", "N", "R"])
    timing = F.when(F.col("book").endswith("O"), "opening").otherwise("closing")
    return long.select("market", F.expr("left(book, length(book) - 1)").alias("book"), timing.alias("timing"), "outcome", "odds", "status")


@query("r2_two_way_to_long", "", """
with w as (select l_partkey as market, 'B' || l_linenumber as book, max(round(l_tax * 40, 4)) filter (l_returnflag = 'A') as a, max(round(l_tax * 40, 4)) filter (l_returnflag = 'R') as b from lineitem where l_linenumber <= 3 group by all),
m as (select l_partkey as market, max(round(l_tax * 40, 4)) filter (l_returnflag = 'A') as a, max(round(l_tax * 40, 4)) filter (l_returnflag = 'R') as b from lineitem group by all)
select market, book, 'a' as side, a as odds from w where a > 1 and b > 1 union all select market, book, 'b', b from w where a > 1 and b > 1 union all select market, 'Max', 'a', a from m where a > 1 union all select market, 'Max', 'b', b from m where b > 1""")
def two_way_long(t):
    """A book needs both sides; each side of the market's maximum stands for itself."""
    odds = lambda side, mode=None: F.max(F.when((F.col("l_returnflag") == side) & (F.lit(True) if mode is None else F.concat(F.lit("B"), "l_linenumber") == mode), F.round(F.col("l_tax") * 40, 4)))
    modes = ("B1", "B2", "B3")
    wide = t.read("lineitem").groupBy(F.col("l_partkey").alias("market")).agg(*[odds(s, m).alias(f"{m}{s}") for m in modes for s in "AR"], odds("A").alias("MaxA"), odds("R").alias("MaxR"))
    return S.two_way(wide, ["market"], {m: (f"{m}A", f"{m}R") for m in modes}, {"Max": ("MaxA", "MaxR")})


@query("r5_double_chance_to_long", "quotes fair", """
, d as (select market, book, sum(p) filter (outcome in ('A', 'N')) as one_x, sum(p) filter (outcome in ('N', 'R')) as x_two, sum(p) filter (outcome in ('A', 'R')) as one_two from fair group by all)
select market, book, 'A' as outcome, round((one_x + one_two - x_two) / 2, 6) as p from d union all select market, book, 'N', round((one_x + x_two - one_two) / 2, 6) from d union all select market, book, 'R', round((x_two + one_two - one_x) / 2, 6) from d""")
def double_chance_long(t):
    """The three outcomes recovered from double-chance columns."""
    of = lambda *k: F.sum(F.when(F.col("outcome").isin(*k), F.col("p")))
    d = fair_by_book(t.quotes(), ("A", "N", "R")).groupBy("market", "book").agg(of("A", "N").alias("one_x"), of("N", "R").alias("x_two"), of("A", "R").alias("one_two"))
    return rounded(d.select("market", "book", F.expr("stack(3, 'A', (one_x + one_two - x_two) / 2, 'N', (one_x + x_two - one_two) / 2, 'R', (x_two + one_two - one_x) / 2) as (outcome, p)")))


@query("k1_append_unique_twice", "bets", "select sport, count(*) as rows, round(sum(odds), 4) as odds from bets group by sport")
def append_twice(t):
    """The early seasons first, then all bets at other odds: what the ledger has stays as it was."""
    b, path = t.bets().select("bet_id", "sport", "season", "odds"), new_path(t.spark)
    K.append_unique(b.where("season < 1996"), path, ["bet_id"], ["odds"])
    K.append_unique(b.withColumn("odds", F.when(F.col("season") < 1996, F.lit(99.0)).otherwise(F.col("odds"))), path, ["bet_id"], ["odds"])
    return rounded(K.read(t.spark, path, b.schema).groupBy("sport").agg(F.count(F.lit(1)).alias("rows"), F.sum("odds").alias("odds")), 4)


@query("k2_upgraded_ids", "bets", """
, e as (select distinct event::varchar as id, y = 1 as validated from bets), h as (select id from e where not validated)
select case when id in (select id from h) and validated then substr(sha256(id || '|validated'), 1, 16) else id end as id, validated from e where validated""")
def upgraded(t):
    """Research rows of an event hold its id; the first validated row gets a derived one."""
    rows = t.bets().select(F.col("event").cast("string").alias("id"), (F.col("y") == 1).alias("validated")).distinct()
    return K.upgraded_ids(rows.where("validated"), rows.where("not validated"), "id", "validated").select("id", "validated")


@query("k3_resumed_days", "", "select ts::date as day, count(*) as rows, round(sum(value), 4) as value from events group by 1")
def resumed(t):
    """Days are written once; a second run with other values leaves the finished ones alone."""
    e, path = t.read("events").select(F.to_date("ts").alias("day"), "event_id", "value"), new_path(t.spark)
    middle = e.agg(F.percentile_approx(F.unix_date("day"), 0.5)).first()[0]
    K.write_days(e.where(F.unix_date("day") <= middle), path, "day")
    K.write_days(e.withColumn("value", F.when(F.unix_date("day") <= middle, F.lit(0.0)).otherwise(F.col("value"))), path, "day")
    return rounded(t.spark.read.parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("value")), 4)


@query("k4_rebuilt_table", "bets", "select season, count(*) as n, round(sum(profit), 4) as profit from bets group by season")
def rebuilt(t):
    path = new_path(t.spark)
    K.rebuild(t.bets().groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.lit(0.0).alias("profit")), path)
    K.rebuild(t.bets().groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("profit").alias("profit")), path)
    return rounded(t.spark.read.parquet(path), 4)


@query("k5_contract_files", "bets", "select 'all' as kind, count(*) as n, round(sum(p), 4) as p from bets union all select 'qualified', count(*), round(sum(p), 4) from bets where p >= 0.5")
def contract(t):
    path = new_path(t.spark)
    K.contract(t.bets(), path, ["bet_id", "p", "odds"], "p >= 0.5")
    of = lambda kind, df: df.agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p")).select(F.lit(kind).alias("kind"), "n", "p")
    schema = "bet_id long, p double, odds double"
    return rounded(of("all", t.spark.read.schema(schema).json(f"{path}/all")).unionByName(of("qualified", t.spark.read.schema(schema).csv(f"{path}/qualified", header=True))), 4)


@query("k6_backtest_result_set", "bets", """
select 'bets' as part, sport as run_id, count(*) as n, round(sum(profit), 4) as value from bets group by sport union all select 'bankroll', sport, count(distinct day), round(sum(profit), 4) from bets group by sport
union all select 'calibration', sport, count(distinct floor(p * 10)), round(sum(y), 4) from bets group by sport""")
def result_set(t):
    """Bets, daily bankroll and calibration tables of each run, in one folder by run."""
    b, path = t.bets().withColumn("run_id", F.col("sport")), new_path(t.spark)
    K.result_set(b, path, "run_id", "day", "profit", "p", "y")
    of = lambda part, value: t.spark.read.parquet(f"{path}/{part}").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("value")).select(F.lit(part).alias("part"), "run_id", "n", F.col("value").cast("double").alias("value"))
    return rounded(of("bets", "profit").unionByName(of("bankroll", "profit")).unionByName(of("calibration", "won")), 4)


@query("k7_superseding_rows", "bets", """
select bet_id, 1 as seq, false as supersedes_one from bets where y = 0 union all select bet_id, 1, false from bets where y = 1 union all select bet_id, 2, true from bets where y = 1""")
def superseding(t):
    """The same evidence adds no row, changed evidence (the winners' odds) adds one that names the row it supersedes."""
    b = t.bets().select("bet_id", "odds", "y")
    empty = t.spark.createDataFrame([], "bet_id long, settlement_id string, seq int")
    first = K.superseding(b, empty, "bet_id", ["odds", "y"])
    path = stored(first.select("bet_id", "settlement_id", "seq"), "parquet")
    again = K.superseding(b.withColumn("odds", F.when(F.col("y") == 1, F.col("odds") + 1).otherwise(F.col("odds"))), t.spark.read.parquet(path), "bet_id", ["odds", "y"])
    return first.unionByName(again).select("bet_id", "seq", F.col("supersedes").isNotNull().alias("supersedes_one"))


@query("k8_settlement_fields_only", "bets", """
, o as (select event, max(y) as won from bets group by event) select bet_id, case when season < 1997 then 'SETTLED' when won = 1 then 'WON' else 'LOST' end as status, odds from bets join o using (event)""")
def settle_only(t):
    """Pending rows get their status, settled ones and all other columns stay."""
    b = t.bets().withColumn("status", F.when(F.col("season") < 1997, "SETTLED").otherwise("PENDING")).select("bet_id", "event", "status", "odds")
    o = t.bets().groupBy("event").agg(F.max("y").alias("w")).select("event", F.when(F.col("w") == 1, "WON").otherwise("LOST").alias("status"))
    return K.settle(b, o, "event", ["status"]).select("bet_id", "status", "odds")


DAY_OF_MEMBER = r"^(?P<day>\d{4}-\d\d-\d\d)/"


def market_archives(t):
    """Events as exchange messages in archives of a week: a small compressed file for each market and day."""
    lines = message_feed(t).select(F.col("mc")[0]["id"].alias("market"), F.timestamp_millis("pt").alias("at"), F.to_json(F.struct("pt", "mc")).alias("line"), "pt")
    day = F.date_format("at", "yyyy-MM-dd")
    named = lines.select(F.date_format(F.date_trunc("week", "at"), "yyyyMMdd").alias("archive"), F.concat(day, F.lit("/"), "market", F.lit(".bz2")).alias("member"), F.col("pt").alias("number"), "line")
    return A.pack(named, new_path(t.spark))


def archived_messages(lines):
    return lines.where("error is null").select("day", "member", F.from_json("line", S.MESSAGES).alias("m")).select("day", "member", "m.pt", F.explode("m.mc").alias("c"))


@query("s7_archive_compaction", "", """
select strftime(make_timestamp(((epoch_us(ts) + 500) // 1000) * 1000), '%Y-%m-%d') || '/1.' || user_id || '.bz2' as member, count(*) as n_messages, count(*) filter (event_type <> 'click') as n_prices, max((epoch_us(ts) + 500) // 1000)::bigint as last_pt from events group by 1""")
def archive_compaction(t):
    """A summary of each file of the archives, which tasks read a packet of small files at a time."""
    m = archived_messages(A.archive_lines(t.spark, market_archives(t), DAY_OF_MEMBER))
    prices = F.aggregate("c.rc", F.lit(0), lambda n, r: n + r["ltp"].isNotNull().cast("int"))
    return m.groupBy("member").agg(F.count(F.lit(1)).alias("n_messages"), F.sum(prices).alias("n_prices"), F.max("pt").alias("last_pt"))


@query("k3_archive_days", "", """
select strftime(make_timestamp(((epoch_us(ts) + 500) // 1000) * 1000), '%Y-%m-%d') as day, count(distinct user_id) as markets, count(*) as n_messages from events group by 1""")
def archive_days(t):
    """Days out of archives, each written once: a second run reads no file of the days that are there. A run takes all files of its weeks,
    as each of them may hold some of a day."""
    archives, path = market_archives(t), new_path(t.spark)
    weeks = [files for _, files in sorted(A.by_key(archives).items())]
    for some in (sum(weeks[: len(weeks) // 2], []), archives):
        done = K.days_done(t.spark, path, "day")
        m = archived_messages(A.archive_lines(t.spark, some, DAY_OF_MEMBER, done)).groupBy("day", "member").agg(F.count(F.lit(1)).alias("n_messages"))
        K.write_days(m, path, "day")
    return t.spark.read.schema("member string, n_messages long, day string").parquet(path).groupBy("day").agg(F.count_distinct("member").alias("markets"), F.sum("n_messages").alias("n_messages"))


@query("d1_schema_drift", "", """
with y as (select distinct year(o_orderdate)::int as season from orders), f as (select min(season) as first from y)
select season, c as "column", case c when 'referee' then 'string' when 'goals' then 'string' end as kind, case c when 'referee' then 'ADDED' when 'goals' then 'RETYPED' else 'MISSING' end as status
from y, f, (values ('referee'), ('goals'), ('clerk')) g(c) where (c = 'referee' and season >= first + 2) or (c = 'goals' and season >= first + 3) or (c = 'clerk' and season >= first + 4)""")
def schema_drift(t):
    """Seasons whose files name other columns than the first one's, or give them another type; only footers are read."""
    o, path = t.read("orders").withColumn("season", F.year("o_orderdate")), new_path(t.spark)
    seasons = sorted(r[0] for r in o.select("season").distinct().collect())  # a row a season
    for k, season in enumerate(seasons):
        goals = (F.col("o_custkey") % 7).cast("string" if k >= 3 else "long").alias("goals")
        columns = ["o_orderkey", goals, *([F.lit("r").alias("referee")] if k >= 2 else []), *([F.col("o_clerk").alias("clerk")] if k < 4 and "o_clerk" in o.columns else [F.lit("c").alias("clerk")] if k < 4 else [])]
        o.where(F.col("season") == season).select(*columns).write.parquet(f"{path}/season={season}")
    found = A.declared_columns(t.spark, path).withColumn("season", F.regexp_extract("file", r"season=(\d+)", 1).cast("int"))
    return A.schema_drift(found, "season").select("season", "column", F.when(F.col("status") != "MISSING", F.col("kind")).alias("kind"), "status")


@query("d1_season_coverage", "", """
select year(o_orderdate)::int as season, count(*) as matches, round(count(*) filter (o_orderstatus <> 'P') / count(*), 6) as with_goals, round(count(*) filter (o_custkey % 3 = 0) / count(*), 6) as ranked, count(distinct o_orderdate::date) as days,
  max(o_orderdate)::date - min(o_orderdate)::date + 1 - count(distinct o_orderdate::date) as silent_days, count(*) filter (o_orderpriority like '5%') as retired from orders group by 1""")
def coverage(t):
    """By season: matches, shares with goals and with a ranking, days without any match, retirements."""
    o, n = t.read("orders").withColumn("day", F.to_date("o_orderdate")), F.count(F.lit(1))
    return rounded(o.groupBy(F.year("day").alias("season")).agg(
        n.alias("matches"), (F.count_if(F.col("o_orderstatus") != "P") / n).alias("with_goals"), (F.count_if(F.col("o_custkey") % 3 == 0) / n).alias("ranked"), F.count_distinct("day").alias("days"),
        (F.datediff(F.max("day"), F.min("day")) + 1 - F.count_distinct("day")).alias("silent_days"), F.count_if(F.col("o_orderpriority").startswith("5")).alias("retired"),
    ))
