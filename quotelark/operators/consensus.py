"""From quotes to margin-free consensus, best price and candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotelark.functions.odds import devig


def complete_books(quotes: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """(market, book) with `complete`, `missing` and `unexpected`: a book must quote exactly the expected outcomes."""
    wanted = F.array(*map(F.lit, outcomes))
    got = quotes.groupBy("market", "book").agg(F.sort_array(F.collect_set("outcome")).alias("got"))
    return got.select(
        "market", "book",
        ((F.size(F.array_except(wanted, "got")) == 0) & (F.size(F.array_except("got", wanted)) == 0)).alias("complete"),
        F.concat_ws(",", F.array_sort(F.array_except(wanted, "got"))).alias("missing"),
        F.concat_ws(",", F.array_sort(F.array_except("got", wanted))).alias("unexpected"),
    )


def fair_by_book(quotes: DataFrame, outcomes: Sequence[str], method: str = "proportional") -> DataFrame:
    """(market, book, outcome, odds, p): margin-free chances of complete books, in one shuffle on (market, book)."""
    n = len(outcomes)
    books = (
        quotes.where("odds > 1")
        .groupBy("market", "book")
        .agg(F.sort_array(F.collect_list(F.struct("outcome", "odds"))).alias("q"))
        .where((F.size("q") == n) & (F.col("q.outcome") == F.array(*map(F.lit, sorted(outcomes)))))
    )
    fair = books.withColumn("p", devig(F.col("q.odds"), method))
    return fair.select("market", "book", F.explode(F.arrays_zip(F.col("q.outcome").alias("outcome"), F.col("q.odds").alias("odds"), "p")).alias("x")).select("market", "book", "x.outcome", "x.odds", "x.p")


def consensus(fair: DataFrame, least_books: int = 1) -> DataFrame:
    """Per market and outcome: median, mean, population deviation, inclusive quartile range, extremes and number of books."""
    return (
        fair.groupBy("market", "outcome")
        .agg(
            F.median("p").alias("median_p"), F.avg("p").alias("mean_p"), F.stddev_pop("p").alias("std_p"),
            (F.percentile("p", F.lit(0.75)) - F.percentile("p", F.lit(0.25))).alias("iqr_p"),
            F.min("p").alias("min_p"), F.max("p").alias("max_p"), F.count(F.lit(1)).alias("books"),
        )
        .where(F.col("books") >= least_books)
    )


def leave_one_out(fair: DataFrame) -> DataFrame:
    """Each book's price with the mean chance of all other books (null for a lone book), by a window: no self join."""
    w = W.partitionBy("market", "outcome")
    others = F.count(F.lit(1)).over(w) - 1
    return fair.withColumn("loo_p", F.when(others > 0, (F.sum("p").over(w) - F.col("p")) / others))


def best_price(quotes: DataFrame, accepted: DataFrame | None = None) -> DataFrame:
    """The highest odds for each outcome among accepted books; of equal odds the first book."""
    if accepted is not None:
        quotes = quotes.join(accepted, "book", "left_semi")
    best = quotes.groupBy("market", "outcome").agg(F.max(F.struct("odds", (-F.col("book")).alias("b"))).alias("x"))
    return best.select("market", "outcome", F.col("x.odds").alias("best_odds"), (-F.col("x.b")).alias("best_book"))


def candidates(quotes: DataFrame, outcomes: Sequence[str], accepted: DataFrame | None = None, least_books: int = 3) -> DataFrame:
    """Consensus chances with the best price for each outcome."""
    return consensus(fair_by_book(quotes, outcomes), least_books).join(best_price(quotes, accepted), ["market", "outcome"])


def margins(quotes: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """Mean margin of each book over its complete markets."""
    per = quotes.groupBy("market", "book").agg(F.count(F.lit(1)).alias("n"), F.sum(1 / F.col("odds")).alias("s")).where(F.col("n") == len(outcomes))
    return per.groupBy("book").agg(F.avg(F.col("s") - 1).alias("margin"), F.count(F.lit(1)).alias("markets"))


def dispersion(quotes: DataFrame, least: int = 3) -> DataFrame:
    """Best over median and best over worst odds of each outcome with enough books."""
    got = quotes.groupBy("market", "outcome").agg(F.max("odds").alias("best"), F.median("odds").alias("mid"), F.min("odds").alias("worst"), F.count(F.lit(1)).alias("books"))
    return got.where(F.col("books") >= least).select("market", "outcome", "books", (F.col("best") / F.col("mid")).alias("best_to_median"), (F.col("best") / F.col("worst")).alias("best_to_worst"))


def mean_odds_consensus(quotes: DataFrame, outcomes: Sequence[str], least_books: int) -> DataFrame:
    """Mean decimal odds per outcome over books that quote all, then margin-free."""
    w = W.partitionBy("market", "book")
    whole = quotes.withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") == len(outcomes))
    mean = whole.groupBy("market", "outcome").agg(F.avg("odds").alias("mean_odds"), F.count(F.lit(1)).alias("books")).where(F.col("books") >= least_books)
    return mean.withColumn("p", 1 / F.col("mean_odds") / F.sum(1 / F.col("mean_odds")).over(W.partitionBy("market")))


def normalised_triplets(rows: DataFrame, keys: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    """p scaled to sum 1 within each key; `status` is INCOMPLETE unless all outcomes are there, each once."""
    w = W.partitionBy(*keys)
    whole = (F.size(F.collect_set("outcome").over(w)) == len(outcomes)) & (F.count(F.lit(1)).over(w) == len(outcomes))
    return rows.withColumn("status", F.when(whole, "OK").otherwise("INCOMPLETE")).withColumn("norm_p", F.when(whole, F.col("p") / F.sum("p").over(w)))
