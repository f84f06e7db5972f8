"""Picks whose participants are all different, and how much cards that share legs say together."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotelark.scratch import cut, discard


def distinct_top(rows: DataFrame, by: Sequence[str], order: Column, key: str, participants: Column, n: int) -> DataFrame:
    """Rows that picking greedily in `order` takes, no two of a group with a common participant: key, place and how many more were `left`.

    The greedy choice is found in parallel: a row is taken when it is the first of the undecided rows of each of its participants, and
    then decides all rows that share one with it. No round depends on a group's rows lying together, so a group may have any size;
    rows in random order are decided in about log n rounds. `order` tells all rows of a group apart.
    """
    open_ = cut(rows.select(*by, key, order.alias("order"), F.explode(participants).alias("who")))
    every, taken = [open_], []
    while True:
        first = open_.groupBy(*by, "who").agg(F.min("order").alias("first"))
        held = open_.join(first, [*by, "who"])
        new = cut(held.groupBy(*by, key, "order").agg(F.min((F.col("order") == F.col("first")).cast("int")).alias("wins")).where("wins = 1").drop("wins"))
        every.append(new)
        taken.append(new)
        busy = open_.join(new.select(*by, key), [*by, key], "left_semi").select(*by, "who").distinct()
        gone = open_.join(busy, [*by, "who"], "left_semi").select(*by, key).distinct()
        open_ = cut(open_.join(gone, [*by, key], "left_anti"))
        every.append(open_)
        if open_.isEmpty():
            break
    chosen = taken[0]
    for more in taken[1:]:
        chosen = chosen.unionByName(more)
    sizes = chosen.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))
    top = chosen.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy("order"))).where(F.col("place") <= n)
    out = cut(top.join(sizes, list(by)).select(*by, key, "place", F.greatest(F.col("size") - n, F.lit(0)).alias("left")))
    discard(*every)
    return out


def overlap_size(legs: DataFrame, card: str, event: str, selection: str, p: str, weight: str, most: int = 5) -> DataFrame:
    """(cards, n_eff): (sum of weights)^2 / sum over pairs of cards of weights times the correlation of their wins.

    legs: a row for each leg of a card, of different events, at most `most` a card; a leg's chance is the same on every card. Legs of
    different events are independent; a shared leg counts once, and opposite selections of one event can't both win.

    No pairs are made. For cards with chance P, u = w P / sqrt(P (1 - P)) and the product over shared events of x (1 / p for the same selection, 0
    for another), a pair adds u u' (product of x - 1). That product, less 1, is the sum over sets of shared events of the products of
    x - 1, so for each set of events it is enough to know the sum of u for each choice of selections on it. A set on one card only adds nothing,
    and one on several cards has only pairs that are on several: pairs are counted by their hashes first, and other sets aren't made.
    """
    leg = F.struct(F.col(event).alias("e"), F.col(selection).alias("s"), F.col(p).cast("double").alias("p"))
    cards = legs.groupBy(card).agg(F.sort_array(F.collect_list(leg)).alias("legs"), F.max(weight).cast("double").alias("w"))
    sound = F.when(F.size("legs") <= most, F.col("legs")).otherwise(F.raise_error(F.lit(f"a card has more than {most} legs")))
    chance = F.aggregate("legs", F.lit(1.0), lambda a, x: a * x["p"])
    cards = cut(cards.withColumn("legs", sound).withColumn("P", chance).withColumn("u", F.when((F.col("P") > 0) & (F.col("P") < 1), F.col("w") * F.sqrt(F.col("P") / (1 - F.col("P")))).otherwise(0.0)))
    leg_at = lambda k: F.get("legs", F.lit(k))
    pair = {c: F.xxhash64(leg_at(c[0])["e"], leg_at(c[1])["e"]) for c in combinations(range(most), 2)}
    present = lambda made: F.explode(F.filter(F.array(*made), lambda x: x.isNotNull()))
    pairs = cards.select(F.col(card).alias("of"), present(F.when(F.size("legs") > max(c), h) for c, h in pair.items()).alias("pair"))
    common = cut(pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("pair"))
    held = pairs.join(common, "pair", "left_semi").groupBy("of").agg(F.collect_set("pair").alias("common"))
    several = cards.join(held, F.col(card).eqNullSafe(F.col("of")))
    sets = [c for size in range(2, most + 1) for c in combinations(range(most), size)]
    shared = lambda c: reduce(Column.__and__, [F.array_contains("common", pair[d]) for d in combinations(c, 2)], F.size("legs") > max(c))
    parts = cards.select("u", F.explode(F.transform("legs", lambda x: F.array(x))).alias("part"))
    if sets:
        parts = parts.unionByName(several.select("u", present(F.when(shared(c), F.array(*map(leg_at, c))) for c in sets).alias("part")))
    sums = cut(parts.groupBy(F.transform("part", lambda x: x["e"]).alias("events"), F.transform("part", lambda x: x["s"]).alias("sides")).agg(F.sum("u").alias("u"), F.sum(F.col("u") * F.col("u")).alias("uu"), F.max(F.transform("part", lambda x: x["p"])).alias("p")))
    a, b = sums.alias("a"), sums.select("events", F.col("sides").alias("sides_b"), F.col("u").alias("u_b")).alias("b")
    excess = F.aggregate(F.zip_with(F.zip_with("sides", "sides_b", lambda s, z: (s == z).cast("double")), "p", lambda same, q: same / q - 1), F.lit(1.0), lambda f, x: f * x)
    itself = F.aggregate("p", F.lit(1.0), lambda f, q: f * (1 / q - 1))
    crossed = a.join(b, "events").agg(F.sum(F.col("u") * F.col("u_b") * excess).alias("all"))
    alone = sums.agg(F.sum(F.col("uu") * itself).alias("own"))
    whole = cards.agg(F.count(F.lit(1)).alias("cards"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("ww"))
    one_row = whole.crossJoin(F.broadcast(crossed)).crossJoin(F.broadcast(alone))  # a row each
    return one_row.select("cards", (F.col("w") * F.col("w") / (F.col("ww") + F.col("all") - F.col("own"))).alias("n_eff"))


def cards_without_repeats(legs: DataFrame, by: Sequence[str], key: Column, k: int, participant: str) -> DataFrame:
    """Hash-ordered legs cut into cards of k; incomplete ones are dropped, and so are cards that name a participant twice, which `dropped` counts."""
    n = F.row_number().over(W.partitionBy(*by).orderBy(key))
    carded = legs.withColumn("card", ((n - 1) / k).cast("int")).groupBy(*by, "card").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(participant).alias("different"), F.exp(F.sum(F.log("p"))).alias("joint_p"), F.min("y").alias("won")
    )
    whole = carded.where(F.col("n") == k)
    dropped = whole.groupBy(*by).agg(F.count_if(F.col("different") < k).alias("dropped"))
    return whole.where(F.col("different") == k).join(dropped, list(by)).select(*by, "card", "joint_p", "won", "dropped")


def growth(legs: Column, share: float, lines: int | None) -> Column:
    """Expected log growth of one card over every outcome of its legs (p, odds), when `share` of the bankroll is staked on it.

    lines: the number of legs of each line, all lines of that many legs sharing the stake; None for one line of all legs. A mask of bits
    is an outcome or a line; sums run over both, so up to five legs cost at most 32 outcomes by 32 lines.
    """
    n = F.size(legs)
    full = F.pow(F.lit(2.0), n).cast("int") - 1
    masks = F.sequence(F.lit(1), full) if lines else F.array(full)
    chosen = F.filter(masks, lambda m: F.bit_count(m) == lines) if lines else masks
    places = F.sequence(F.lit(0), n - 1)
    bit = lambda mask, k: F.getbit(mask, k) == 1

    def outcome(mask: Column) -> Column:
        chance = F.aggregate(places, F.lit(1.0), lambda a, k: a * F.when(bit(mask, k), F.get(legs, k)["p"]).otherwise(1 - F.get(legs, k)["p"]))
        line = lambda m: F.when(m.bitwiseAND(mask) == m, F.aggregate(places, F.lit(1.0), lambda a, k: a * F.when(bit(m, k), F.get(legs, k)["odds"]).otherwise(1.0)) - 1).otherwise(-1.0)
        made = F.aggregate(chosen, F.lit(0.0), lambda a, m: a + line(m)) / F.size(chosen)
        return chance * F.log(1 + share * made)

    return F.aggregate(F.sequence(F.lit(0), full), F.lit(0.0), lambda a, m: a + outcome(m))


def loser_ranks(sets: DataFrame, p: str, y: str, n: int) -> DataFrame:
    """(rank, failed, observed, expected, z): how often the leg of each rank was a failed set's only loser, against what the chances say.

    p and y are arrays of n by falling chance. Given that a set fails, leg r is its only loser with chance (1 - p_r) P / p_r / (1 - P).
    """
    whole = F.aggregate(p, F.lit(1.0), lambda a, q: a * q)
    wins = F.aggregate(y, F.lit(0), lambda a, v: a + v)
    failed = sets.where(wins < n).withColumn("whole", whole).withColumn("wins", wins)
    rows = failed.select(F.posexplode(F.arrays_zip(F.col(p).alias("p"), F.col(y).alias("y"))).alias("rank", "leg"), "whole", "wins")
    one = (1 - F.col("leg.p")) * F.col("whole") / F.col("leg.p") / (1 - F.col("whole"))
    got = rows.groupBy((F.col("rank") + 1).alias("rank")).agg(F.count(F.lit(1)).alias("failed"), F.count_if((F.col("wins") == n - 1) & (F.col("leg.y") == 0)).alias("observed"), F.sum(one).alias("expected"))
    share = F.col("expected") / F.col("failed")
    return got.withColumn("z", (F.col("observed") - F.col("expected")) / F.sqrt(F.col("failed") * share * (1 - share)))
