"""Names of one source from another's: by fixtures whose kickoffs lie close together, by elimination, and by the names' own words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelark.functions.text import folded
from quotelark.scratch import cut, discard

# Words that say nothing about which club a name means.
GENERIC_WORDS = (
    "fc sc sv ac as us cf afc vfb vfl tsg fsv rc ogc club de the 1 04 05 1899 1846 1909 united city real sporting stade ssc bv ss"
).split()


def words(name: Column, generic: Sequence[str] = GENERIC_WORDS) -> Column:
    return F.array_except(F.array_distinct(F.split(folded(name), "[^a-z0-9]+")), F.array(*map(F.lit, ["", *generic])))


def slots(fixtures: DataFrame, odds: DataFrame, comp: str, at: str, home: str, away: str, minutes: int) -> DataFrame:
    """Each fixture with the other source's fixtures of its competition within `minutes` of its kickoff.

    Kickoffs fall into buckets of that width and meet the other source's in their own and both neighbouring ones, so the join is by
    equal keys, whatever the tolerance.
    """
    width = minutes * 60_000_000
    bucket = F.floor(F.unix_micros(at) / width)
    a = fixtures.select(F.col(comp).alias("comp"), F.unix_micros(at).alias("at"), F.col(home).alias("f_home"), F.col(away).alias("f_away"), bucket.alias("bucket")).distinct()
    a = a.withColumn("fixture", F.struct("at", "f_home", "f_away"))
    b = odds.select(F.col(comp).alias("comp"), F.unix_micros(at).alias("e_at"), F.col(home).alias("e_home"), F.col(away).alias("e_away"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    near = F.abs(F.col("at") - F.col("e_at")) <= width
    return a.join(b.distinct(), ["comp", "bucket"]).where(near).select("comp", "fixture", "f_home", "f_away", "e_at", "e_home", "e_away")


def derive_names(fixtures: DataFrame, odds: DataFrame, comp: str, at: str, home: str, away: str, minutes: int = 10) -> DataFrame:
    """(comp, name, alias, method): the other source's name of each team, with how it was found.

    A name stays a candidate while every fixture of the team has a fixture near its kickoff in which it plays on that side against a candidate of
    the opponent. A team with one candidate takes it from all others. Where several are left, a candidate that alone shares a word
    with the team, and with no other undecided team, is picked. All three go on until nothing changes; a round is a few joins of
    candidates, and its tables are deleted once the next is written. A competition is rejected (method CONFLICT) if a team has no candidate left, two
    teams end with one name, or a fixture of two named teams isn't found exactly once; a team with several candidates is AMBIGUOUS, one that
    never had a fixture near is NONE.
    """
    near = cut(slots(fixtures, odds, comp, at, home, away, minutes))
    sides = lambda rows: rows.select("comp", "fixture", F.explode(F.array(F.struct(F.col("f_home").alias("name"), F.col("e_home").alias("alias")), F.struct(F.col("f_away").alias("name"), F.col("e_away").alias("alias")))).alias("s")).select("comp", "fixture", "s.*")
    need = cut(sides(near).groupBy("comp", "name").agg(F.count_distinct("fixture").alias("need")))

    def everywhere(rows: DataFrame) -> DataFrame:
        met = sides(rows).distinct().groupBy("comp", "name", "alias").agg(F.count(F.lit(1)).alias("met"))
        return met.join(need, ["comp", "name"]).where("met = need").select("comp", "name", "alias")

    def settled(left: DataFrame) -> DataFrame:
        """Candidates after fixtures and elimination have nothing more to say."""
        n = left.count()
        while True:
            at_home = left.select("comp", F.col("name").alias("f_home"), F.col("alias").alias("e_home"))
            at_away = left.select("comp", F.col("name").alias("f_away"), F.col("alias").alias("e_away"))
            fit = everywhere(near.join(at_home, ["comp", "f_home", "e_home"]).join(at_away, ["comp", "f_away", "e_away"]))
            kept = cut(left.join(fit, ["comp", "name", "alias"], "left_semi"))
            alone = kept.groupBy("comp", "name").agg(F.count(F.lit(1)).alias("n"), F.min("alias").alias("alias")).where("n = 1")
            owners = alone.groupBy("comp", "alias").agg(F.min("name").alias("first"), F.max("name").alias("last"))
            free = F.col("first").isNull() | ((F.col("first") == F.col("name")) & (F.col("last") == F.col("name")))
            after = cut(kept.join(owners, ["comp", "alias"], "left").where(free).select("comp", "name", "alias"))
            discard(left, kept)
            m = after.count()
            if m == n:
                return after
            left, n = after, m

    def found(left: DataFrame, method: str) -> DataFrame:
        return left.groupBy("comp", "name").agg(F.count(F.lit(1)).alias("n"), F.min("alias").alias("alias")).where("n = 1").select("comp", "name", F.lit(method).alias("method"))

    left = settled(cut(everywhere(near)))
    method = cut(found(left, "FIXTURE_IDENTITY"))
    while True:
        undecided = left.join(method, ["comp", "name"], "left_anti")
        shared = cut(undecided.where(F.arrays_overlap(words(F.col("name")), words(F.col("alias")))))
        one = shared.groupBy("comp", "name").agg(F.count(F.lit(1)).alias("n"), F.min("alias").alias("alias")).where("n = 1").drop("n")
        claims = shared.groupBy("comp", "alias").agg(F.count(F.lit(1)).alias("claims"))
        picks = cut(one.join(claims.where("claims = 1"), ["comp", "alias"]).select("comp", "name", "alias"))
        if picks.isEmpty():
            break
        rest = left.join(picks.select("comp", "name"), ["comp", "name"], "left_anti")
        left = settled(cut(rest.unionByName(picks)))
        known = method.unionByName(picks.select("comp", "name", F.lit("NAME_WORD").alias("method")))
        method = cut(known.unionByName(found(left, "ELIMINATION").join(known, ["comp", "name"], "left_anti")))

    mapped = left.groupBy("comp", "name").agg(F.count(F.lit(1)).alias("n"), F.min("alias").alias("alias"))
    single = cut(mapped.where("n = 1").select("comp", "name", "alias"))
    a, b = single.select("comp", F.col("name").alias("f_home"), F.col("alias").alias("a_home")), single.select("comp", F.col("name").alias("f_away"), F.col("alias").alias("a_away"))
    agrees = (F.col("e_home") == F.col("a_home")) & (F.col("e_away") == F.col("a_away"))
    unseen = near.join(a, ["comp", "f_home"]).join(b, ["comp", "f_away"]).groupBy("comp", "fixture").agg(F.count_if(agrees).alias("n")).where("n <> 1").select("comp")
    empty = need.join(left, ["comp", "name"], "left_anti").select("comp")
    twice = single.groupBy("comp", "alias").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("comp")
    rejected = cut(unseen.union(empty).union(twice).distinct()).withColumn("rejected", F.lit(True))
    teams = fixtures.select(F.col(comp).alias("comp"), F.explode(F.array(home, away)).alias("name")).distinct()
    out = teams.join(need.select("comp", "name", "need"), ["comp", "name"], "left").join(single, ["comp", "name"], "left").join(method, ["comp", "name"], "left").join(rejected, "comp", "left")
    how = F.when(F.col("need").isNull(), "NONE").when(F.col("rejected"), "CONFLICT").when(F.col("alias").isNull(), "AMBIGUOUS").otherwise(F.col("method"))
    sure = ~how.isin("NONE", "CONFLICT", "AMBIGUOUS")
    return out.select("comp", "name", F.when(sure, F.col("alias")).alias("alias"), how.alias("method"))


def normalised(rows: DataFrame, aliases: DataFrame, raw: str, canonical: str) -> DataFrame:
    """rows with `canonical` for their raw name, null where the name is unmapped. A raw name with two canonical ones is an error, not a choice."""
    one = aliases.groupBy(raw).agg(F.min(canonical).alias("_low"), F.max(canonical).alias("_high"))
    sure = F.when(F.col("_low") == F.col("_high"), F.col("_low")).when(F.col("_low").isNotNull(), F.raise_error(F.concat(F.lit("two canonical names for "), F.col(raw).cast("string"))))
    return rows.join(one.select(raw, sure.alias(canonical)), raw, "left")


def alias_conflicts(aliases: DataFrame, raw: str, canonical: str) -> DataFrame:
    """Raw names with several canonical ones, and these in order."""
    found = aliases.groupBy(raw).agg(F.sort_array(F.collect_set(canonical)).alias("canonicals"))
    return found.where(F.size("canonicals") > 1)
