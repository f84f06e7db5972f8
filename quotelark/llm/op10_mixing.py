"""Mixing sources to target weights: repetition rates per source, then whole copies plus one seeded Bernoulli copy.

Nulls, ties and odd input: a null source is a source of its own and comes last; a null or blank text has size 0 and takes
nothing; repeated rows with the same id draw the same copies, so reruns agree; rows with a null id draw by their text; a source
of size 0 has target 0 and rate 0; very long texts are counted whole, as one row; an empty table gives an empty result. Columns
of the input whose names clash with the added ones (ADDED, and `copy` in copies_of) are replaced by them; no other name matters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelark.llm.common import cut, table

ADDED = ("size", "source_size", "target", "rate", "copies", "taken")
#: Sources whose targets are broadcast, at most (some 100 bytes each); more are joined by sorting.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with `rank`, from 0 by code point, null last; sorted in ranges, so no task sees all of them."""
    keyed = cut(
        sources.withColumn("last", F.col("source").isNull())
        .repartitionByRange(F.col("last"), F.col("source"))
        .sortWithinPartitions("last", "source")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", 33))
    )
    counts = sorted((r["part"], r["count"]) for r in keyed.groupBy("part").count().collect())  # one row for each partition
    before, total = [F.lit(0)], 0
    for part, n in counts:
        before += [F.lit(part), F.lit(total)]
        total += n
    start = F.element_at(F.create_map(*before[1:]), F.col("part")) if counts else F.lit(0)
    return keyed.withColumn("rank", start + F.col("at") - F.shiftleft(F.col("part"), 33)).drop("last", "at", "part")


def targets(sources: DataFrame, weights: Sequence[float], growth: float, cap: float) -> DataFrame:
    """sources (source, source_size) with `target`: growth x all sizes shared by weight, none above cap x its own size.

    Each round fixes the targets that reach their stop and shares the rest anew; the driver sees three sums a round.
    """
    weighted = cut(
        ranked(sources).select("source", "source_size", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int")).alias("weight"))
    )
    size = F.col("source_size").cast("double")
    total = weighted.agg(F.sum(size)).first()[0] or 0.0
    level, stopped = 0.0, -1
    while True:
        full = size * cap <= F.col("weight") * level
        n, held, rest = weighted.agg(F.count(F.when(full, 1)), F.sum(F.when(full, size * cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == stopped or not rest:
            break
        level, stopped = (growth * total - (held or 0.0)) / rest, n
    return weighted.withColumn("target", F.least(size * cap, F.col("weight") * level))


def chance(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the key and the seed: the first 52 bits of their MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), growth: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """docs with size, source_size, target, rate, copies and taken. Only sums by source meet in a shuffle; texts stay where they are.

    Above BROADCAST_SOURCES sources the targets are joined by sorting, where adaptive execution splits a source that is too large.
    """
    kept = [c for c in docs.columns if c not in ADDED]
    source, key = F.col("row.source"), F.coalesce(F.col("row.doc_id").cast("string"), F.md5(F.coalesce("row.text", F.lit("")).cast("binary")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"))
    sized = rows.withColumn("size", n_words(F.col("row.text")))
    by_source = sized.groupBy(source.alias("source")).agg(F.sum("size").alias("source_size"))
    goals = targets(by_source, weights, growth, cap).select(F.col("source").alias("goal_source"), "source_size", "target")
    few = goals.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (chance(key, seed) < F.col("rate") - F.floor("rate")).cast("long")
    return (
        sized.join(F.broadcast(goals) if few else goals.hint("merge"), source.eqNullSafe(F.col("goal_source")))
        .withColumn("rate", rate)
        .withColumn("copies", F.floor("rate") + extra)
        .withColumn("taken", F.col("size") * F.col("copies"))
        .select("row.*", *ADDED)
    )


def copies_of(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it, with its number in `copy`."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


ORACLE = """
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents
), by_source as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighted as (
  select source, source_size,
         case (row_number() over (order by (source is null)::int, encode(source)) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight
  from by_source
), ordered as (
  select *, 2.0::double * source_size / weight as reach,
         sum(2.0::double * source_size) over (order by 2.0::double * source_size / weight, weight, source nulls last rows unbounded preceding) - 2.0::double * source_size as held,
         sum(weight) over () - sum(weight) over (order by 2.0::double * source_size / weight, weight, source nulls last rows unbounded preceding) + weight as rest,
         sum(source_size) over ()::double as total
  from weighted
), levels as (
  select max((1.5::double * total - held) / rest) filter (where (1.5::double * total - held) / rest <= reach) as level from ordered
), goals as (
  select source, source_size, least(2.0::double * source_size, weight * coalesce(level, 0)) as target from weighted, levels
)
select s.doc_id, s.size, g.source_size, round(g.target, 3) as target,
       (s.size * case when g.source_size = 0 then 0 else floor(g.target / g.source_size) + (('0x' || substr(md5('mix:' || s.doc_id), 1, 13))::bigint / 4503599627370496.0::double
          < g.target / g.source_size - floor(g.target / g.source_size))::int end)::bigint as taken
from sized s join goals g on s.source is not distinct from g.source
"""
