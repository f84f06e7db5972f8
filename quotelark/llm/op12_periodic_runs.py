"""Periodic runs: stretches of words that repeat with a smallest period, found by string synchronising sets.

A run is a maximal stretch of at least `shortest` words and at least `power` (3 or more) of its smallest period. At each scale t = 8, 16, 32 ...
positions are chosen by hashes of the t words that begin there: a position stands in the set where its hash, or that of the
position t further on, is the least of all t + 1 between, so whether it is chosen depends on 2t words of context only, and
about two of every t positions are. Positions whose t words repeat with a period of at most t / 3 are left out of the minimum.
In a run of period p, 1.5 t <= p <= 3 t, a chosen position is chosen again p words on with the same context (2t words for p up to
2t, else 3t words), and nowhere between: so neighbours of equal context propose p, and hashes of 2^k words, compared from large k
to small, extend a proposal to both sides. Scales double, so every p from 12 on has one. The stretches left out at a scale are
runs of far smaller periods, which smaller scales have found by then; periods below 12 are compared word by word.

All texts of a block are worked on at once, each followed by a word that occurs nowhere else; longer texts come first, so that the
texts which are long enough for a scale are a prefix of the block. A text of n words takes time n log n and 8 n log2 n bytes.
Texts stay in their partition: nothing is shuffled.

Nulls, ties and odd input: a null or blank text has no words and no runs, and its collapsed text is empty; runs that overlap are all
returned, a stretch under its smallest period only; repeated rows, null ids and very long texts are rows like any other; an
empty table gives an empty result. Added columns (ADDED) replace input columns of their names; all other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quotelark.llm.common import WORD, blocks, mixed, table, word_lists

ADDED = ("runs", "collapsed")
ADDED_TYPE = "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
SCALE = 8
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def doubled(codes: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of the 1, 2, 4 ... words that begin at each place; the k-th covers the texts of at least 2^k words, a prefix."""
    sizes = np.diff(ends, prepend=0)
    levels = [mixed((codes.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER)]
    while True:
        half = 1 << (len(levels) - 1)
        long = np.flatnonzero(sizes > 2 * half)  # a size counts the separator
        if not len(long):
            return levels
        last = levels[-1][: ends[long[-1]] - half + 1]
        levels.append(mixed(last[:-half] * _MULTIPLIER + last[half:]))


def matched(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How many words from a and b on agree, or, going back, how many before a and b."""
    grown = np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels))):
        left, right = (a - grown - (1 << k), b - grown - (1 << k)) if back else (a + grown, b + grown)
        inside = (np.minimum(left, right) >= 0) & (np.maximum(left, right) < len(levels[k]))
        same = inside.copy()
        same[inside] = levels[k][left[inside]] == levels[k][right[inside]]
        grown += same.astype(np.int64) << k
    return grown


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(values)
    if n < width:
        return values[:0]
    rows = np.concatenate([values, np.full(-n % width, _NONE)]).reshape(-1, width)
    upto = np.minimum.accumulate(rows, axis=1).ravel()
    since = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[: n - width + 1], upto[width - 1 : n])


def covered(n: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True at places that some stretch [begin, end) holds."""
    steps = np.bincount(begins, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(steps[:n]) > 0


def unlike(found: np.ndarray) -> np.ndarray:
    """Rows (start, length, period), each stretch once, under its smallest period, in order."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    if len(found):
        found = found[np.r_[True, (np.diff(found[:, 0]) != 0) | (np.diff(found[:, 1]) != 0)]]
    return found


def small_periods(codes: np.ndarray, below: int, power: int) -> np.ndarray:
    """Runs of periods below `below` and at least SCALE words, by comparing each word with the one a period on."""
    out = [np.zeros((0, 3), np.int64)]
    for period in range(1, min(below, len(codes))):
        change = np.diff((codes[period:] == codes[:-period]).astype(np.int8), prepend=0, append=0)
        start, length = np.flatnonzero(change == 1), np.flatnonzero(change == -1) - np.flatnonzero(change == 1) + period
        long = length >= max(SCALE, power * period)
        out.append(np.stack([start[long], length[long], np.full(long.sum(), period)], axis=1))
    return unlike(np.concatenate(out))


def chosen(hashes: np.ndarray, scale: int, left_out: np.ndarray) -> np.ndarray:
    """The synchronising set: places whose hash, or that of the place `scale` on, is the least of those between."""
    hashes = np.where(left_out, _NONE, hashes)
    least = least_of(hashes, scale + 1)
    n = len(least)
    return np.flatnonzero((least != _NONE) & ((least == hashes[:n]) | (least == hashes[scale : scale + n])))


def neighbours(places: np.ndarray, context: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and the next place of equal context, where it is `least` to `most` words on."""
    order = np.argsort(context, kind="stable")
    here, there = places[order[:-1]], places[order[1:]]
    good = (context[order[:-1]] == context[order[1:]]) & (there - here >= least) & (there - here <= most)
    return here[good], there[good]


def find_runs(codes: np.ndarray, ends: np.ndarray, shortest: int = 24, power: int = 3) -> np.ndarray:
    """Rows (start, length, period) of all runs of texts that lie behind each other, the longest first.

    Each text ends with a code of its own, and `ends` are the places behind these.
    """
    sizes = np.diff(ends, prepend=0) - 1
    found = small_periods(codes, SCALE * 3 // 2, power)
    levels, scale = doubled(codes, ends), SCALE
    while True:
        long = np.flatnonzero(2 * sizes >= 3 * power * scale)
        if not len(long):
            break
        words, k = int(ends[long[-1]]), scale.bit_length() - 1
        hashes = levels[k][: words - scale + 1]
        repeated = found[(3 * found[:, 2] <= scale) & (found[:, 1] >= scale) & (found[:, 0] < words)]
        places = chosen(hashes, scale, covered(len(hashes), repeated[:, 0], repeated[:, 0] + repeated[:, 1] - scale + 1))
        twice = levels[k + 1][places]
        pairs = [neighbours(places, twice, -(-3 * scale // 2), 2 * scale)]
        further = places + 2 * scale < len(hashes)
        places, twice = places[further], twice[further]
        pairs.append(neighbours(places, mixed(twice * _MULTIPLIER + hashes[places + 2 * scale]), 2 * scale, 3 * scale))
        here, there = (np.concatenate(x) for x in zip(*pairs))
        before, after = matched(levels, here, there, True), matched(levels, here, there, False)
        grown = np.stack([here - before, before + after + there - here, there - here], axis=1)
        found = unlike(np.concatenate([found, grown[grown[:, 1] >= power * grown[:, 2]]]))
        scale *= 2
    return found[(found[:, 1] >= shortest) & (found[:, 1] >= power * found[:, 2])]


def runs_of_texts(texts: pa.Array, shortest: int, power: int) -> tuple[pa.Array, pa.Array]:
    """The runs of each text, by start and period, and each text's words without what runs repeat."""
    words, ends = word_lists(texts, lower=False)
    n = np.diff(ends)
    by_size = np.argsort(-n, kind="stable")
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    own_ends = np.cumsum(n[by_size] + 1)
    laid = np.zeros(int(own_ends[-1]) if len(n) else 0, np.int64)
    to = np.repeat(own_ends - 1 - n[by_size] - ends[:-1][by_size], n[by_size])
    source = np.repeat(ends[:-1][by_size] - (np.cumsum(n[by_size]) - n[by_size]), n[by_size]) + np.arange(int(n.sum()))
    laid[source + to] = codes[source]
    laid[own_ends - 1] = len(coded.dictionary) + np.arange(len(n))
    found = find_runs(laid, own_ends, shortest, power)
    rank = np.searchsorted(own_ends, found[:, 0], side="right")
    doc = by_size[rank]
    start = found[:, 0] - (own_ends - 1 - n[by_size])[rank]
    order = np.lexsort((found[:, 2], start, doc))
    doc, start, length, period = doc[order], start[order], found[order, 1], found[order, 2]
    at = ends[:-1][doc] + start
    kept = ~covered(len(words), at + period, at + length)
    kept_ends = np.concatenate([[0], np.cumsum(kept)])[ends]
    lists = pa.ListArray.from_arrays(pa.array(kept_ends, pa.int32()), words.filter(pa.array(kept)).cast(pa.string()))
    of_doc = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(n)))])
    rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(of_doc, pa.int32()), rows), pc.binary_join(lists, " ").cast(pa.string())


def detect(docs: DataFrame, shortest: int = 24, power: int = 3) -> DataFrame:
    """docs with `runs` (start, length, period in words, by start and period) and `collapsed`: the words, joined by spaces, of
    which each run keeps its first period only."""
    if power < 3 or shortest < SCALE:
        raise ValueError(f"runs of at least 3 periods and {SCALE} words can be found")
    kept = [f for f in docs.schema.fields if f.name not in ADDED]
    numbered = StructType([StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(kept)])  # any name may have a dot
    text = f"c{[f.name for f in kept].index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            runs, collapsed = runs_of_texts(block.column(text), shortest, power)
            yield pa.RecordBatch.from_arrays([*block.columns, runs, collapsed], [*block.schema.names, *ADDED])

    plain = docs.select(*(F.col(f"`{f.name}`").alias(n.name) for f, n in zip(kept, numbered)))
    return plain.mapInArrow(run, StructType([*numbered, *StructType.fromDDL(ADDED_TYPE)])).toDF(*(f.name for f in kept), *ADDED)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by crc32 of its id, repeats a stretch of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, w = F.floor(h / 10), F.col("words")
    n = F.size(w)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.array_join(F.slice(F.concat(F.slice(w, 1, a), again), 1, n), " ")
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    return docs.select("doc_id", "text", words.alias("words")).select("doc_id", F.when(n > 0, changed).otherwise(F.col("text")).alias("text"))


def most_repeated(runs: Column) -> Column:
    """The run with the greatest exact length / period, the first of equals; null if there is none."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.reduce(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = detect(planted(table(spark, sf_dir, "documents"))).withColumn("best", most_repeated(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return got.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
