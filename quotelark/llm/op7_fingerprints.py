"""Document fingerprints by consistent weighted sampling.

A text's terms are its pairs of neighbouring words (a lone word is a term), weighted by how often they occur. For each of K
samples a term draws r and c from Gamma(2, 1) and b from the unit interval, from its own hash; with weight w it lands on step
t = floor(ln w / r + b), and the term with the least ln c - r (t - b + 1) is the sample. Two texts share sample (term, t) with
a probability equal to the generalised Jaccard similarity of their weighted terms, so the share of equal samples estimates it.
A fingerprint is written as K groups of four hex digits.

Nulls, ties and odd input: a null text is empty, and a text without words has a fingerprint of zeros, like only to another such;
equal texts have equal fingerprints, so repeated rows agree; rows of one id go by text; rows with a null id come after all
others, by a hash of their text and then the text, in ranges of that hash; one row is its own next document; a very long text is
read whole, in a block of its own; an empty table gives an empty result. Only doc_id and text are read, so other names can't clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelark.llm.common import BLOCK_CHARS, mixed, table, word_hashes, word_lists

SAMPLES = 64
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def gamma_quantiles() -> np.ndarray:
    """65,536 evenly spaced quantiles of Gamma(2, 1), whose distribution is 1 - (1 + x) exp(-x)."""
    u = (np.arange(65536) + 0.5) / 65536
    low, high = np.zeros(65536), np.full(65536, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < u
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return low


class Sampler:
    def __init__(self, samples: int, seed: int):
        self.samples = samples
        q = gamma_quantiles()
        self.r, self.log_c = q.astype(np.float32), np.log(q).astype(np.float32)
        self.b = ((np.arange(65536) + 0.5) / 65536).astype(np.float32)
        self.salts = mixed(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def terms(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, weight) of each different term of each text, in the order of the texts."""
        words, ends = word_lists(pa.array(texts, pa.large_string()))
        hashes = word_hashes(words)
        n = np.diff(ends)
        owner = np.repeat(np.arange(len(texts)), n)
        pairs = mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]) if len(hashes) > 1 else hashes[:0]
        inside = owner[:-1] == owner[1:]
        lone = n == 1
        doc = np.concatenate([owner[:-1][inside], np.flatnonzero(lone)])
        term = np.concatenate([pairs[inside], hashes[ends[:-1][lone]]])
        _, first, weight = np.unique(mixed(term + doc.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), return_index=True, return_counts=True)
        order = np.argsort(doc[first], kind="stable")
        first = first[order]
        return doc[first], term[first], weight[order]

    def signatures(self, texts: list[str]) -> np.ndarray:
        """(texts, samples) of 16-bit samples; a text without words has zeros, any other none."""
        out = np.zeros((len(texts), self.samples), np.uint16)
        doc, term, weight = self.terms(texts)
        if not len(doc):
            return out
        _, first, place = np.unique(mixed(term ^ (weight.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))), return_index=True, return_inverse=True)
        term, log_w = term[first], np.log(weight[first]).astype(np.float32)
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        having, number = doc[starts], np.arange(len(term), dtype=np.int64)
        for k, salt in enumerate(self.salts):
            bits = mixed(term ^ salt)
            r = self.r[bits & np.uint64(0xFFFF)]
            b = self.b[(bits >> np.uint64(16)) & np.uint64(0xFFFF)]
            step = np.floor(log_w / r + b)
            cost = self.log_c[(bits >> np.uint64(32)) & np.uint64(0xFFFF)] - r * (step - b + 1)
            rank = cost.view(np.int32)
            key = ((rank ^ ((rank >> 31) & 0x7FFFFFFF)).astype(np.int64) << 32) | number
            best = np.minimum.reduceat(key[place], starts) & 0xFFFFFFFF
            out[having, k] = mixed(term[best] + step[best].astype(np.int64).astype(np.uint64) * salt) % np.uint64(65535) + np.uint64(1)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def written(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def compare(samples: int, seed: int):
    """Rows (bucket, ahead, doc_id, text) in order to the results; each row's next is the row that follows it in its bucket."""

    def results(sampler: Sampler, rows: list[tuple], after: tuple | None) -> pa.RecordBatch:
        follow = [*rows[1:], after]
        out = [k for k, (row, nxt) in enumerate(zip(rows, follow)) if not row[1] and nxt is not None and nxt[0] == row[0]]
        texts = [row[3] for row in rows] + ([after[3]] if after else [])
        edited = []
        for k in out:
            text, half = texts[k], len(texts[k]) // 2
            edited.append(text[: len(text) - half] + texts[k + 1][:half])
        got = sampler.signatures(texts + edited)
        cols = [[], [], [], [], [], [], []]
        for i, k in enumerate(out):
            mine, other, nxt = got[k], got[len(texts) + i], got[k + 1]
            digest = hashlib.sha256(edited[i].encode("utf-8", "surrogatepass")).hexdigest()
            for col, x in zip(cols, (rows[k][2], len(texts[k]), digest, written(mine), written(other), likeness(mine, other), likeness(mine, nxt))):
                col.append(x)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, rows, size = Sampler(samples, seed), [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "ahead", "doc_id", "text"))):
                if size >= BLOCK_CHARS:
                    yield results(sampler, rows, row)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield results(sampler, rows, None)

    return run


def in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """docs dealt by ranges of falling id, each range followed by a copy of the next range's first document (`ahead`).

    The driver holds a few numbers a range, and a table of as many rows is broadcast. Texts are shuffled once, and no task needs
    more than its own ranges.
    """
    text, spark = F.coalesce("text", F.lit("")), docs.sparkSession
    tie = F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.lit(0))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("tie", tie)
    ids = docs.select("doc_id", "tie", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)).alias("id"))
    rows, nulls = ids.agg(F.count(F.lit(1)), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    cuts = sorted({float(x) for x in ids.where("doc_id is not null").approxQuantile("id", [k / buckets for k in range(1, buckets)], 0.2 / buckets)}) if buckets > 1 and rows > nulls else []
    if len(cuts) > 0:
        place = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="id", outputCol="place")
        number = lambda df: place.transform(df).withColumn("place", len(cuts) - F.col("place").cast("long"))
    else:
        number = lambda df: df.withColumn("place", F.lit(0).cast("long"))
    spread = max(1, math.ceil(buckets * nulls / max(rows, 1)))
    late = len(cuts) + 1 + F.least(F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * spread), F.lit(spread - 1))
    placed = lambda df: number(df).withColumn("own", F.when(F.col("doc_id").isNull(), late).otherwise(F.col("place")))
    heads = sorted(tuple(r) for r in placed(ids).groupBy("own").agg(F.max("doc_id").alias("head"), F.min("tie").alias("head_tie")).collect())  # one row a range
    if not heads:
        return docs.select(F.lit(0).alias("bucket"), F.lit(False).alias("ahead"), "doc_id", "text")
    into = [(*h, heads[k - 1][0]) for k, h in enumerate(heads)]  # the first range follows the last one
    known = spark.createDataFrame(into, "at long, head long, head_tie long, before long")
    dealt = placed(docs.withColumn("id", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)))).join(F.broadcast(known), F.col("own") == F.col("at"))
    first = F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("tie") == F.col("head_tie"))
    mine = F.struct(F.col("own").alias("bucket"), F.lit(False).alias("ahead"))
    to = F.when(first, F.array(mine, F.struct(F.col("before").alias("bucket"), F.lit(True).alias("ahead")))).otherwise(F.array(mine))
    return (
        dealt.select(F.explode(to).alias("to"), "doc_id", "tie", "text")
        .select("to.bucket", "to.ahead", "doc_id", "tie", "text")
        .repartition("bucket")
        .sortWithinPartitions("bucket", "ahead", F.col("doc_id").desc_nulls_last(), "tie", "text")
        .drop("tie")
    )


def fingerprints(docs: DataFrame, samples: int = SAMPLES, seed: int = 7) -> DataFrame:
    """For each document its fingerprint, that of its edited text, and both likenesses (see SCHEMA)."""
    wanted = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_order(docs, wanted).mapInArrow(compare(samples, seed), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
