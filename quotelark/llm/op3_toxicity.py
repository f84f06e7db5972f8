"""Toxicity by compression distance: zstandard with a toxic and an ordinary dictionary.

A text is reduced to lower-case words of letters (digits and signs are no part of what is compressed) and cut into windows. Each window is compressed with a dictionary of terms that mark toxic
text, with one of terms of ordinary text, and with a neutral one; the differences of the lengths, averaged over the text and at
their largest, go through a calibrated logistic threshold.

A dictionary's content is trained on a bounded sample of labelled documents: a term's occurrences count once for each different
pair of neighbours, so that copied passages don't count as evidence, and terms enter the toxic dictionary by the likelihood
ratio G2 of their counts in both classes. Plain COVER training (tried first) puts the words common to both classes into both
dictionaries and ranked held-out documents with an area under the curve of 0.64 to 0.87, by how the training text was picked (README
has the figures). The other half of the sample calibrates the threshold.

Nulls, ties and odd input: a null or empty text is one empty window; null labels teach nothing; a document labelled twice
counts as toxic if either label says so; without both classes in the sample every score is 0; equal texts and
repeated rows have equal scores; a very long text is read whole, window by window, in a block of its own; an empty table gives an
empty result. Only doc_id and text of the documents are read, so other names can't clash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelark.llm.common import blocks, cut, held, table

#: Documents of each class that the dictionaries and the threshold are fitted on, at most.
TOXIC_DOCS, ORDINARY_DOCS = 3000, 6000
TERMS, MIN_G2, WINDOW, MIN_MATCH = 1000, 15.0, 256, 5
_WORDS = re.compile(r"[^\W\d_]+")
FEATURES = ["gain_max", "gain_mean", "gap_max", "gap_mean", "gain_root", "hits", "length"]


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...] = ()


def sample(docs: DataFrame, labels: DataFrame, column: str, sizes: dict[int, int]) -> DataFrame:
    """(doc_id, text, label) of at most sizes[label] rows each, chosen by a hash of their ids. A row that is repeated counts once, and
    where rows share an id, so that too many of them have the chosen ids, the rows are bounded too."""
    by_id = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    chosen = None
    for label, n in sizes.items():
        part = by_id.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = cut(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"]))
    found = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # a row a label
    if all(n <= sizes[label] for label, n in found.items()):
        return rows
    order = (F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text"), F.col("text"))
    bounded = [rows.where(F.col("label") == label).orderBy(*order).limit(n) for label, n in sizes.items()]
    return cut(reduce(DataFrame.unionByName, bounded))


def contexts(labelled: DataFrame) -> DataFrame:
    """word, toxic, ordinary: in how many different pairs of neighbours it stands in each class."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\p{L}+)"), 1)
    triples = labelled.select("label", words.alias("w")).select(
        "label", F.explode(F.arrays_zip(F.concat(F.array(F.lit("")), "w").alias("a"), F.col("w").alias("b"), F.slice(F.col("w"), 2, 1 << 30).alias("c"))).alias("t")
    )
    once = triples.where("t.b is not null").select("label", "t.a", "t.b", "t.c").distinct()
    return once.groupBy(F.col("b").alias("word")).agg(F.count(F.when(F.col("label") == 1, 1)).alias("toxic"), F.count(F.when(F.col("label") == 0, 1)).alias("ordinary"))


def dictionaries(labelled: DataFrame) -> Model | None:
    counts = cut(contexts(labelled))
    toxic, ordinary = counts.agg(F.sum("toxic"), F.sum("ordinary")).first()
    if not toxic or not ordinary:
        return None
    share = (F.col("toxic") + F.col("ordinary")) / F.lit(toxic + ordinary)
    term = lambda k, of: F.when(k > 0, 2 * k * F.log(k / of)).otherwise(0.0)
    g2 = (
        term(F.col("toxic"), toxic * share) + term(F.col("ordinary"), ordinary * share)
        + term(toxic - F.col("toxic"), toxic * (1 - share)) + term(ordinary - F.col("ordinary"), ordinary * (1 - share))
    )
    marked = (F.col("toxic") >= 3) & (F.col("toxic") / toxic > 3 * F.col("ordinary") / ordinary) & (g2 > MIN_G2)
    bad = [r["word"] for r in counts.where(marked).orderBy(g2.desc(), "word").limit(TERMS).collect()]
    plain = counts.where((F.col("ordinary") > 0) & ~marked).orderBy((F.col("ordinary") * F.least(F.length("word"), F.lit(12))).desc(), "word").limit(TERMS)
    content = lambda words: ("  ".join(reversed(words))).join(("  ", "  ")).encode()  # noqa: E731  the best last, at the least distance
    a, b = content(bad), content([r["word"] for r in plain.collect()])
    return Model(a, b[-max(len(a), 64) :])


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters.from_level(3, strategy=zstandard.STRATEGY_DFAST, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
    made = zstandard.ZstdCompressionDict(content.ljust(16, b"0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=made, compression_params=settings)


def windows(text: str | None) -> list[bytes]:
    """Windows of the reduced text; each begins a little before the last one's end, so that no term is cut in all of them."""
    data = f" {' '.join(_WORDS.findall((text or '').lower()))} ".encode("utf-8", "surrogatepass")
    return [data[max(0, at - 16) : at + WINDOW] for at in range(0, len(data), WINDOW)]


class Meter:
    def __init__(self, model: Model):
        self.toxic, self.ordinary, self.neutral = compressor(model.toxic), compressor(model.ordinary), compressor(b"0123456789" * 2)

    def features(self, text: str | None) -> list[float]:
        gain_max = gap_max = -1e9
        gain = gap = n = hits = 0
        for window in windows(text):
            coded = len(self.toxic.compress(window))
            more, far = len(self.neutral.compress(window)) - coded, len(self.ordinary.compress(window)) - coded
            gain, gap, n, hits = gain + more, gap + far, n + 1, hits + (more >= 3)
            gain_max, gap_max = max(gain_max, more), max(gap_max, far)
        return [gain_max, gain / n, gap_max, gap / n, max(gain, 0) ** 0.5 / n, hits / n, math.log(n)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last is the constant."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def measure(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(model)
        for block in blocks(batches):
            got = np.array([meter.features(t) for t in block.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([block.column("label"), *map(pa.array, got.T)], ["label", *FEATURES])

    return run


def fit(docs: DataFrame, labels: DataFrame, sizes: dict[int, int] | None = None) -> Model | None:
    """The dictionaries from one half of a bounded sample, the threshold from the other; None without both classes."""
    labelled = sample(docs, labels, "toxic", sizes or {1: TOXIC_DOCS, 0: ORDINARY_DOCS})
    first = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0
    model = dictionaries(labelled.where(first))
    if model is None:
        return None
    rows = labelled.where(~first).select("label", "text").mapInArrow(measure(model), "label int, " + ", ".join(f"{f} double" for f in FEATURES)).collect()
    data = np.array(rows, float).reshape(len(rows), -1)
    if len({*data[:, 0]} if len(rows) else ()) < 2:
        return None
    return Model(model.toxic, model.ordinary, tuple(logistic(data[:, 1:], data[:, 0])))


def judge(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = model and Meter(model)
        for block in blocks(batches):
            score = np.zeros(block.num_rows)
            if meter:
                x = np.array([meter.features(t) for t in block.column("text").to_pylist()])
                score = 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights[:-1]) + model.weights[-1], -30, 30)))
            cols = [block.column("doc_id"), block.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (doc_id, held_out, text) with score and predicted, without a shuffle."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    return docs.mapInArrow(judge(model), "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held("doc_id", 5, 0))
    labels = table(spark, sf_dir, "labels").where(~held("doc_id", 5, 0))
    return toxicity(docs, fit(docs, labels))
