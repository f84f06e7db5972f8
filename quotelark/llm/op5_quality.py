"""Quality classification by nearest-neighbour voting on latent-semantic vectors.

A text's terms are its words, hashed to WORD_BINS, its pairs of bytes (case and signs kept), hashed to PAIR_BINS, and three more: a
word met for the first time in the text, a word met again, and a word that follows itself. Log counts are weighted by inverse document frequency over all
documents and projected on the leading singular vectors of a bounded sample of labelled documents. The sample's vectors are
broadcast; a block of documents is compared with all of them by one exact matrix product, and the K nearest vote with their
similarity, each class weighted so that both count alike.

Nulls, ties and odd input: a null text is empty, and a text without terms has no direction: its score is the mean vote; null
labels teach nothing; a document labelled twice has the higher label; repeated rows get equal scores; neighbours of equal
similarity go by their order in the sample; without labels every score is 1 (nothing speaks against a text); a very long text is
read whole, in a block of its own; an empty table gives an empty result. Only doc_id and text of the documents are read, so other
names can't clash; decide() keeps all their columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelark.llm.common import blocks, filtered, held, mixed, table, word_hashes, word_lists
from quotelark.llm.op3_toxicity import sample

#: Labelled documents of each class that are broadcast, at most (with RANK floats each, under 2 MB).
GOOD_DOCS, BAD_DOCS = 3000, 2000
WORD_BINS, PAIR_BINS, RANK, K, SHARPNESS = 4096, 1024, 64, 25, 4.0
TERMS = WORD_BINS + PAIR_BINS
BINS = TERMS + 3
ROWS = 512


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def bins() -> np.ndarray:
    """The bin of each pair of bytes."""
    return (np.random.Generator(np.random.Philox(5)).permutation(65536) % PAIR_BINS).astype(np.int64)


def counts(texts: pa.Array, table_: np.ndarray) -> np.ndarray:
    """(texts, BINS) term counts: words, pairs of bytes, words met first, words met again, words that follow themselves."""
    flat = pc.fill_null(texts, "")
    ends = np.frombuffer(flat.buffers()[1], np.int64 if pa.types.is_large_string(flat.type) else np.int32)[flat.offset : flat.offset + len(flat) + 1]
    raw = flat.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    n, rows = np.diff(ends), len(flat)
    out = np.zeros((rows, BINS), np.float32)
    if len(data) > 1:
        owner = np.repeat(np.arange(rows, dtype=np.int32), n)
        inside = owner[:-1] == owner[1:]
        pair = table_[data[:-1].astype(np.int32) * 256 + data[1:]]
        out[:, WORD_BINS:TERMS] = np.bincount((owner[:-1].astype(np.int64) * PAIR_BINS + pair)[inside], minlength=rows * PAIR_BINS).reshape(rows, -1)
    words, ends = word_lists(texts)
    hashes, total = word_hashes(words), np.diff(ends)
    own = np.repeat(np.arange(rows), total)
    out[:, :WORD_BINS] = np.bincount(own * WORD_BINS + (hashes % np.uint64(WORD_BINS)).astype(np.int64), minlength=rows * WORD_BINS).reshape(rows, -1)
    first = np.unique(mixed(hashes + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    out[:, TERMS] = np.bincount(own[first], minlength=rows)
    out[:, TERMS + 1] = total - out[:, TERMS]
    if len(words) > 1:
        out[:, TERMS + 2] = np.bincount(own[1:][(hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])], minlength=rows)
    return out


def weighted(got: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log counts by idf as unit rows, in place of the counts."""
    np.log1p(got, out=got)
    got *= idf
    got /= np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-9)
    return got


def unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def leading(x: np.ndarray, rank: int, rounds: int = 6) -> np.ndarray:
    """(columns of x, rank): the leading right singular vectors of x, by subspace iteration from a seeded start."""
    base = np.random.Generator(np.random.Philox(6)).standard_normal((x.shape[1], rank + 16)).astype(np.float32)
    for _ in range(rounds):
        base = np.linalg.qr(x.T @ (x @ base))[0]
    _, _, turned = np.linalg.svd(x @ base, full_matrices=False)
    return (base @ turned.T[:, :rank]).astype(np.float32)


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        for at in range(0, block.num_rows, ROWS):
            yield block.slice(at, ROWS)


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table_, seen, n = bins(), np.zeros(BINS, np.int64), 0
    for block in small(batches):
        seen += (counts(block.column("text"), table_) > 0).sum(0)
        n += block.num_rows
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BINS)), pa.array(np.r_[n, seen])], ["bin", "docs"])


def idf(docs: DataFrame) -> np.ndarray:
    """Inverse document frequencies over all documents; BINS + 1 sums reach the driver."""
    found = docs.select("text").mapInArrow(frequencies, "bin long, docs long").groupBy("bin").agg(F.sum("docs").alias("docs")).collect()
    got = np.zeros(BINS + 1)
    for row in found:
        got[row["bin"] + 1] = row["docs"]
    return (np.log((1 + got[0]) / (1 + got[1:])) + 0.2).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, sizes: dict[int, int] | None = None) -> Model | None:
    rows = sample(docs, labels, "quality", sizes or {0: BAD_DOCS, 1: GOOD_DOCS})

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = bins()
        for block in small(batches):
            got = counts(block.column("text"), table_)
            places = [np.flatnonzero(row) for row in got]
            packed = [pa.array([x.astype(t).tobytes() for x in xs], pa.binary()) for xs, t in ((places, np.int16), ([row[k] for row, k in zip(got, places)], np.float32))]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("label"), *packed], ["doc_id", "label", "bins", "counts"])

    found = sorted(rows.mapInArrow(features, "doc_id long, label int, bins binary, counts binary").collect(), key=lambda r: (r["doc_id"], r["bins"], r["counts"]))
    if not found:
        return None
    x = np.zeros((len(found), BINS), np.float32)
    for k, r in enumerate(found):
        x[k, np.frombuffer(r["bins"], np.int16)] = np.frombuffer(r["counts"], np.float32)
    labels_ = np.array([r["label"] for r in found], np.float32)
    del found
    weights = idf(docs)
    x = weighted(x, weights)
    basis = leading(x, RANK)
    return Model(weights, basis, unit(x @ basis), labels_)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest of each row, in order; of equal ones at the end the first places."""
    last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
    above, tied = cosine > last, cosine == last
    taken = above | tied & (np.cumsum(tied, axis=1) <= k - above.sum(1, keepdims=True))
    return np.nonzero(taken)[1].reshape(-1, k)


def votes(got: np.ndarray, model: Model) -> np.ndarray:
    """The weighted share of label 1 among the K nearest labelled vectors of each row."""
    y = model.labels
    good = y.sum()
    balance = np.where(y > 0, 0.5 / max(good, 1), 0.5 / max(len(y) - good, 1)).astype(np.float32)
    cosine = unit(weighted(got, model.idf) @ model.basis) @ model.vectors.T
    k = min(K, len(y))
    near = nearest(cosine, k)
    weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-3) ** SHARPNESS * balance[near]
    return np.clip((weight * y[near]).sum(1) / weight.sum(1), 0, 1).astype(float)


def judge(model: Model | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = bins()
        for block in small(batches):
            score = votes(counts(block.column("text"), table_), model) if model else np.ones(block.num_rows)
            cols = [c for name, c in zip(block.schema.names, block.columns) if name != "text"]
            names = [name for name in block.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    return run


def quality(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """docs (doc_id, held_out, text) with score and predicted, without a shuffle."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    return docs.mapInArrow(judge(model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def decide(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """docs without those scored below the threshold; all columns stay. Rows are judged where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = bins()
        for block in small(batches):
            score = votes(counts(block.column("text"), table_), model) if model else np.ones(block.num_rows)
            yield block.filter(pa.array(score >= threshold))

    return filtered(docs, run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held("doc_id", 5, 0))
    labels = table(spark, sf_dir, "labels").where(~held("doc_id", 5, 0))
    return quality(docs, fit(docs, labels))
