"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point. Binding three permuted letter vectors (their product,
after rotations by 2, 1 and 0 places) gives a trigram's vector; the sum of a text's trigram vectors is its profile, and the
sum over all texts of a language is that language's prototype. A text gets the language whose prototype has the largest
cosine with its profile. Letters are lower-cased; whatever is no letter counts as one space.

Nulls, ties and odd input: a null text, or one without a letter, is `und` with score 0; null languages teach nothing; of equal
cosines the first language by code point wins; without any training text all is `und`; repeated rows count each time; very long
texts are read in chunks, whole, that meet inside a word, so their trigrams are the same as without chunks; an empty table gives
an empty result. Only doc_id, text and lang are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelark.llm.common import blocks, held, table

DIMS = 1024
#: Languages whose prototypes are sent to executors at once (4 kB each); more go in several passes.
SENT_LANGS = 2000
UNKNOWN = "und"
CHUNK = 1_000_000
_TWO = re.compile(r"[^\W\d_]{2}")


def chunked(text: str, size: int = CHUNK) -> list[str]:
    """text in chunks of about `size` characters; two neighbours share two letters, so every trigram stands in one chunk."""
    out, begin = [], 0
    while len(text) - begin > size + 2:
        seam = next((m.start() for m in _TWO.finditer(text, begin + size) if m[0].isalpha()), None)
        if seam is None:
            break
        out.append(text[begin : seam + 2])
        begin = seam
    return [*out, text[begin:]]


class Profiles:
    """Trigram vectors for blocks of texts."""

    def __init__(self, dims: int, seed: int):
        self.dims, self.seed, self.letters = dims, seed, {}

    def letter(self, point: int) -> np.ndarray:
        got = self.letters.get(point)
        if got is None:
            bits = np.random.Generator(np.random.Philox(key=[self.seed, point])).integers(0, 2, self.dims, dtype=np.int8)
            got = self.letters[point] = (2 * bits - 1).astype(np.float32)
        return got

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code points of each different trigram, text of each trigram, number of each trigram) of padded, lower-case texts."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
        present = np.flatnonzero(np.bincount(points))
        alphabet = [32] + [int(p) for p in present if chr(p).isalpha()]
        dense = np.zeros(int(present[-1]) + 1, np.int32)
        dense[alphabet] = np.arange(len(alphabet))
        ids = dense[points]
        kept = np.ones(len(ids), bool)
        kept[1:] = (ids[1:] != 0) | (ids[:-1] != 0) | (owner[1:] != owner[:-1])
        ids, owner = ids[kept].astype(np.int64), owner[kept]
        size = len(alphabet)
        codes = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
        inside = owner[:-2] == owner[2:]
        codes, owner = codes[inside], owner[:-2][inside]
        if size <= 160:
            seen = np.flatnonzero(np.bincount(codes, minlength=1))
            place = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, np.int32)
            place[seen] = np.arange(len(seen))
            number = place[codes]
        else:
            seen, number = np.unique(codes, return_inverse=True)
        symbols = np.array(alphabet)
        return np.stack([symbols[seen // size // size], symbols[seen // size % size], symbols[seen % size]], 1), owner, number

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        points, where = np.unique(grams, return_inverse=True)
        base = np.stack([self.letter(int(p)) for p in points])
        a, b, c = where.reshape(grams.shape).T
        return np.roll(base, 2, 1)[a] * np.roll(base, 1, 1)[b] * base[c]

    def bundles(self, texts: list[str], group: np.ndarray, n: int) -> np.ndarray:
        """n profiles: the sums of the trigram vectors of the texts of each group."""
        out = np.zeros((n, self.dims), np.float64)
        chunks, owners = [], []
        for text, g in zip(texts, group):
            pieces = chunked(f" {text.lower()} ")
            chunks += pieces
            owners += [g] * len(pieces)
        if not chunks:
            return out
        grams, owner, number = self.grams(chunks)
        owner = np.asarray(owners)[owner]
        width = 4096
        for low in range(0, len(grams), width):
            part = grams[low : low + width]
            vectors = self.vectors(part)
            here = (number >= low) & (number < low + width) if len(grams) > width else slice(None)
            own, num = owner[here], number[here] - low
            step = max(1, 4_000_000 // len(part))
            for first in range(0, n, step):
                rows = min(step, n - first)
                mine = (own >= first) & (own < first + rows) if n > step else slice(None)
                counts = np.bincount((own[mine].astype(np.int64) - first) * len(part) + num[mine], minlength=rows * len(part))
                out[first : first + rows] += counts.reshape(rows, -1).astype(np.float32) @ vectors
        return out


def learn(dims: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(dims, seed), {}
        for block in blocks(batches):
            langs = block.column("lang").to_pylist()
            names = sorted(set(langs))
            place = {x: k for k, x in enumerate(names)}
            got = profiles.bundles(block.column("text").to_pylist(), np.array([place[x] for x in langs]), len(names))
            for name, vector in zip(names, got):
                sums[name] = sums.get(name, 0) + vector
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])], ["lang", "vector"])

    return run


def prototypes(labelled: DataFrame, dims: int = DIMS, seed: int = 1) -> dict[str, np.ndarray]:
    """The unit prototype of each language of labelled (text, lang). All sums are of whole numbers: they don't depend on order."""
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    partial = rows.mapInArrow(learn(dims, seed), "lang string, vector array<double>")
    sums = partial.select("lang", F.posexplode("vector").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    packed = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("d", "x")))["x"].alias("vector")).collect()  # one row for each language
    out = {}
    for row in sorted(packed, key=lambda r: r["lang"]):
        vector = np.array(row["vector"])
        if norm := np.linalg.norm(vector):
            out[row["lang"]] = (vector / norm).astype(np.float32)
    return out


def guess(known: dict[str, np.ndarray], dims: int, seed: int, carried: list[str]):
    """Puts the best of the known languages into lang_pred and score, where it beats what stands there; other columns are carried."""
    names = list(known)
    matrix = np.stack(list(known.values())) if known else np.zeros((0, dims), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(dims, seed)
        for block in blocks(batches):
            texts = [t or "" for t in block.column("text").to_pylist()]
            lang, score = block.column("lang_pred").to_pylist(), block.column("score").to_numpy()
            if names:
                got = profiles.bundles(texts, np.arange(len(texts)), len(texts))
                norm = np.linalg.norm(got, axis=1)
                cosine = got @ matrix.T / np.maximum(norm, 1e-9)[:, None]
                best = cosine.argmax(1)
                some = np.array([any(map(str.isalpha, t)) for t in texts])
                now = np.where(some, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0)
                better = some & ((now > score) | np.array([x == UNKNOWN for x in lang]))
                lang = [names[k] if ok else x for k, ok, x in zip(best, better, lang)]
                score = np.where(better, now, score)
            yield pa.RecordBatch.from_arrays([*map(block.column, carried), pa.array(lang, pa.string()), pa.array(score)], [*carried, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, known: dict[str, np.ndarray], dims: int = DIMS, seed: int = 1) -> DataFrame:
    """docs (doc_id, held_out, text) with lang_pred and score, without a shuffle; one pass for each SENT_LANGS languages."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    names = list(known)
    for at in range(0, len(names), SENT_LANGS):
        part = {k: known[k] for k in names[at : at + SENT_LANGS]}
        carried = ["doc_id long", "held_out boolean"] + ["text string"] * (at + SENT_LANGS < len(names))
        out = out.mapInArrow(guess(part, dims, seed, [c.split()[0] for c in carried]), ", ".join([*carried, "lang_pred string", "score double"]))
    return out.drop("text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held("doc_id", 4, 2))
    return identify(docs, prototypes(docs.where(~F.col("held_out"))))
