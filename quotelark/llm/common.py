"""Helpers shared by the corpus operators: scratch tables, Arrow batches, word arrays and hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelark.scratch import cut, discard  # noqa: F401  the operators take it from here

#: Characters of text that one block of rows may hold inside a task (a longer single text is a block of its own).
BLOCK_CHARS = 2_000_000

#: A word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held(fold: Column | str, modulus: int, at: int) -> Column:
    """True where crc32 of the id, written as text, leaves `at` modulo `modulus` (a null id: false)."""
    key = F.col(fold) if isinstance(fold, str) else fold
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus)) == at, F.lit(False))


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold at most `chars` bytes together, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, before + chars, side="right")))
            yield batch.slice(at, end - at)
            at = end


def filtered(df: DataFrame, function) -> DataFrame:
    """df with the rows that `function` (batches to batches) keeps; it sees the column text by its name and all others by number, as
    names with a dot can't go through it."""
    plain = df.select(*(F.col(f"`{c}`").alias(c if c == "text" else f"c{k}") for k, c in enumerate(df.columns)))
    return plain.mapInArrow(function, plain.schema).toDF(*df.columns)


def word_lists(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in one array, and where each text's words begin and end in it."""
    flat = pc.fill_null(texts, "")
    if lower:
        flat = pc.ascii_lower(flat)
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(flat))
    ends = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.values.slice(ends[0], ends[-1] - ends[0])
    ends = ends - ends[0]
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    if not real.all():
        kept = np.concatenate([[0], np.cumsum(real)])
        words, ends = words.filter(pa.array(real)), kept[ends]
    return words, ends


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal input, equal output, all bits spread."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


_SIGNS = re.compile(r"[\W_]+")


def plain_word(word: str) -> str:
    """A word without case and punctuation; one that is all punctuation stays."""
    return word.lower() if word.isalnum() else _SIGNS.sub("", word).lower() or word


#: Hashes of plain words met in this task, up to a bound; the words of later blocks are mostly among them.
_MET: dict[str, int] = {}
MET = 1_000_000


def word_hashes(words: pa.Array, plain: bool = False) -> np.ndarray:
    """A 64-bit hash for every word; each different word of a block is hashed once."""
    coded = words.dictionary_encode()
    values = coded.dictionary.to_pylist()
    digest = xxhash.xxh3_64_intdigest
    if plain:
        if len(_MET) > MET:
            _MET.clear()
        met = list(map(_MET.get, values))
        for k, (word, known) in enumerate(zip(values, met)):
            if known is None:
                met[k] = _MET[word] = digest(plain_word(word))
        table_ = np.array(met, np.uint64)
    else:
        table_ = np.fromiter((digest(w) for w in values), np.uint64, len(values))
    return table_[coded.indices.to_numpy(zero_copy_only=False)] if len(values) else np.zeros(0, np.uint64)


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values, sorted."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` neighbouring words; fewer words make one run."""
    n = len(hashes)
    if n == 0:
        return hashes
    span = min(width, n)
    out = np.full(n - span + 1, span, np.uint64)
    for k in range(span):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - span + 1 + k])
    return out


def with_schema(df: DataFrame, function, schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)
