"""Benchmark decontamination by pigeonhole edit matching.

Both sides are reduced to lower-case words of letters and digits with single spaces. An item of m characters may differ by
e = floor(share x m) edits; it is split into e + 1 pieces, so a passage within e edits holds one piece unchanged. One
Aho-Corasick pass over a document finds all exact piece hits; Myers' bit-parallel distance then verifies the text about each.

An item of under `min_chars` characters would be alike to ordinary prose, so it has no edit budget and is found only as whole words. An
item without letters and digits is looked for as it stands, between blanks, in the text with single blanks, where its span lies too.

Nulls, ties and odd input: null, empty or blank texts and items match nothing; repeated documents and items are each reported; of the
passages of one item in a document the first of the least distance is; a very long text is scanned whole, in a block of its own;
an empty table gives an empty result. find_leaks() has columns of its own only, and decontaminate() judges each row where it
lies, so null or shared ids and clashing names don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelark.llm.common import blocks, filtered, table

SCHEMA = "doc_id long, item_id long, distance int, begin int, end int"
#: Characters of test items in one automaton, the most that the driver holds and an executor is sent at once.
ITEM_CHARS = 4_000_000
_WORDS = re.compile(r"[^\W_]+")


def reduced(text: str | None) -> str:
    return " ".join(_WORDS.findall(text.lower())) if text else ""


def spaced(text: str | None) -> str:
    """The text as it stands, with single blanks."""
    return " ".join(text.split()) if text else ""


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(begin, piece) for edits + 1 pieces of nearly equal length."""
    marks = [len(item) * k // (edits + 1) for k in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(marks, marks[1:])]


def myers(item: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """The least edit distance of item to any substring of text, and where the first such substring ends; anchored: to any prefix."""
    m = len(item)
    masks: dict[str, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, where = m, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        flat = (((eq & up) + up) ^ up) | eq | down
        more = down | (full & ~(flat | up))
        less = up & flat
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more, less = (more << 1 | anchored) & full, (less << 1) & full
        up = less | (full & ~((eq | down) | more))
        down = (eq | down) & more
        if score < best:
            best, where = score, at
    return best, where


def automaton(items: list[tuple[int, str]], share: float, min_chars: int):
    """An automaton over all pieces; each piece carries (item's place, piece's begin, edits)."""
    found: dict[str, list[tuple[int, int, int]]] = {}
    for at, (_, item) in enumerate(items):
        edits = int(len(item) * share) if len(item) >= min_chars else 0
        for begin, piece in pieces(item, edits):
            found.setdefault(piece, []).append((at, begin, edits))
    auto = ahocorasick.Automaton()
    for piece, uses in found.items():
        auto.add_word(piece, (len(piece), uses))
    auto.make_automaton()
    return auto


def near(starts: set[int], size: int, edits: int) -> Iterator[tuple[int, int]]:
    """The windows about the places where an item may start, overlapping ones as one."""
    low = high = None
    for start in sorted(starts):
        if high is not None and start - edits <= high:
            high = start + size + edits
            continue
        if high is not None:
            yield low, high
        low, high = max(0, start - edits), start + size + edits
    if high is not None:
        yield low, high


def leaks(text: str, items: list[tuple[int, str]], auto, min_chars: int) -> list[tuple[int, int, int, int]]:
    """(item_id, distance, begin, end) of the best passage of each item that text holds."""
    starts: dict[int, set[int]] = {}
    budget: dict[int, int] = {}
    for last, (size, uses) in auto.iter(text):
        for at, begin, edits in uses:
            starts.setdefault(at, set()).add(last + 1 - size - begin)
            budget[at] = edits
    out = []
    for at, where in starts.items():
        item_id, item = items[at]
        edits, best = budget[at], None
        if len(item) < min_chars:
            whole = [k for k in where if text[k - 1 : k] in ("", " ") and text[k + len(item) : k + len(item) + 1] in ("", " ")]
            if whole:
                out.append((item_id, 0, min(whole), min(whole) + len(item)))
            continue
        for low, high in near(where, len(item), edits):
            distance, end = myers(item, text[low:high])
            if distance <= edits and (best is None or distance < best[0]):
                best = (distance, low + end)
        if best:
            distance, end = best
            back = myers(item[::-1], text[max(0, end - len(item) - edits) : end][::-1], anchored=True)[1]
            out.append((item_id, distance, end - back, end))
    return out


class Items:
    """A block of test items: reduced ones, and those that reducing would empty, as they stand."""

    def __init__(self):
        self.reduced: list[tuple[int, str]] = []
        self.signs: list[tuple[int, str]] = []
        self.chars = 0

    def add(self, item_id: int, text: str) -> None:
        item = reduced(text)
        rest = "" if item else spaced(text)
        if item:
            self.reduced.append((item_id, item))
        elif rest:
            self.signs.append((item_id, rest))
        self.chars += len(item) + len(rest)


class Finder:
    """The automata of a block of items; a task builds them once."""

    def __init__(self, items: Items, share: float, min_chars: int):
        self.items, self.min_chars = items, min_chars
        self.words = automaton(items.reduced, share, min_chars) if items.reduced else None
        self.signs = automaton(items.signs, 0.0, min_chars) if items.signs else None

    def hits(self, text: str | None) -> list[tuple[int, int, int, int]]:
        if not text:
            return []
        found = leaks(reduced(text), self.items.reduced, self.words, self.min_chars) if self.words else []
        if self.signs:
            found += leaks(spaced(text), self.items.signs, self.signs, 1 << 60)
        return found


def item_blocks(items: DataFrame) -> Iterator[Items]:
    """The items in blocks of bounded size; the driver holds one block at a time."""
    block = Items()
    for row in items.select("item_id", "text").where("text is not null").toLocalIterator():
        if block.chars and block.chars + len(row["text"]) > ITEM_CHARS:
            yield block
            block = Items()
        block.add(row["item_id"], row["text"])
    yield block


def scan(items: Items, share: float, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(items, share, min_chars)
        for block in blocks(batches):
            rows = []
            for doc_id, text in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist()):
                rows += [(doc_id, *x) for x in finder.hits(text)]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))],
                ["doc_id", "item_id", "distance", "begin", "end"],
            )

    return run


def clean(items: Items, share: float, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(items, share, min_chars)
        for block in blocks(batches):
            yield block.filter(pa.array([not finder.hits(t) for t in block.column("text").to_pylist()], pa.bool_()))

    return run


def find_leaks(docs: DataFrame, items: DataFrame, share: float = 0.05, min_chars: int = 40) -> DataFrame:
    """One row for each document and test item it holds within the edit budget: distance, and the span in the reduced text.

    Every document is scanned where it lies, without a shuffle, once for each block of items; hits of several blocks are united.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in item_blocks(items):
        part = docs.mapInArrow(scan(block, share, min_chars), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, share: float = 0.05, min_chars: int = 40) -> DataFrame:
    """docs without those that hold a test item; all columns stay. Each block of items is one pass over what the last one left."""
    for block in item_blocks(items):
        docs = filtered(docs, clean(block, share, min_chars))
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
