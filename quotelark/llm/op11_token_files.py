"""Token ids in binary shards, with Elias-Fano encoded document boundaries.

A shard is one file: a header, two Elias-Fano lists and the concatenated ids (two bytes each where the vocabulary allows, else
four). The first list holds where each document ends among the shard's ids, the second the documents' ids. An Elias-Fano list of n
numbers up to u keeps the lowest log2(u/n) bits of each number as they are and the rest as gaps in unary, some 2 + log2(u/n) bits a
number; the place of every 256th one of the unary part is kept in 32 bits, so that the i-th number is found by reading one stretch
of it (select). No table of 64-bit offsets exists: a shard's place in the whole is one number of its row in the list of shards.

Documents are dealt and sorted by ranges of their id, encoded where they land, and written shard by shard. The list of shards
is a Parquet table beside them; it names only what committed tasks wrote, so that lost executors leave no trace.

Encoding goes piece by piece: a text may be cut before any single space that stands between two characters that aren't white space, as
byte-level tokens never reach over such a place. Each different piece is encoded once and looked up from then on.

Nulls, ties and odd input: a null text is empty and an empty text has the end id alone; rows of one id go by a hash of their text,
equal rows in any order; rows with a null id come last, and read back with a null id; a very long text is encoded whole and
makes a shard of its own size; an empty table makes no shard and reads back empty. Only doc_id and text are read, so other names
can't clash.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelark.llm.common import blocks, table
from quotelark.llm.files import create, open_file, worker_object
from quotelark.scratch import new_path

TOKENIZER = "byte_bpe_50k.json"
END = 0
#: Ids that a shard holds at least before the next one is begun.
SHARD_IDS = 4_000_000
#: Every so many-th one of a unary part has its place kept.
STEP = 256
#: Different pieces, and their characters, that a worker remembers.
PIECES, PIECE_CHARS = 1_000_000, 32_000_000

MAGIC = b"QLSHARD1"
HEAD = "<8sIIQQQq6Q"  # magic, bytes an id, 0, documents, ids, documents without an id, least id, then three sections
LIST = "<QIIQ"  # numbers, low bits, kept places, bytes of the unary part

_CUT = re.compile(r"(?<=\S) (?=\S)")
_WIDE = re.compile(r"\s\s")
_SOLID = re.compile(r"\S+")
#: Marks the piece that begins a text in the table of pieces; no other piece begins with a space.
FIRST = " "
#: Pieces that are encoded in one call.
TOGETHER = 100


class EliasFano:
    """A list of numbers that never fall, read through any function (at, size) -> bytes."""

    def __init__(self, read, at: int):
        self.read = read
        self.n, self.low, self.kept, self.upper = struct.unpack(LIST, read(at, struct.calcsize(LIST)))
        self.places_at = at + struct.calcsize(LIST)
        self.lower_at = self.places_at + 4 * self.kept
        self.upper_at = self.lower_at + -(-self.n * self.low // 8)

    @staticmethod
    def encode(numbers: np.ndarray) -> bytes:
        numbers = np.ascontiguousarray(numbers, np.uint64)
        n = len(numbers)
        top = int(numbers[-1]) if n else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        bits = ((numbers[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (numbers >> np.uint64(low)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        unary[ones] = 1
        upper = np.packbits(unary, bitorder="little").tobytes()
        places = ones[::STEP].astype("<u4")
        return struct.pack(LIST, n, low, len(places), len(upper)) + places.tobytes() + np.packbits(bits, bitorder="little").tobytes() + upper

    def select(self, first: int, count: int) -> np.ndarray:
        """Numbers first .. first + count - 1: from the last kept place before them, and no further than needed."""
        count = max(0, min(count, self.n - first))
        if not count:
            return np.zeros(0, np.uint64)
        sample, last = first // STEP, (first + count - 1) // STEP + 1
        begin = int(np.frombuffer(self.read(self.places_at + 4 * sample, 4), "<u4")[0]) // 8
        end = int(np.frombuffer(self.read(self.places_at + 4 * last, 4), "<u4")[0]) // 8 + 1 if last < self.kept else self.upper
        unary = np.unpackbits(np.frombuffer(self.read(self.upper_at + begin, end - begin), np.uint8), bitorder="little")
        ones = np.flatnonzero(unary)
        skipped = int(np.frombuffer(self.read(self.places_at + 4 * sample, 4), "<u4")[0]) - 8 * begin
        at = int(np.searchsorted(ones, skipped)) + first - sample * STEP
        high = (ones[at : at + count] + 8 * begin - np.arange(first, first + count)).astype(np.uint64)
        if not self.low:
            return high
        bit, stop = first * self.low, (first + count) * self.low
        raw = np.unpackbits(np.frombuffer(self.read(self.lower_at + bit // 8, -(-stop // 8) - bit // 8), np.uint8), bitorder="little")
        digits = raw[bit % 8 : bit % 8 + count * self.low].reshape(count, self.low).astype(np.uint64)
        return (high << np.uint64(self.low)) | (digits << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def shard_bytes(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, width: int) -> Iterator[bytes]:
    """The parts of a shard's file. doc_ids rise, nulls last."""
    known = [d for d in doc_ids if d is not None]
    base = known[0] if known else 0
    ends = EliasFano.encode(np.cumsum(sizes))
    names = EliasFano.encode(np.array([d - base for d in known], np.uint64))
    at = struct.calcsize(HEAD)
    yield struct.pack(HEAD, MAGIC, width, 0, len(doc_ids), len(ids), len(doc_ids) - len(known), base, at, len(ends), at + len(ends), len(names), at + len(ends) + len(names), width * len(ids))
    yield ends
    yield names
    yield ids.astype(f"<u{width}").tobytes()


class Shard:
    """A shard's file, read in parts: offsets, document ids, and the ids of any stretch of documents."""

    def __init__(self, uri: str):
        self.file = open_file(uri)
        magic, self.width, _, self.documents, self.n_ids, self.nameless, self.base, ends_at, _, names_at, _, self.ids_at, _ = struct.unpack(HEAD, self.file.read_at(struct.calcsize(HEAD), 0))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        read = lambda at, size: self.file.read_at(size, at)
        self.ends, self.names = EliasFano(read, ends_at), EliasFano(read, names_at)

    def offsets(self, first: int, count: int) -> np.ndarray:
        """Where documents first .. first + count - 1 begin in the shard, and where the last of them ends."""
        ends = self.ends.select(first, count).astype(np.int64)
        begin = int(self.ends.select(first - 1, 1)[0]) if first else 0
        return np.concatenate([[begin], ends])

    def doc_ids(self, first: int, count: int) -> list[int | None]:
        found = [self.base + int(x) for x in self.names.select(first, count)] if first < self.names.n else []
        return found + [None] * (min(count, self.documents - first) - len(found))

    def ids(self, begin: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(self.width * (end - begin), self.ids_at + self.width * begin), f"<u{self.width}")

    def document(self, number: int) -> np.ndarray:
        """The ids of one document, by its number in the shard."""
        return self.ids(*self.offsets(number, 1))

    def find(self, doc_id: int) -> int | None:
        """The number of the first document of that id, by bisection over the coded list; None if there is none."""
        low, high = 0, self.names.n
        while low < high:
            mid = (low + high) // 2
            if self.doc_ids(mid, 1)[0] < doc_id:
                low = mid + 1
            else:
                high = mid
        return low if low < self.names.n and self.doc_ids(low, 1)[0] == doc_id else None


class Encoder:
    """Texts to ids. Pieces that were met are looked up; the rest go through the tokenizer together, a line feed between them.

    Where the tokenizer isn't byte-level by the usual pattern, whole texts are its pieces.
    """

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 else 4
        byte_level = re.match(r"ByteLevel\(add_prefix_space=False.*use_regex=True\)", str(self.tokenizer.pre_tokenizer))
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if byte_level and self.tokenizer.normalizer is None and len(feed) == 1 else None
        self.forget()

    def forget(self) -> None:
        self.met, self.chars = {}, 0
        self.begins, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def pieces(self, text: str) -> list[str]:
        """The first piece after a mark, then those that follow a space, without it."""
        if self.feed is None:
            return [FIRST + text]
        out = _CUT.split(text) if _WIDE.search(text) else text.split(" ")
        out[0] = FIRST + out[0]
        return out

    def learn(self, pieces: list[str]) -> None:
        joined = [p for p in pieces if _SOLID.fullmatch(p) and p[0] != FIRST]
        lone = [p for p in pieces if not _SOLID.fullmatch(p) or p[0] == FIRST]
        coded = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([p[1:] if p[:1] == FIRST else " " + p for p in lone], add_special_tokens=False)]
        sizes = [len(c) for c in coded]
        together = [" " + "\n ".join(joined[at : at + TOGETHER]) for at in range(0, len(joined), TOGETHER)]
        for encoding in self.tokenizer.encode_batch_fast(together, add_special_tokens=False):
            ids = np.array(encoding.ids, np.uint32)
            feeds = np.flatnonzero(ids == self.feed)
            sizes += (np.diff(feeds, prepend=-1, append=len(ids)) - 1).tolist()
            coded.append(np.delete(ids, feeds))
        self.met.update(zip(lone + joined, range(len(self.begins) - 1, len(self.begins) - 1 + len(pieces))))
        self.chars += sum(map(len, pieces))
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(np.array(sizes, np.int64))])
        self.ids = np.concatenate([self.ids, *coded])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        if len(self.begins) > PIECES or self.chars > PIECE_CHARS:
            self.forget()
        split = list(map(self.pieces, texts))
        new = set(chain.from_iterable(split)).difference(self.met)
        if new:
            self.learn(list(new))
        places = np.fromiter(map(self.met.__getitem__, chain.from_iterable(split)), np.int64)
        counts = np.diff(self.begins)[places]
        ends = np.cumsum(counts)
        ids = self.ids[np.repeat(self.begins[places] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)]
        upto = np.concatenate([[0], ends])[np.cumsum(list(map(len, split)), dtype=np.int64)]
        return ids, np.diff(upto, prepend=0)


def shard_writer(folder: str, file: str, end: int, shard_ids: int):
    """Documents in order to shards; a row for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder = TaskContext.get().partitionId(), None
        number, before, names, sizes, held, n = 0, 0, [], [], [], 0

        def written() -> pa.RecordBatch:
            uri, out = create(folder, ".ids")
            with out:
                for piece in shard_bytes(names, np.concatenate(sizes), np.concatenate(held), encoder.width):
                    out.write(piece)
            row = {"part": part, "number": number, "before": before, "uri": uri, "documents": len(names), "ids": n}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int64()), ("number", pa.int64()), ("before", pa.int64()), ("uri", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

        for block in blocks(batches):
            encoder = encoder or worker_object(f"tokenizer {file}", lambda: Encoder(file))
            ids, counts = encoder.encode(block.column("text").to_pylist())
            ids = np.insert(ids, np.cumsum(counts), end)
            names += block.column("doc_id").to_pylist()
            sizes.append(counts + 1)
            held.append(ids)
            n += len(ids)
            if n >= shard_ids:
                yield written()
                number, before, names, sizes, held, n = number + 1, before + n, [], [], [], 0
        if n:
            yield written()

    return run


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END, shard_ids: int = SHARD_IDS) -> None:
    """Encode docs (doc_id, text) into shards below `folder`, in rising order of doc_id; the list of shards is `folder`/shards.

    Texts are shuffled once. Equal keys are told apart by their row's place, so that one repeated id fills no single task.
    """
    file = tokenizer or public_tokenizers.path(TOKENIZER)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = (F.col("doc_id").asc_nulls_last(), "tie", "row")
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text")
    schema = "part long, number long, before long, uri string, documents long, ids long"
    dealt.mapInArrow(shard_writer(f"{folder}/files", file, end, shard_ids), schema).write.parquet(f"{folder}/shards")


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """The list of shards, each with the number of ids before it (`start`). The driver sums one row a task that wrote."""
    listed = spark.read.schema("part long, number long, before long, uri string, documents long, ids long").parquet(f"{folder}/shards")
    start, firsts = 0, []
    for part, n in sorted(listed.groupBy("part").agg(F.sum("ids")).collect()):
        firsts.append((part, start))
        start += n
    return listed.join(F.broadcast(spark.createDataFrame(firsts, "part long, first long")), "part").withColumn("start", F.col("first") + F.col("before")).drop("first", "before")


def shard_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every document of the shards listed, a stretch of documents at a time."""
    for batch in batches:
        for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist()):
            shard, at = Shard(uri), 0
            while at < shard.documents:
                offsets = shard.offsets(at, 1024)
                ids = shard.ids(offsets[0], offsets[-1]).astype("<u4").tobytes()
                cuts = 4 * (offsets - offsets[0])
                cells = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
                found = shard.doc_ids(at, 1024)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(start + offsets[:-1], pa.int64()), pa.array(cells, pa.binary())], ["doc_id", "start", "ids"])
                at += len(found)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document, from the files: ids as unsigned 32-bit little-endian numbers, the end id included."""
    listed = shards(spark, folder).select("uri", "start")
    return listed.repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(shard_reader, "doc_id long, start long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark)
    write(table(spark, sf_dir, "documents"), folder)
    return read(spark, folder).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
