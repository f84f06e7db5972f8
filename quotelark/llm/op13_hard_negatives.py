"""Hard negatives: rows of another label that score just below an anchor's positives, found through zone maps of Hilbert-ordered blocks.

Vectors become whole numbers and are sorted along a Hilbert curve through the dimensions of greatest variance. Each range of the
curve is one Parquet file with a column for each dimension and a row group for each block of rows, so that the footer's
statistics are zone maps: the least and greatest value of each dimension in each block. From these, interval arithmetic bounds the
scores (inner products) that an anchor can reach in a block, from below and above.

Anchors are a stated query set, held against all rows in two passes. The first finds their positives, the best rows of the same label:
a floor is known from the anchor's own block, and only blocks that hold the label and whose upper bound reaches the floor are read. The
second finds, for each positive, the best rows of other labels within a window of scores below the positive's: only blocks whose bounds meet a
window are read, and floors rise as windows fill. A task holds one file's footer and the blocks that it has read (a file has
FILE_ROWS rows or few more), and gets the anchors in parcels; it returns at most the wanted number of rows for each anchor and window, which are merged
by anchor.

Scores are exact: products run in single or double precision only where no sum can leave the whole numbers that they hold, else in 64-bit
numbers; vectors whose scores may leave 64 bits raise an error.

Nulls, ties and odd input: rows with a null id, label or vector, or a null or non-finite component, take no part; rows that share an
id count once, the least by label and vector; shorter vectors are filled up with zeros; equal scores go by the smaller id; an anchor
without positives, or a positive without negatives, gives no row; an empty table gives an empty result. A label or a vector that very many rows share
is dealt over blocks like any other. Only the named columns are read, so other names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quotelark.llm.common import cut, table
from quotelark.llm.files import create, open_file
from quotelark.scratch import new_path

#: Rows of a block (one row group), and of a file, about.
BLOCK_ROWS, FILE_ROWS = 512, 1 << 18
#: Dimensions that the curve goes through, and bits of each.
CURVE_DIMS, CURVE_BITS = 7, 9
#: Anchors of a parcel.
PARCEL = 2048

#: Columns of a parcel, each an array of 64-bit numbers: of its anchors, then of their windows.
PACKED = ("anchors", "labels", "vectors", "slots", "lows", "highs", "owners")

FOUND = "anchor_id long, slot int, found_id long, score long"


def usable(vectors: DataFrame, row: str, label: str, vector: str, scale: int) -> DataFrame:
    """(id, label, vector): one row an id, vectors as whole numbers floor(scale * x)."""
    named = vectors.select(F.col(row).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = named.where("id is not null and label is not null and x is not null").where(finite)
    large = F.exists("x", lambda v: F.abs(v * scale) >= 2.0**53)
    whole = F.when(large, F.raise_error(F.lit("a component is too large for exact scores"))).otherwise(F.transform("x", lambda v: F.floor(v * scale).cast("long")))
    rows = sound.select(F.col("id").cast("long").alias("id"), F.struct(F.col("label").cast("long").alias("label"), whole.alias("vector")).alias("row"))
    return rows.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.vector")


def measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: rows, greatest square of a length, and sums and sums of squares by dimension."""
    n, most, sums, squares = 0, 0.0, np.zeros(0), np.zeros(0)
    for batch in batches:
        if batch.num_rows:
            x = filled(batch.column("vector")).astype(np.float64)
            wide = max(x.shape[1], len(sums))
            sums, squares = np.pad(sums, (0, wide - len(sums))), np.pad(squares, (0, wide - len(squares)))
            sums[: x.shape[1]] += x.sum(axis=0)
            squares[: x.shape[1]] += (x * x).sum(axis=0)
            n, most = n + len(x), max(most, float((x * x).sum(axis=1).max(initial=0)))
    yield pa.RecordBatch.from_pydict({"n": [n], "most": [most], "sums": [sums.tolist()], "squares": [squares.tolist()]}, pa.schema([("n", pa.int64()), ("most", pa.float64()), ("sums", pa.list_(pa.float64())), ("squares", pa.list_(pa.float64()))]))


def filled(vectors: pa.Array, wide: int | None = None) -> np.ndarray:
    """A list array as a matrix, short rows filled up with zeros."""
    ends = vectors.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(ends)
    flat = vectors.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]] if len(ends) else np.zeros(0, np.int64)
    out = np.zeros((len(sizes), max(wide or 0, int(sizes.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of cell numbers below 2**bits, by reflecting and exchanging axes from the top bit down."""
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for d in range(dims):
            on = (x[:, d] & bit) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, d] ^= swap
        bit >>= 1
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(len(x), np.int64)
    for k in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, -1] >> k) & 1, (1 << k) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for k in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[:, d] >> k) & 1)
    return key


class Shape:
    """What the whole table says about its vectors: dimensions, number type for exact products, and the curve's axes."""

    def __init__(self, rows: list):
        self.n = sum(r["n"] for r in rows)
        self.most = max((r["most"] for r in rows), default=0.0)
        self.dims = max((len(r["sums"]) for r in rows), default=0)
        wide = lambda x: np.pad(np.array(x), (0, self.dims - len(x)))
        sums, squares = (sum((wide(r[c]) for r in rows), np.zeros(self.dims)) for c in ("sums", "squares"))
        self.mean = sums / max(self.n, 1)
        self.spread = np.sqrt(np.maximum(squares / max(self.n, 1) - self.mean**2, 0))
        self.axes = np.argsort(-self.spread, kind="stable")[:CURVE_DIMS]
        reach = self.most * 1.001  # no sum of products goes beyond the square of the greatest length
        if reach >= 2**63:
            raise ValueError("scores of these vectors may leave 64 bits")
        self.exact = "float32" if reach < 2**24 else "float64" if reach < 2**53 else "int64"

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """Cells of equal width within three spreads of the mean, then the curve."""
        if not len(self.axes):
            return np.zeros(len(vectors), np.int64)
        z = (vectors[:, self.axes] - self.mean[self.axes]) / np.where(self.spread[self.axes] > 0, self.spread[self.axes], 1)
        cells = np.clip(((z + 3) / 6 * (1 << CURVE_BITS)).astype(np.int64), 0, (1 << CURVE_BITS) - 1)
        return hilbert(cells, CURVE_BITS)


def keyed(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = shape.keys(filled(batch.column("vector"), shape.dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key, pa.int64())], [*batch.schema.names, "key"])

    return run


def block_writer(folder: str, shape: Shape, every: int, wanted: int):
    """Sorted rows to one file of row groups; rows of two kinds: the file, and its anchors with a floor from their own block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), *((f"d{k}", pa.int64() if shape.most >= 2**60 else pa.int32()) for k in range(shape.dims))])
        kinds = pa.schema([("shelf", pa.int64()), ("uri", pa.string()), ("anchor", pa.int64()), ("label", pa.int64()), ("floor", pa.int64()), ("vector", pa.list_(pa.int64()))])
        shelf, uri, out, writer, held, size = TaskContext.get().partitionId(), None, None, None, [], 0

        def group(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal uri, out, writer
            if writer is None:
                uri, out = create(folder, ".parquet")
                writer = pq.ParquetWriter(out, schema, compression="zstd", use_dictionary=False)
            ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
            x = filled(rows["vector"].combine_chunks(), shape.dims)
            writer.write_table(pa.Table.from_arrays([pa.array(ids), pa.array(labels), *(pa.array(x[:, k]).cast(schema.field(2 + k).type) for k in range(shape.dims))], schema=schema), row_group_size=len(ids))
            at = np.flatnonzero(ids % every == 0)
            floors = np.full(len(at), np.iinfo(np.int64).min)
            scores = scored(x[at], x, shape.exact)
            for i, k in enumerate(at):
                own = np.sort(scores[i][(labels == labels[k]) & (ids != ids[k])])
                if len(own) >= wanted:
                    floors[i] = own[-wanted]
            if len(at):
                yield pa.RecordBatch.from_pylist([{"shelf": shelf, "uri": None, "anchor": int(ids[k]), "label": int(labels[k]), "floor": int(floors[i]), "vector": x[k].tolist()} for i, k in enumerate(at)], kinds)

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            while size >= BLOCK_ROWS:
                rows = pa.concat_tables(held)
                yield from group(rows.slice(0, BLOCK_ROWS))
                held, size = [rows.slice(BLOCK_ROWS)], size - BLOCK_ROWS
        if size:
            yield from group(pa.concat_tables(held))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"shelf": shelf, "uri": uri, "anchor": None, "label": None, "floor": None, "vector": None}], kinds)

    return run


def scored(anchors: np.ndarray, rows: np.ndarray, exact: str) -> np.ndarray:
    """Inner products, exact as whole numbers."""
    return (anchors.astype(exact) @ rows.astype(exact).T).astype(np.int64)


class Blocks:
    """A file of blocks: zone maps from its footer; a block is read when it is first wanted, and kept."""

    def __init__(self, uri: str, exact: str):
        self.file, self.exact, self.read = pq.ParquetFile(open_file(uri)), exact, {}
        meta = self.file.metadata
        stats = [[meta.row_group(g).column(c).statistics for c in range(1, meta.num_columns)] for g in range(meta.num_row_groups)]
        low, high = (np.array([[getattr(s, side) for s in row] for row in stats], np.float64 if exact != "int64" else object) for side in ("min", "max"))
        self.labels, self.low, self.high = (low[:, 0], high[:, 0]), low[:, 1:], high[:, 1:]

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest score that each anchor can reach in each block: each dimension at whichever end suits."""
        a = anchors.astype(self.low.dtype)
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T

    def block(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if number not in self.read:
            rows = self.file.read_row_group(number)
            x = np.stack([c.to_numpy() for c in rows.columns[2:]], axis=1) if rows.num_columns > 2 else np.zeros((rows.num_rows, 0))
            self.read[number] = rows["id"].to_numpy(), rows["label"].to_numpy(), x.astype(self.exact)
        return self.read[number]


class Best:
    """The best rows of each slot so far; a slot's floor is what a row must reach to be among them."""

    def __init__(self, floors: np.ndarray, wanted: int):
        self.floors, self.wanted = floors.copy(), wanted
        self.rows = np.zeros((3, 0), np.int64)  # slot, score, id
        self.new: list[np.ndarray] = []

    def add(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        self.new.append(np.stack([slots, scores, ids]))
        if sum(x.shape[1] for x in self.new) > 4 * self.wanted * len(self.floors):
            self.settle()

    def settle(self) -> None:
        rows = np.concatenate([self.rows, *self.new], axis=1)
        rows, self.new = rows[:, np.lexsort((rows[2], -rows[1], rows[0]))], []
        first = np.flatnonzero(np.diff(rows[0], prepend=-1))
        rank = np.arange(rows.shape[1]) - np.repeat(first, np.diff(first, append=rows.shape[1]))
        self.rows = rows[:, rank < self.wanted]
        full = rows[:, rank == self.wanted - 1]
        self.floors[full[0]] = np.maximum(self.floors[full[0]], full[1])


def searcher(exact: str, dims: int, wanted: int, positives: bool):
    """Parcels of anchors against one file each; every anchor has a window of scores [low, high] for each of its slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, blocks = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["uri"] != shelf:
                    shelf, blocks = row["uri"], Blocks(row["uri"], exact)
                yield from parcel(blocks, {c: np.frombuffer(row[c], np.int64) for c in PACKED})

    def parcel(blocks: Blocks, p: dict) -> Iterator[pa.RecordBatch]:
        vectors, owners = p["vectors"].reshape(-1, dims), p["owners"]
        least, most = blocks.bounds(vectors)
        best = Best(p["lows"], wanted)
        order = np.argsort(-most.max(axis=0, initial=0)) if len(vectors) else []
        for b in order:
            meets = (most[owners, b] >= best.floors) & (least[owners, b] <= p["highs"])
            if positives:
                meets &= (p["labels"][owners] >= blocks.labels[0][b]) & (p["labels"][owners] <= blocks.labels[1][b])
            slots = np.flatnonzero(meets)
            if not len(slots):
                continue
            ids, labels, x = blocks.block(int(b))
            of = np.unique(owners[slots])
            scores = scored(vectors[of], x, exact)
            same = p["labels"][of][:, None] == labels[None, :]
            good = same & (p["anchors"][of][:, None] != ids[None, :]) if positives else ~same
            place = np.searchsorted(of, owners[slots])
            for part in range(0, len(slots), 256):
                some, at = slots[part : part + 256], place[part : part + 256]
                held = scores[at]
                hit = good[at] & (held >= best.floors[some][:, None]) & (held <= p["highs"][some][:, None])
                i, k = np.nonzero(hit)
                best.add(some[i], held[i, k], ids[k])
            best.settle()
        slot, score, found = best.rows
        if len(slot):
            owner = owners[slot]
            yield pa.RecordBatch.from_arrays([pa.array(p["anchors"][owner]), pa.array(p["slots"][slot], pa.int32()), pa.array(found), pa.array(score)], [c.split()[0] for c in FOUND.split(", ")])

    return run


def parcels(rows: DataFrame) -> DataFrame:
    """Rows (anchor, label, vector, windows) packed into parcels; windows are (slot, low, high)."""

    def packed(held: list[dict]) -> pa.RecordBatch:
        windows = [(w["slot"], w["low"], w["high"], i) for i, r in enumerate(held) for w in r["windows"]]
        numbers = np.array(windows, np.int64).reshape(-1, 4)
        cols = {"anchors": [r["anchor"] for r in held], "labels": [r["label"] for r in held], "vectors": [r["vector"] for r in held]}
        cols |= dict(zip(PACKED[3:], numbers.T))
        return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v, np.int64).tobytes()], pa.binary()) for v in cols.values()], list(cols))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= PARCEL:
                yield packed(held[:PARCEL])
                held = held[PARCEL:]
        if held:
            yield packed(held)

    return rows.mapInArrow(run, ", ".join(f"{c} binary" for c in PACKED))


def best_of_files(found: DataFrame, wanted: int) -> DataFrame:
    """The best rows of each anchor and slot over all files, with their rank from 1."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)


class Index:
    """Blocks of all usable rows in files, and the anchors among them."""

    def __init__(self, rows: DataFrame, every: int, wanted: int, file_rows: int = FILE_ROWS):
        self.spark = rows.sparkSession
        rows = cut(rows)
        self.shape = Shape(rows.mapInArrow(measures, "n long, most double, sums array<double>, squares array<double>").where("n > 0").collect())  # one row a task
        self.partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        files = max(self.partitions, -(-self.shape.n // file_rows))
        dealt = rows.mapInArrow(keyed(self.shape), "id long, label long, vector array<long>, key long").repartitionByRange(files, "key", "id").sortWithinPartitions("key", "id")
        made = cut(dealt.select("id", "label", "vector").mapInArrow(block_writer(new_path(self.spark), self.shape, every, wanted), "shelf long, uri string, anchor long, label long, floor long, vector array<long>"))
        self.files = [r["uri"] for r in made.where("uri is not null").select("shelf", "uri").orderBy("shelf").collect()]  # one row a file
        self.anchors = made.where("anchor is not null").select("anchor", "label", "floor", "vector")

    def search(self, anchors: DataFrame, wanted: int, positives: bool) -> DataFrame:
        """anchors (anchor, label, vector, windows), as parcels, against every file whose task then reads the blocks that matter."""
        if not self.files:
            return self.spark.createDataFrame([], FOUND)
        uri = F.explode(F.array(*map(F.lit, self.files))).alias("uri")
        sent = parcels(anchors).select("*", uri).repartition(len(self.files), "uri").sortWithinPartitions("uri")
        return sent.mapInArrow(searcher(self.shape.exact, self.shape.dims, wanted, positives), FOUND)


def window(slot: Column, low: Column, high: Column) -> Column:
    return F.struct(slot.cast("long").alias("slot"), low.cast("long").alias("low"), high.cast("long").alias("high"))


def mine(
    vectors: DataFrame, row: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256, every: int = 100, positives: int = 5, negatives: int = 5,
    share: tuple[int, int] = (80, 100), file_rows: int = FILE_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (ids divisible by `every`) and each of its
    best `positives` other rows of its label, the best `negatives` rows of other labels whose score is at least share[0] / share[1] of
    the positive's, and no more than it."""
    index = Index(usable(vectors, row, label, vector, scale), every, positives, file_rows)
    top, part, whole = 2**62, *share
    asked = index.anchors.withColumn("windows", F.array(window(F.lit(0), F.col("floor"), F.lit(top))))
    found = best_of_files(index.search(asked.select("anchor", "label", "vector", "windows"), positives, True), positives)
    own = cut(found.select("anchor_id", F.col("rank").alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")))
    score = F.col("positive_score")
    least = F.ceil(score.cast("decimal(38,0)") * part / whole)
    windows = own.where(score >= 0).groupBy("anchor_id").agg(F.collect_list(window(F.col("slot"), least, score)).alias("windows"))
    asked = index.anchors.join(windows, F.col("anchor") == F.col("anchor_id")).select("anchor", "label", "vector", "windows")
    below = best_of_files(index.search(asked, negatives, False), negatives)
    return below.join(own, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding"))


ORACLE = """
with usable as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from usable a, usable b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select p.anchor_id, p.positive_id, (row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id))::int as rank,
       s.other_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on p.anchor_id = s.anchor_id and not s.same and 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score
qualify rank <= 5
"""
