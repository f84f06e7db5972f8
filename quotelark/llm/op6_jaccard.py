"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (words without case and punctuation). Texts of the same words are collapsed first. The
rest get HASHES MinHash values; bands of ROWS values bucket them (a pair at similarity 0.8 shares a bucket with probability
0.9993). Within a bucket every member is compared with drawn centres first. A comparison looks at the MinHash
values in steps: after n of them with m equal, the similarity has the posterior Beta(m + 1, n - m + 1), and the pair is dropped
once the posterior probability of reaching the threshold falls below `tolerance`. What is left is verified exactly on the
shingle sets. Each bucket draws its centres by its own hash, so a text meets different ones in its buckets. After two rounds the
pairs of different classes that still share a bucket are all asked, in blocks: classes that pruning leaves a pair of make a loose
group, and the texts of each group are compared exactly, so nothing is left to ask and no list of all pairs is ever written.

A class is a connected component of the verified links; its id is its least doc_id. When the classes are known, all texts of a class
are compared with each other, in blocks, to count the links of each.

Texts, not ids, are compared: each different text has a node of its own, numbered when the table of texts is written. So rows
that share an id but not their text are judged each by its own text, and both stay unless their texts are alike.

Hot keys: a bucket or a centre that a large share of all texts meets is only ever the many side of a sort-merge join whose other
side is a written table with one row for it, so adaptive execution splits it over tasks; inside a bucket or class, pairs are made
in blocks.

Nulls, ties and odd input: a null text is empty; texts without words are copies of each other; a text of under five words is
one shingle; a very long text is read whole, in a block of its own; every row has a row in the result, repeated rows too; a null
id gets no class and no links; an empty table gives an empty result. Of rows with one id and one text, deduplicate() keeps any
one. Only doc_id and text are read; deduplicate() keeps all columns whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelark.llm.common import blocks, cut, mixed, shingle_hashes, table, word_hashes, word_lists
from quotelark.llm.graph import components

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 6
HASHES = BANDS * ROWS
STEP = 16
#: Centres that a bucket draws in each round after the first.
DRAWS = 4
#: Texts in a block, and their characters, on average at most; two blocks at most meet in a row of cells().
BLOCK, CELL_CHARS = 512, 2_000_000


def flat_shingles(hashes: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in one array and the text of each; a text of fewer words makes one shingle of them all."""
    n = np.diff(ends)
    owner = np.repeat(np.arange(len(n)), n)
    if len(hashes) >= width:
        flat = shingle_hashes(hashes, width)
        inside = owner[: len(flat)] == owner[width - 1 :]
        flat, own = flat[inside], owner[: len(flat)][inside]
    else:
        flat, own = hashes[:0], owner[:0]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        more = np.array([shingle_hashes(hashes[ends[k] : ends[k + 1]], width)[0] for k in short], np.uint64)
        flat, own = np.concatenate([flat, more]), np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        flat, own = flat[order], own[order]
    return flat, own


def min_hashes(flat: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """(n, HASHES) 16-bit MinHash values; a text without shingles has zeros."""
    out = np.zeros((n, HASHES), np.uint16)
    if len(flat):
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        factors = mixed(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
        for k, factor in enumerate(factors):
            out[own[starts], k] = mixed(np.minimum.reduceat(flat * factor, starts)) >> np.uint64(48)
    return out


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        words, ends = word_lists(block.column("text"))
        hashes = word_hashes(words, plain=True)
        keys = [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) for a, b in zip(ends, ends[1:])]
        got = min_hashes(*flat_shingles(hashes, ends, WIDTH), block.num_rows).astype(">u2")
        yield pa.RecordBatch.from_arrays(
            [block.column("doc_id"), block.column("text_hash"), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in got], pa.binary())],
            ["doc_id", "text_hash", "key", "signature"],
        )


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """(n, fewest equal values among n with which a pair goes on): P(similarity >= threshold | m of n) = P(Bin(n + 1, threshold) <= m)."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        below = 0.0
        for m in range(n + 1):
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                out.append((n, m))
                break
    return out


def prune(limits: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            side = [np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u2").reshape(-1, HASHES) for c in ("signature_x", "signature_y")]
            alive, equal, before = np.arange(batch.num_rows), np.zeros(batch.num_rows, int), 0
            for n, least in limits:
                equal = equal + (side[0][alive, before:n] == side[1][alive, before:n]).sum(1)
                go = equal >= least
                alive, equal, before = alive[go], equal[go], n
            yield batch.select(["x", "y"]).take(pa.array(alive))

    return run


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays of different hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (b for a in blocks(batches, "text_x") for b in blocks(iter([a]), "text_y")):
            texts = dict(zip(block.column("x").to_pylist() + block.column("y").to_pylist(), block.column("text_x").to_pylist() + block.column("text_y").to_pylist()))
            words, ends = word_lists(pa.array(texts.values(), pa.large_string()))
            hashes = word_hashes(words, plain=True)
            sets = {k: np.unique(shingle_hashes(hashes[a:b], WIDTH)) for k, a, b in zip(texts, ends, ends[1:])}
            score = np.array([similarity(sets[x], sets[y]) for x, y in zip(block.column("x").to_pylist(), block.column("y").to_pylist())])
            good = score >= threshold
            yield pa.RecordBatch.from_arrays([block.column("x").filter(pa.array(good)), block.column("y").filter(pa.array(good)), pa.array(score[good])], ["x", "y", "jaccard"])

    return run


def verified(left: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (x, y) that reach the threshold, with their exact similarity; texts travel for pairs that pruning left."""
    side = lambda c: texts.select(F.col("rep").alias(c), F.col("text").alias(f"text_{c}")).hint("merge")
    full = left.join(side("x"), "x").join(side("y"), "y")
    return cut(full.select("x", "y", "text_x", "text_y").mapInArrow(verify(threshold), "x long, y long, jaccard double"))


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member that links a[k]-b[k] lead each of 0..n-1 to."""
    label = np.arange(n)
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def unlike(members: list[dict], low: int, high: int, limits: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(roots, a, b): pairs of members of different classes in a cell that pruning leaves."""
    roots, block = (np.array([m[c] for m in members]) for c in ("root", "block"))
    values = np.frombuffer(b"".join(m["signature"] for m in members), ">u2").reshape(-1, HASHES)
    a, b = np.nonzero(np.triu(meeting(low, high, block) & (roots[:, None] != roots[None, :])))
    equal, before = np.zeros(len(a), int), 0
    for n, least in limits:
        equal = equal + (values[a, before:n] == values[b, before:n]).sum(1)
        go = equal >= least
        a, b, equal, before = a[go], b[go], equal[go], n
    return roots, a, b


def edges(found: list[np.ndarray]) -> pa.RecordBatch:
    out = np.concatenate([np.zeros((0, 2), np.int64), *found])
    return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])


def cell_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[dict]]]:
    for row in range(batch.num_rows):
        yield tuple(batch.column(c)[row].as_py() for c in ("low", "high", "members"))


def loose_classes(limits: list[tuple[int, int]]):
    """Links between the classes of which pruning leaves a pair in a cell, one less than it joins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for low, high, members in cell_rows(batch):
                roots, a, b = unlike(members, low, high, limits)
                names, at = np.unique(roots, return_inverse=True)
                to = names[joined(len(names), at[a], at[b])]
                found.append(np.stack([names, to], 1)[names != to])
            yield edges(found)

    return run


def compare_unlike(limits: list[tuple[int, int]], threshold: float):
    """Links between texts of different classes in a cell: what pruning leaves is compared exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for low, high, members in cell_rows(batch):
                _, a, b = unlike(members, low, high, limits)
                some, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                if not len(some):
                    continue
                a, b = at[: len(a)], at[len(a) :]
                good = likenesses([members[k]["text"] for k in some])[a, b] >= threshold
                reps = np.array([members[k]["rep"] for k in some])
                to = joined(len(some), a[good], b[good])
                found.append(np.stack([reps, reps[to]], 1)[to != np.arange(len(to))])
            yield edges(found)

    return run


def links(
    sketches: DataFrame, read: Callable[[DataFrame], DataFrame], threshold: float = THRESHOLD, tolerance: float = 0.0005
) -> tuple[DataFrame, DataFrame]:
    """(roots, texts): (node, root) for the classes of verified links, and (rep, text) of texts that share a bucket.

    sketches has (rep, signature); read gives (rep, text) for a table of (rep).

    Two rounds of centres make most classes: every bucket draws them by a hash, one in the first round and DRAWS in the second,
    and compares them with the members of other classes. Then all pairs of different classes that share a bucket are pruned in
    blocks, and the loose groups of classes that have pairs left are compared in blocks by their texts, so nothing is left to ask.
    Only the texts of documents that share a bucket are read again, in one join; their number grows with the data, so that
    join is not one to broadcast.
    """
    bands = F.array(*[F.xxhash64(F.substring("signature", 2 * ROWS * b + 1, 2 * ROWS), F.lit(b)) for b in range(BANDS)])
    rows = sketches.select(F.explode(bands).alias("bucket"), "rep", F.col("rep").alias("root"))
    side = lambda c: sketches.select(F.col("rep").alias(c), F.col("signature").alias(f"signature_{c}")).hint("merge")
    limits = least_matches(threshold, tolerance)
    asked = roots = texts = None
    for draws in (range(1), range(1, 1 + DRAWS)):
        order = lambda k: F.min(F.struct(F.xxhash64("rep", "bucket", F.lit(k)).alias("order"), F.col("rep").alias("centre"), F.col("root").alias("centre_root")))
        centres = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.array(*map(order, draws)).alias("centres")).where("low < high")
        rows = cut(rows.join(cut(centres.select("bucket", "centres")).hint("merge"), "bucket"))
        others = F.transform(F.filter("centres", lambda c: c["centre_root"] != F.col("root")), lambda c: c["centre"])
        # a text meets at most DRAWS centres in each of its buckets; those that recur are taken once, before rows are made of them
        asks = rows.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list(others))).alias("to")).select("rep", F.explode("to").alias("centre"))
        pairs = asks.select(F.greatest("rep", "centre").alias("x"), F.least("rep", "centre").alias("y")).distinct()
        pairs = cut(pairs if asked is None else pairs.join(asked, ["x", "y"], "left_anti"))
        if texts is None:
            texts = cut(read(rows.select("rep").distinct()))
        left = cut(pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "signature_x", "signature_y").mapInArrow(prune(limits), "x long, y long"))
        new = verified(left, texts, threshold)
        if roots is None:
            asked, roots = pairs, components(new.select(F.col("x").alias("a"), F.col("y").alias("b")))
        else:
            roots = merged(roots, new)
        rows = rows.select("bucket", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root"))
    several = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    members = rows.join(cut(several).hint("merge"), "bucket").join(sketches.hint("merge"), "rep").select("bucket", "rep", "root", "signature")
    near = cut(cells(cut(members), "bucket", ["rep", "root", "signature"]).mapInArrow(loose_classes(limits), "a long, b long").distinct())
    loose = components(near).select(F.col("node").alias("class"), F.col("root").alias("loose"))
    known = texts.join(roots, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("root", "rep").alias("root"), "text")
    met = cut(known.join(loose, F.col("root") == F.col("class")).join(sketches.hint("merge"), "rep").select("loose", "rep", "root", "signature", "text"))
    last = cut(cells(met, "loose", ["rep", "root", "signature", "text"]).mapInArrow(compare_unlike(limits, threshold), "a long, b long"))
    return merged(roots, last.select(F.col("a").alias("x"), F.col("b").alias("y"))), texts


def merged(roots: DataFrame, new: DataFrame) -> DataFrame:
    """roots after new links; components are sought among the old classes only."""
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    a, b = F.coalesce("root_x", "x").alias("a"), F.coalesce("root_y", "y").alias("b")
    moves = components(cut(new.select("x", "y").join(root("x"), "x", "left").join(root("y"), "y", "left").select(a, b).where("a <> b"))).select(F.col("node").alias("old"), F.col("root").alias("to"))
    moved = roots.join(moves, F.col("root") == F.col("old"), "left").select("node", F.coalesce("to", "root").alias("root"))
    fresh = moves.join(moved, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("to").alias("root"))
    return cut(moved.union(fresh))


def cells(members: DataFrame, group: str, carried: list[str]) -> DataFrame:
    """Rows (members: array of (block, *carried), low, high) so that any two members of a group meet in one row.

    A group is dealt over blocks of about BLOCK members and CELL_CHARS characters by a hash of rep; each row has the members of
    two blocks, or of one.
    """
    size = F.sum(F.length("text")) if "text" in carried else F.lit(0)
    n_blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(size / CELL_CHARS), F.lit(1)).cast("int")
    blocks_ = cut(members.groupBy(group).agg(n_blocks.alias("n_blocks")).withColumnRenamed(group, "group"))
    dealt = members.join(blocks_.hint("merge"), members[group] == blocks_["group"]).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("n_blocks")).cast("int"))
    met = dealt.select("group", "block", *carried, F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other"))
    met = met.select("group", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.struct("block", *carried).alias("member"))
    return met.groupBy("group", "low", "high").agg(F.collect_list("member").alias("members")).select("low", "high", "members")


def meeting(low: int, high: int, block: np.ndarray) -> np.ndarray:
    """Which members of a cell are compared in it: those of different blocks, or all where it has one block."""
    return block[:, None] != block[None, :] if low != high else ~np.eye(len(block), dtype=bool)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets share, as products of a 0/1 matrix taken in slices of its columns."""
    flat, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, own = (np.cumsum(times > 1) - 1)[column[shared]], own[shared]
    order = np.argsort(column, kind="stable")
    column, own = column[order], own[order]
    out = np.zeros((len(sets), len(sets)))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        a, b = np.searchsorted(column, (first, first + 8192))
        matrix = np.zeros((len(sets), 8192), np.float32)
        matrix[own[a:b], column[a:b] - first] = 1
        out += matrix @ matrix.T
    return out


def likenesses(texts: list[str]) -> np.ndarray:
    """The Jaccard similarity of the shingle sets of each two texts."""
    words, ends = word_lists(pa.array(texts, pa.large_string()))
    hashes = word_hashes(words, plain=True)
    sets = [np.unique(shingle_hashes(hashes[a:b], WIDTH)) for a, b in zip(ends, ends[1:])]
    both, size = overlaps(sets), np.array([len(s) for s in sets])
    return both / np.maximum(1, size[:, None] + size - both)


def count_links(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, members in cell_rows(batch):
                good = likenesses([m["text"] for m in members]) >= threshold
                n = (good & meeting(low, high, np.array([m["block"] for m in members]))).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array([m["rep"] for m in members], pa.int64()), pa.array(n.astype(np.int64))], ["node", "n"])

    return run


def degrees(roots: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(node, links): the texts at the threshold or more for each text of a class. All pairs of a class are compared, exactly."""
    members = texts.join(roots, F.col("rep") == F.col("node")).select("rep", "root", "text")
    counted = cells(members, "root", ["rep", "text"]).mapInArrow(count_links(threshold), "node long, n long")
    return counted.groupBy("node").agg(F.sum("n").alias("links"))


def class_ids(docs: DataFrame, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sketched rows, different texts with `first`: their least (doc_id, text_hash), roots of the texts, texts that met others)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    made = cut(docs.mapInArrow(sketch, "doc_id long, text_hash long, key binary, signature binary"))
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    groups = made.where("doc_id is not null").groupBy("key").agg(first, F.min("signature").alias("signature"), F.count(F.lit(1)).alias("copies"))
    groups = cut(groups.withColumn("rep", F.monotonically_increasing_id()))  # numbered once, where they are written

    def read(reps: DataFrame) -> DataFrame:
        wanted = groups.join(reps, "rep").select("rep", F.col("first.doc_id").alias("at"), F.col("first.text_hash").alias("hash")).hint("merge")
        found = docs.join(wanted, (docs["doc_id"] == wanted["at"]) & (docs["text_hash"] == wanted["hash"]))
        return found.groupBy("rep").agg(F.min("text").alias("text"))

    roots, texts = links(groups.select("rep", "signature"), read, threshold, tolerance)
    return made, groups, roots, texts


def kept_rows(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, kept): for each class its least (doc_id, text_hash)."""
    known = groups.select("rep", "first").join(roots, F.col("rep") == F.col("node"), "left")
    return known.groupBy(F.coalesce("root", "rep").alias("root")).agg(F.min("first").alias("kept"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = 0.0005) -> DataFrame:
    """(doc_id, class_id, n_links), a row for each row of docs. n_links: other texts of the class at the threshold or more from the document's collapsed text, and its other copies."""
    made, groups, roots, texts = class_ids(docs, threshold, tolerance)
    degree = degrees(roots, texts, threshold).withColumnRenamed("node", "linked")
    named = kept_rows(groups, roots).select(F.col("root").alias("class"), F.col("kept.doc_id").alias("class_id"))
    known = groups.select("key", "rep", "copies").join(roots, F.col("rep") == F.col("node"), "left").join(degree, F.col("rep") == F.col("linked"), "left")
    known = known.join(named, F.coalesce("root", "rep") == F.col("class")).select("key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = made.where("doc_id is not null").select("doc_id", "key").join(cut(known).hint("merge"), "key").select("doc_id", "class_id", "n_links")
    return rows.unionByName(made.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of docs for each class, the one whose id names it; all columns stay, and so do rows with a null id."""
    _, groups, roots, _ = class_ids(docs, threshold, 0.0005)
    kept = kept_rows(groups, roots).select(F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_hash").alias("kept_hash")).hint("merge")
    rows = docs.select(F.col("doc_id").cast("long").alias("at"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.struct("*").alias("row"))
    some = rows.join(kept, (F.col("at") == F.col("kept_id")) & (F.col("hash") == F.col("kept_hash"))).dropDuplicates(["at", "hash"])
    return some.select("row.*").unionByName(docs.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
