"""Language-model scoring with Brown class-based n-grams.

Tokens are lower-cased (A-Z) words and one end for each text. Classes are made in two steps. Exchange clustering puts each of the
`core` most frequent words, and each ending of two letters (which stands for all other words that have it), in the class that gains
most likelihood of the class bigrams. Then a Spark job counts the classes before and after every other frequent word, and puts
each word, side by side over partitions, in the class under which its neighbours are likeliest, the classes of the others held
fixed (predictive exchange). Words past the FREQUENT most frequent, and unseen ones, keep the class of their ending. Class bigrams
are counted again for the classes so made. A token's probability is

    P(class | class before) x P(item | class) x P(word | item),

where a frequent word is its own item and another word's item is its ending; each is smoothed by a constant, and the score is the
sum of their log10, from one end to the next. Counts come from all training texts. Frequent words are looked up in a broadcast
table of bounded size; the others (none of which is hot) meet their counts in one join, as (word, text, times).

Nulls, ties and odd input: a null text is empty and has one token, its end; equal counts go by word; repeated rows are scored
each; a very long text is read whole, in a block of its own; a word of over LONGEST characters is known by its digest and its last
two letters; without training texts all counts are 0; an empty table gives an empty result. Only doc_id, held_out and text are
read, so other names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelark.llm.common import blocks, cut, held, table, word_lists

#: Words in the broadcast table, and characters of each, at most.
FREQUENT, LONGEST = 65536, 64
#: Words that exchange clustering moves one by one, and endings; their bigram counts, a table of fixed size, go through the driver.
TOP, SHAPES = 1024, 511
CLASSES, SWEEPS = 64, 6
ALPHA, BETA = 0.1, 0.5


@dataclass(frozen=True)
class Vocabulary:
    """Frequent words by falling count and their counts; endings, and the tokens and types of the other words of each.

    Items are numbered: frequent words, endings, any other ending, the end of a text. Core items number `core` words only.
    """

    words: list[str]
    counts: np.ndarray
    shapes: list[str]
    shape_tokens: np.ndarray
    shape_types: np.ndarray
    tokens: int
    types: int
    texts: int

    @property
    def core(self) -> int:
        return min(TOP, len(self.words))

    @property
    def rest(self) -> int:
        """Items that are no words."""
        return len(self.shapes) + 2

    def places(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each word's place among the frequent words, or -1, and that of its ending (len(shapes): any other)."""
        at = [pc.fill_null(pc.index_in(w, value_set=pa.array(v, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64) for w, v in ((words, self.words), (pc.utf8_slice_codeunits(words, -2), self.shapes))]
        return at[0], np.where(at[1] < 0, len(self.shapes), at[1])


def known_words(flat: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(different words, the place of each of flat among them); longer words than LONGEST by their digests and last two letters."""
    coded = flat.dictionary_encode()
    words = coded.dictionary.cast(pa.string())
    long = np.flatnonzero(pc.greater(pc.utf8_length(words), LONGEST).to_numpy(zero_copy_only=False))
    if len(long):
        names = words.to_pylist()
        for k in long:
            names[k] = f"{xxhash.xxh3_128_hexdigest(names[k])} {names[k][-2:]}"
        words = pa.array(names, pa.string())
    return words, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        words, codes = known_words(word_lists(block.column("text"))[0])
        yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(codes, minlength=len(words)))], ["word", "c"])


def count_words(training: DataFrame) -> DataFrame:
    """(word, c) over all training texts."""
    return cut(training.select("text").mapInArrow(tally, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")))


def frequent_words(counts: DataFrame) -> tuple[list, Column]:
    """At most FREQUENT words, most frequent first, and the condition that they meet.

    Counts are grouped by size class first (sixteen for each doubling), so that no task sends more than is kept. Of the class that
    doesn't fit, the words go by a hash.
    """
    level, part = F.floor(F.log2("c") * 16), F.pmod(F.xxhash64("word"), F.lit(4096))
    least, total, over = None, 0, None
    for row in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level")).collect():
        if total + row["n"] > FREQUENT:
            over = row["level"]
            break
        least, total = row["level"], total + row["n"]
    kept = level >= least if least is not None else F.lit(False)
    if over is not None:
        limit = -1
        for row in counts.where(level == over).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
            total += row["n"]
            if total > FREQUENT:
                break
            limit = row["part"]
        kept = kept | ((level == over) & (part <= limit))
    return sorted(counts.where(kept).select("word", "c").collect(), key=lambda r: (-r["c"], r["word"].encode())), kept


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """Bounded tables for the driver: FREQUENT words and SHAPES word endings."""
    tokens, types = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    top, kept = frequent_words(counts)
    words = [r["word"] for r in top]
    outside = ~F.coalesce(F.col("word").isin(words[:TOP]), F.lit(False)) if words else F.lit(True)
    sums = F.sum("c").alias("n"), F.sum(F.when(~kept, F.col("c")).otherwise(0)).alias("rare"), F.count(F.when(~kept, 1)).alias("types")
    by_shape = cut(counts.where(outside).groupBy(F.substring("word", -2, 2).alias("shape")).agg(*sums))
    rows = by_shape.orderBy(F.desc("n"), "shape").limit(SHAPES).collect()
    all_n, all_v = by_shape.agg(F.sum("rare"), F.sum("types")).first()
    n, v = (np.array([r[c] for r in rows], float) for c in ("rare", "types"))
    n, v = np.r_[n, (all_n or 0) - n.sum()], np.r_[v, (all_v or 0) - v.sum()]
    return Vocabulary(words, np.array([r["c"] for r in top], float), [r["shape"] for r in rows], n, v, (tokens or 0) + texts, (types or 0) + (texts > 0), texts)


def encoded(block: pa.RecordBatch, vocab: Vocabulary, own: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(different words, their places, their items, word of each token, ends of each text); `own` words are items of their own."""
    flat, ends = word_lists(block.column("text"))
    words, codes = known_words(flat)
    place, shape = vocab.places(words)
    return words, place, np.where((place >= 0) & (place < own), place, own + shape), codes, ends


def with_ends(token_items: np.ndarray, ends: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items with `end` after each text, where the words went, where the ends went)."""
    texts = len(ends) - 1
    owner = np.repeat(np.arange(texts), np.diff(ends))
    at, last = np.arange(len(token_items)) + owner, ends[1:] + np.arange(texts)
    out = np.empty(len(token_items) + texts, np.int64)
    out[at], out[last] = token_items, end
    return out, at, last


def bigrams(vocab: Vocabulary, own: int, member: np.ndarray | None = None):
    """Counts of pairs of items, or of their classes."""
    n = own + vocab.rest if member is None else CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for block in blocks(batches):
            _, _, items, codes, ends = encoded(block, vocab, own)
            now = with_ends(items[codes], ends, own + vocab.rest - 1)[0]
            before = np.r_[own + vocab.rest - 1, now[:-1]]
            if member is not None:
                now, before = member[now], member[before]
            total += np.bincount(before * n + now, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    return run


def bigram_counts(training: DataFrame, vocab: Vocabulary, own: int, member: np.ndarray | None = None) -> np.ndarray:
    """Square counts of core items, or of classes; their number is fixed, whatever the corpus."""
    n = own + vocab.rest if member is None else CLASSES
    rows = training.select("text").mapInArrow(bigrams(vocab, own, member), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n * n)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(n, n)


def neighbours(vocab: Vocabulary, member: np.ndarray):
    """(word, side, n): how often each class stands before (side = class) and after (side = CLASSES + class) each word past the core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, end = vocab.core, member[-1]
        total = np.zeros(max(len(vocab.words) - core, 0) * 2 * CLASSES, np.int32)
        for block in blocks(batches):
            _, place, items, codes, ends = encoded(block, vocab, core)
            classes, at, _ = with_ends(member[items[codes]], ends, end)
            mine = np.flatnonzero(place[codes] >= core)
            word, at = place[codes[mine]] - core, at[mine]
            sides = np.r_[np.r_[end, classes][at], CLASSES + classes[at + 1]]
            key, n = np.unique(np.r_[word, word] * 2 * CLASSES + sides, return_counts=True)
            total[key] += n.astype(np.int32)
        some = np.flatnonzero(total)
        cols = [core + some // (2 * CLASSES), some % (2 * CLASSES), total[some].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["word", "side", "n"])

    return run


def likeliest_class(b: np.ndarray):
    """The class under which a word's neighbours are likeliest, given the class bigram counts b; the end's class takes no word."""
    after = np.log((b + ALPHA) / (b.sum(1, keepdims=True) + ALPHA * CLASSES))
    before = np.log((b + ALPHA) / (b.sum(0, keepdims=True) + ALPHA * CLASSES))
    gain = np.concatenate([before, after.T])  # (side, class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, best = batch.column("word"), []
            for sides in batch.column("sides").to_pylist():
                value = sum(s["n"] * gain[s["side"]] for s in sides)
                best.append(int(value[: CLASSES - 1].argmax()))
            yield pa.RecordBatch.from_arrays([words, pa.array(best, pa.int64())], ["word", "class"])

    return run


def all_members(training: DataFrame, vocab: Vocabulary, member: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The class of every item, from those of the core items: the other frequent words are put in theirs over partitions of words."""
    core = vocab.core
    counted = training.select("text").mapInArrow(neighbours(vocab, member), "word long, side long, n long").groupBy("word", "side").agg(F.sum("n").alias("n"))
    rows = counted.groupBy("word").agg(F.collect_list(F.struct("side", "n")).alias("sides")).mapInArrow(likeliest_class(b), "word long, class long").toArrow()
    out = np.r_[member[:core], np.zeros(len(vocab.words) - core, np.int64), member[core:]]
    out[rows.column("word").to_numpy()] = rows.column("class").to_numpy()
    return out


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(b: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each item: items go, one at a time and most frequent first, where the class bigram likelihood is largest."""
    order = np.argsort(-b.sum(0), kind="stable")
    member = np.zeros(len(b), np.int64)
    member[order] = np.arange(len(b)) % (classes - 1)
    end = len(b) - 1
    member[end] = classes - 1  # the end is a class of its own
    hot = np.eye(classes)[member]
    n = hot.T @ b @ hot
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if w == end or not b[w].any() and not b[:, w].any():
                continue
            own, self_ = member[w], b[w, w]
            right, left = b[w] @ hot, b[:, w] @ hot
            right[own] -= self_
            left[own] -= self_
            n[own] -= right
            n[:, own] -= left
            n[own, own] -= self_
            r, l = right.sum() + self_, left.sum() + self_
            rows, cols = n.sum(1), n.sum(0)
            here = np.arange(classes)
            gain = (xlogx(n + right) - xlogx(n)).sum(1) + (xlogx(n + left[:, None]) - xlogx(n)).sum(0)
            diagonal = n[here, here]
            gain += xlogx(diagonal + right + left + self_) + xlogx(diagonal) - xlogx(diagonal + right) - xlogx(diagonal + left)
            gain -= xlogx(rows + r) - xlogx(rows) + xlogx(cols + l) - xlogx(cols)
            gain[classes - 1] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= gain[own] + 1e-9:
                best = own
            moved += best != own
            hot[w, own], hot[w, best], member[w] = 0, 1, best
            n[best] += right
            n[:, best] += left
            n[best, best] += self_
        if not moved:
            break
    return member


@dataclass(frozen=True)
class Model:
    vocab: Vocabulary
    member: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def fit(training: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the counts of all training words."""
    counts = count_words(training)
    vocab = vocabulary(counts, training.count())
    b = bigram_counts(training, vocab, vocab.core)
    core = exchange(b)
    hot = np.eye(CLASSES)[core]
    member = all_members(training, vocab, core, hot.T @ b @ hot)
    n = bigram_counts(training, vocab, len(vocab.words), member)
    step = np.log10((n + ALPHA) / (n.sum(1, keepdims=True) + ALPHA * CLASSES))
    seen = np.r_[vocab.counts, vocab.shape_tokens, vocab.texts]
    in_class = np.bincount(member, seen, CLASSES) + BETA * np.bincount(member, minlength=CLASSES)
    return Model(vocab, member, step, np.log10((seen + BETA) / in_class[member])), counts


RARE = "uid long, word string, times long, stats struct<doc_id:long,held_out:boolean,n_tokens:long,n_known:long,base:double,score:double>"


def score(model: Model):
    vocab = model.vocab
    stats_type = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = len(vocab.words), len(model.member) - 1
        whole = np.log10(vocab.tokens + 0.5 * (vocab.types + 1))
        within = np.r_[np.zeros(own), -np.log10(vocab.shape_tokens + 0.5 * (vocab.shape_types + 1)), 0.0]
        known_log = np.log10(vocab.counts + 0.5)
        for block in blocks(batches):
            words, place, items, codes, ends = encoded(block, vocab, own)
            rare = place < 0
            log = np.zeros(len(words))
            log[~rare] = known_log[place[~rare]]
            now, at, last = with_ends(items[codes], ends, end)
            classes = model.member[now]
            value = model.step[model.member[np.r_[end, now[:-1]]], classes] + model.emit[now]
            value[at] += within[items][codes]
            base = np.full(len(now), np.log10(vocab.texts + 0.5) - whole)
            base[at] = log[codes] - whole
            known = np.full(len(now), int(vocab.texts > 0))
            known[at] = ~rare[codes]
            starts = np.r_[0, last[:-1] + 1]
            sums = [np.add.reduceat(x, starts) for x in (known, base, value)]
            stats = pa.StructArray.from_arrays([block.column("doc_id"), block.column("held_out"), pa.array(last - starts + 1), *map(pa.array, sums)], fields=list(stats_type))
            uid = block.column("uid")
            # a text's own row has a key that no word can have, so these rows are dealt evenly
            yield pa.RecordBatch.from_arrays([uid, pc.binary_join_element_wise(" ", uid.cast(pa.string()), ""), pa.array(np.zeros(len(starts), np.int64)), stats], ["uid", "word", "times", "stats"])
            mine = np.flatnonzero(rare[codes])
            if len(mine):
                owner = np.repeat(np.arange(len(starts)), np.diff(ends))[mine]
                pair, times = np.unique(owner * len(words) + codes[mine], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [uid.take(pa.array(pair // len(words))), words.take(pa.array(pair % len(words))), pa.array(times), pa.nulls(len(pair), stats_type)],
                    ["uid", "word", "times", "stats"],
                )

    return run


def scored(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """docs (doc_id, held_out, text) with n_tokens, n_known, train_tokens, base_score and score (log10)."""
    docs = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    parts = docs.mapInArrow(score(model), RARE)
    joined = parts.join(counts.withColumnRenamed("word", "known"), F.col("word") == F.col("known"), "left")
    log = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    known = F.when(F.col("c") > 0, F.col("times")).otherwise(0)
    sums = joined.groupBy("uid").agg(F.max("stats").alias("s"), F.sum(F.when(F.col("times") > 0, log).otherwise(0.0)).alias("log"), F.sum(known).alias("known"))
    return sums.select(
        "s.doc_id", "s.held_out", "s.n_tokens", (F.col("s.n_known") + F.col("known")).alias("n_known"), F.lit(model.vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("s.base") + F.col("log")).alias("base_score"), (F.col("s.score") + F.col("log")).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held("doc_id", 5, 1))
    return scored(docs, *fit(docs.where(~F.col("held_out"))))


