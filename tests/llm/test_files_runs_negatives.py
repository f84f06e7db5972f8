"""Token files, periodic runs and hard negatives against plain Python, and their odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quotelark.llm import op11_token_files as op11
from quotelark.llm import op12_periodic_runs as op12
from quotelark.llm import op13_hard_negatives as op13
from quotelark.scratch import new_path

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, anchor string, slot string, id string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(op11.TOKENIZER))


@pytest.fixture(scope="module")
def encoder():
    return op11.Encoder(public_tokenizers.path(op11.TOKENIZER))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab'sR1, .\n\t\r\xa0\u3000\x1c\x85é日<|>", " ", "  ", "<|endoftext|>", " 're", "\n "]), max_size=30).map("".join), max_size=5))
def test_op11_pieces_encode_as_whole_texts_do(tokenizer, encoder, texts):
    ids, sizes = encoder.encode(texts)
    assert [ids[e - n : e].tolist() for n, e in zip(sizes, np.cumsum(sizes))] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**40) | st.integers(0, 5), max_size=1500), st.data())
def test_op11_elias_fano_selects_any_stretch(numbers, data):
    numbers = np.cumsum(np.array(sorted(numbers), np.uint64) // np.uint64(max(1, len(numbers))), dtype=np.uint64)
    coded = op11.EliasFano.encode(numbers)
    lists = op11.EliasFano(lambda at, size: coded[at : at + size], 0)
    first = data.draw(st.integers(0, len(numbers)))
    count = data.draw(st.integers(0, 700))
    assert lists.select(first, count).tolist() == numbers[first : first + count].tolist()
    if len(numbers):
        assert 8 * len(coded) <= 8 * 64 + len(numbers) * (3.2 + max(0, int(numbers[-1]) // len(numbers)).bit_length())


def test_op11_shards_hold_all_documents_in_order(spark, odd, none, tokenizer):
    folder = new_path(spark)
    op11.write(odd, folder, shard_ids=300)
    got = op11.read(spark, folder).orderBy("start").collect()
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [r.doc_id for r in rows] and got[0].start == 0
    texts = {}
    for r in rows:
        texts.setdefault(r.doc_id, []).append(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0])
    for r, after in zip(got, [*got[1:], None]):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids in texts[r.doc_id] and (after is None or after.start == r.start + len(ids))
    listed = op11.shards(spark, folder).orderBy("start").collect()
    assert len(listed) > 2
    shard = op11.Shard(listed[0].uri)
    known = shard.doc_ids(0, shard.documents)
    place = shard.find(known[-1])
    assert known[place] == known[-1] and shard.find(10**12) is None and shard.document(place).tolist() in texts[known[-1]]
    empty = new_path(spark)
    op11.write(none, empty)
    assert op11.read(spark, empty).count() == 0


def test_op11_query_equals_the_library(spark, tokenizer):
    at = 0
    got = {r.doc_id: r for r in op11.query(spark, SF).collect()}
    for doc_id, text in sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert tuple(got[doc_id])[1:] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def plain_runs(w, shortest=24, power=3):
    seen = {}
    for p in range(1, len(w) // power + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(shortest, power * p):
                seen.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, p, n) for (s, n), p in seen.items())


def repetitive(rng):
    k, out = rng.choice([1, 2, 2, 3, 5, 50]), []
    for _ in range(rng.randint(0, 8)):
        kind, base = rng.random(), [f"w{rng.randrange(k)}" for _ in range(rng.randint(1, rng.choice([3, 10, 60, 150])))]
        if kind < 0.5:
            out += (base * rng.randint(1, 9))[: rng.randint(1, 600)]
        elif kind < 0.7:
            out += [f"w{i.bit_count() % 2}" for i in range(rng.randint(1, 200))]
        elif kind < 0.85:
            a, b = ["w0"], ["w0", "w1"]
            for _ in range(rng.randint(1, 9)):
                a, b = b, b + a
            out += b
        else:
            out += base + (["w0"] * rng.randint(1, 70) + ["w1"]) * rng.randint(1, 6)
    return out[:1200]


@pytest.mark.parametrize("seed", range(6))
def test_op12_all_runs_of_repetitive_texts(seed):
    rng, many = random.Random(seed), 0
    for _ in range(6):
        docs = [*(" ".join(repetitive(rng)) for _ in range(rng.randint(1, 10))), "", None]
        runs, collapsed = op12.runs_of_texts(pa.array(docs), 24, 3)
        for text, found, left in zip(docs, runs.to_pylist(), collapsed.to_pylist()):
            w = (text or "").split()
            want = plain_runs(w)
            many += len(want)
            assert [(r["start"], r["period"], r["length"]) for r in found] == want
            drop = {i for s, p, n in want for i in range(s + p, s + n)}
            assert left == " ".join(x for i, x in enumerate(w) if i not in drop)
    assert many > 50


def test_op12_query_equals_plain_python(spark):
    got = {r.doc_id: r for r in op12.query(spark, SF).collect()}
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        if n > 2500:
            continue
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want, best = plain_runs(w), (None, None, None)
        for s, p, size in want:
            if best[0] is None or size * best[2] > best[1] * p:
                best = (s, size, p)
        drop = {i for s, p, size in want for i in range(s + p, s + size)}
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        lines = "".join(f"{s},{size},{p}\n" for s, p, size in want)
        assert tuple(got[doc_id])[1:] == (len(want), *best, best[0] is not None and 1000 * best[1] // best[2] or None, digest(lines), digest(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_op12_odd_rows(spark, odd, none):
    got = op12.detect(odd.withColumn("runs", F.lit("mine")).withColumn("a.b", F.lit(1)))
    assert set(got.columns) == {*odd.columns, "a.b", "runs", "collapsed"}
    rows = got.collect()
    assert len(rows) == odd.count() and {len(r.runs) for r in rows if not (r.text or "").strip()} == {0}
    (long,) = (r for r in rows if (r.text or "").startswith("long"))
    assert [tuple(x) for x in long.runs] == [(0, 60_000, 1)] and long.collapsed == "long"
    assert op12.detect(none).count() == 0
    with pytest.raises(ValueError):
        op12.detect(odd, power=2)


def plain_negatives(rows, every=100, k=5):
    usable = {}
    for vec_id, vector, label in rows:
        if None not in (vec_id, vector, label) and all(x is not None and np.isfinite(x) for x in vector):
            row = (label, [int(np.floor(256 * float(x))) for x in vector])
            usable[vec_id] = min(usable.get(vec_id, row), row)
    wide = max((len(v) for _, v in usable.values()), default=0)
    full = {i: (label, np.array(v + [0] * (wide - len(v)), object)) for i, (label, v) in usable.items()}
    out = []
    for a, (label, v) in full.items():
        if a % every:
            continue
        scores = sorted((-int(v @ w), i, other) for i, (other, w) in full.items() if i != a)
        for s, i, other in [x for x in scores if x[2] == label][:k]:
            below = [x for x in scores if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(a, i, rank + 1, n, -s, -t) for rank, (t, n, _) in enumerate(below)]
    return sorted(out)


def many_vectors(seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, 6)) * 2
    rows = [(i, (centres[i % 4] + rng.normal(size=6) * 0.4).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(700)]
    rows += [(1000 + i, rows[5][1], i % 2) for i in range(300)]  # one vector very often, ties everywhere
    rows += [rows[3], (3, rows[4][1], 2), (None, rows[0][1], 1), (2000, None, 1), (2001, rows[0][1], None), (2100, [1.0, None], 1), (2200, [float("nan")] * 6, 1), (2300, [float("inf")] * 6, 0)]
    return rows + [(2400, [0.5, 1.0], 1), (2500, [], 0), (2600, [0.0] * 6, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_op13_equals_plain_python(spark, seed):
    rows = many_vectors(seed)
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS).repartition(3)
    got = sorted(map(tuple, op13.mine(table, every=20).collect()))
    assert got == plain_negatives(rows, every=20) and len(got) > 500


def test_op13_wide_numbers_and_empty_tables(spark):
    rows = [(i, [float(x) * 2**19 for x in v], label) for i, v, label in many_vectors(3)[:200]]
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS)
    assert sorted(map(tuple, op13.mine(table, every=20).collect())) == plain_negatives(rows, every=20)
    assert op13.mine(spark.createDataFrame([], VECTORS)).count() == 0
    with pytest.raises(ValueError):
        op13.mine(spark.createDataFrame([(0, [1e12], 1, "x", "y", "z")], VECTORS))


def test_op13_curve_visits_each_cell_once_by_single_steps():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = op13.hilbert(cells, 3)
    assert sorted(keys) == list(range(512))
    assert set(np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)) == {1}


def test_op13_bounds_hold_and_spare_blocks(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 5)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=5) * 0.05).tolist(), i % 2) for i in range(6000)]
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS)
    index = op13.Index(op13.usable(table, "vec_id", "label", "embedding", 256), 100, 5)
    anchors = np.array([r.vector for r in index.anchors.collect()])
    spared = total = 0
    for uri in index.files:
        blocks = op13.Blocks(uri, index.shape.exact)
        least, most = blocks.bounds(anchors)
        for b in range(least.shape[1]):
            scores = anchors @ blocks.block(b)[2].astype(np.int64).T
            assert (scores.min(axis=1) >= least[:, b]).all() and (scores.max(axis=1) <= most[:, b]).all()
            own = np.array([r.floor for r in index.anchors.collect()])
            spared, total = spared + (most[:, b] < own).sum(), total + len(own)
    assert spared > 0.5 * total
