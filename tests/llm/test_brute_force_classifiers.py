"""Language cosines and toxicity scores from first principles, one text and one window at a time."""

import math
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from quotelark.llm import op1_language_id as op1
from quotelark.llm import op3_toxicity as op3
from quotelark.llm.common import held

SF = "/root/testdata/sf0.001"


def bundle(text, letters):
    """The sum of a text's trigram vectors, trigram by trigram."""
    spaced = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in spaced:
        spaced = spaced.replace("  ", " ")
    total = np.zeros(op1.DIMS)
    for a, b, c in zip(spaced, spaced[1:], spaced[2:]):
        total += np.roll(letters.letter(ord(a)), 2) * np.roll(letters.letter(ord(b)), 1) * letters.letter(ord(c))
    return total


def test_op1_cosines_from_letter_vectors(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("length(text) < 1500").orderBy("doc_id").limit(70).collect()]
    docs += [(10_001, "Straße Ü 12 x", "de"), (10_002, "12 34", "en"), (10_003, None, "en"), (10_004, "ça   va?", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3).withColumn("held_out", held("doc_id", 4, 2))
    got = {r.doc_id: r for r in op1.identify(df, op1.prototypes(df.where(~F.col("held_out")))).collect()}
    letters, sums = op1.Profiles(op1.DIMS, 1), {}
    for doc_id, text, lang in docs:
        if lang is not None and text is not None and not got[doc_id].held_out:
            sums[lang] = sums.get(lang, 0) + bundle(text, letters)
    for doc_id, text, _ in docs:
        mine = bundle(text or "", letters)
        cosine = {k: float(mine @ v) / max(1e-9, np.linalg.norm(mine)) / np.linalg.norm(v) for k, v in sorted(sums.items())}
        best = max(cosine, key=cosine.get)
        row = got[doc_id]
        if not any(map(str.isalpha, text or "")):
            assert (row.lang_pred, row.score) == ("und", 0.0)
        else:
            assert row.score == pytest.approx(min(1, max(0, cosine[best])), abs=1e-5)
            assert row.lang_pred == best or cosine[row.lang_pred] == pytest.approx(cosine[best], abs=1e-6)


def length(window, content):
    """A window's compressed length with a dictionary of raw content."""
    settings = zstandard.ZstdCompressionParameters.from_level(3, strategy=zstandard.STRATEGY_DFAST, min_match=op3.MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
    made = zstandard.ZstdCompressionDict(content.ljust(16, b"0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    made.precompute_compress(compression_params=settings)
    return len(zstandard.ZstdCompressor(dict_data=made, compression_params=settings).compress(window))


def test_op3_scores_from_lengths(spark):
    calm = [f"calm text number{k} with plain words item{k % 7} good day {'xyzuvw'[k % 6]}" for k in range(60)]
    foul = [f"calm text number{k} some {'xyzuvw'[k % 6]}a vileword {'mnopqrs'[k % 7]}b vileword end" for k in range(60)]
    odd = [None, "", "ÄÖ vileword " * 60, "vileword", "12 34 ??", "plain " * 400]
    rows = list(enumerate([x for pair in zip(calm, foul) for x in pair] + odd))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False))
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(120)], "doc_id long, quality int, toxic int")
    model = op3.fit(docs, labels)
    got = {r.doc_id: (r.score, r.predicted) for r in op3.toxicity(docs, model).collect()}
    assert b"vileword" in model.toxic and b"vileword" not in model.ordinary
    for doc_id, text in rows:
        data = (" " + " ".join(re.findall(r"[^\W\d_]+", (text or "").lower())) + " ").encode()
        gains, gaps = [], []
        for at in range(0, len(data), 256):
            window = data[max(0, at - 16) : at + 256]
            toxic, ordinary, neutral = (length(window, c) for c in (model.toxic, model.ordinary, b"0123456789" * 2))
            gains.append(neutral - toxic)
            gaps.append(ordinary - toxic)
        n = len(gains)
        x = [max(gains), sum(gains) / n, max(gaps), sum(gaps) / n, math.sqrt(max(sum(gains), 0)) / n, sum(g >= 3 for g in gains) / n, math.log(n), 1.0]
        score = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(x, model.weights))))))
        assert got[doc_id] == (pytest.approx(score), int(score >= 0.5))
