"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotelark.llm import op1_language_id as op1
from quotelark.llm import op2_substring_dedup as op2
from quotelark.llm import op3_toxicity as op3
from quotelark.llm import op4_brown_lm as op4
from quotelark.llm import op5_quality as op5
from quotelark.llm import op6_jaccard as op6
from quotelark.llm import op7_fingerprints as op7
from quotelark.llm import op8_chat as op8
from quotelark.llm import op9_decontamination as op9
from quotelark.llm import op10_mixing as op10
from quotelark.llm.common import held

PROSE, OTHER = (" ".join(f"{w}{k} and {w}{k % 17} or{k % 29}" for k in range(60)) for w in ("word", "item"))


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def fold(df):
    return df.withColumn("held_out", held("doc_id", 5, 0))


def test_op1(odd, none):
    got = op1.identify(fold(odd), op1.prototypes(odd)).collect()
    assert len(got) == 16 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert {by[k].lang_pred for k in (0, 1, 2, 4)} == {"und"} and by[5].lang_pred == "en"
    assert {r.lang_pred for r in op1.identify(fold(odd), op1.prototypes(none)).collect()} == {"und"}
    assert op1.identify(fold(none), op1.prototypes(odd)).count() == 0


def test_op2(odd, none):
    got = op2.spans(odd).collect()
    repeats = {(r.doc_id, r.source_id) for r in got if not r.kept}
    assert {(6, 5), (7, 5), (9, 5), (9, 8)} <= repeats and {r.doc_id for r in got} == {5, 6, 7, 8, 9}
    assert op2.spans(none).count() == 0
    left = op2.remove_repeats(odd)
    assert left.columns == odd.columns
    texts = {r.doc_id: r.text for r in left.collect()}
    assert 6 not in texts and texts[3] == "one" and texts[0] is None and texts[1] == "" and not (texts.get(9) or "").strip()


def test_op3(spark, odd, none):
    toxic = [(100 + k, f"calm text number{k} with plain words item{k % 7} " + (f"{'xyzuvw'[k % 6]}a vileword {'mnopqrs'[k % 7]}b vileword end" if k % 2 else f"good day {'xyzuvw'[k % 6]}"), None, None, 0, *"xkrbsh") for k in range(80)]
    docs = odd.unionByName(spark.createDataFrame(toxic, odd.schema))
    model = op3.fit(docs, labels(spark, [(100 + k, 1, k % 2) for k in range(80)] + [(None, None, None), (3, None, None), (101, 1, 1)]))
    got = {r.doc_id: r for r in op3.toxicity(fold(docs), model).collect()}
    assert all(got[100 + k].predicted == k % 2 for k in range(80)) and all(0 <= r.score <= 1 for r in got.values())
    assert {r.score for r in op3.toxicity(fold(odd), op3.fit(docs, labels(spark))).collect()} == {0.0}
    assert op3.toxicity(fold(none), model).count() == 0


def test_op4(odd, none):
    model, counts = op4.fit(odd)
    got = op4.scored(fold(odd), model, counts).collect()
    assert len(got) == 16 and all(r.n_known == r.n_tokens and r.score < 0 for r in got)
    assert sorted(r.n_tokens for r in got)[:5] == [1, 1, 1, 1, 2]
    empty, nothing = op4.fit(none)
    assert {r.n_known for r in op4.scored(fold(odd), empty, nothing).collect()} == {0}
    assert op4.scored(fold(none), model, counts).count() == 0


def test_op5(spark, odd, none):
    given = labels(spark, [(5, 1, 0), (8, 1, 0), (4, 0, 0), (3, 0, 0), (None, 1, 0), (6, None, None)])
    model = op5.fit(odd, given)
    got = op5.quality(fold(odd), model).collect()
    assert len(got) == 16 and all(0 <= r.score <= 1 for r in got)
    kept = op5.decide(odd, model)
    assert kept.columns == odd.columns and {5, 6, 7, 8} <= {r.doc_id for r in kept.collect()}
    assert {r.score for r in op5.quality(fold(odd), op5.fit(odd, labels(spark))).collect()} == {1.0}
    assert op5.quality(fold(none), model).count() == 0


def test_op6(odd, none):
    got = op6.classes(odd).collect()
    assert len(got) == 16
    classes = {}
    for r in got:
        classes.setdefault(r.class_id, set()).add(r.doc_id)
    assert classes[5] == {5, 6, 7} and classes[0] == {0, 1, 2} and classes[None] == {None} and classes[9] == {9}
    kept = op6.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [0, 3, 4, 5, 8, 9, 10, 11, 12]
    assert op6.classes(none).count() == 0 and op6.deduplicate(none).count() == 0


def test_op7(odd, none):
    got = op7.fingerprints(odd).collect()
    assert len(got) == 16 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[5].fingerprint == by[6].fingerprint != by[7].fingerprint and by[1].fingerprint == by[2].fingerprint == "0" * 4 * op7.SAMPLES
    assert by[7].near_next > 0.8 and by[6].near_next == 1
    assert op7.fingerprints(none).count() == 0
    alone = op7.fingerprints(odd.where("doc_id = 8")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1


def test_op8(spark):
    schema = "conv_id long, turn long, role string, text string, n_turns string, formatted string"
    rows = [(1, 0, "user", "a <|im_end|> \\ <\\| b", "", ""), (1, 1, "assistant", None, "", ""), (1, 1, "assistant", "x\n<|x", "", ""), (1, None, None, "late", "", ""), (None, 0, "us\ner", "", "", "")]
    given = spark.createDataFrame(rows, schema)
    made = {r.conv_id: r for r in op8.format_conversations(given).collect()}
    assert op8.turns_of(made[1].formatted) == [("user", rows[0][3]), ("assistant", ""), ("assistant", "x\n<|x"), ("", "late")]
    assert op8.turns_of(made[None].formatted) == [("us\ner", "")]
    assert [made[1].formatted[s.begin : s.end] for s in made[1].loss] == ["x\n<\\|x"]
    assert op8.digest(op8.format_conversations(given.limit(0))).count() == 0


def test_op8_parts(spark):
    schema = "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    parts = [("text", "see ", None, None, None, None, None), ("image", None, "i.png", 57, 28, None, None), ("audio", None, "a.wav", None, None, 2.0, None), ("document", None, "d.pdf", None, None, None, 3), ("video", None, "v", None, None, None, None), ("text", " ok", None, None, None, None, None)]
    row = op8.format_conversations(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], schema)).first()
    assert row.formatted == "<|im_start|>user\nsee <|image:0|><|audio:1|><|document:2|><|video:3|> ok<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in row.attachments] == [("image", "i.png", 3), ("audio", "a.wav", 25), ("document", "d.pdf", 1800), ("video", "v", 0)]
    assert all(row.formatted[a.begin :].startswith(f"<|{a.kind}:") for a in row.attachments) and row.attachment_tokens == 1828


def test_op9(spark, odd, none):
    item = "word10 and some other10 thing10 word11 and some other11 thing11"
    items = spark.createDataFrame([(1, item.upper() + "!"), (1, item), (2, None), (3, ""), (4, "short")], "item_id long, text string")
    got = op9.find_leaks(odd, items).collect()
    assert {r.doc_id for r in got} == {5, 6, 7, 9, None} and {r.item_id for r in got} == {1} and all(r.distance == 0 for r in got)
    kept = op9.decontaminate(odd, items)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((r.doc_id or 0, r.text or "") for r in odd.collect() if r.text is None or "word10 and" not in r.text)
    assert op9.find_leaks(none, items).count() == 0 and op9.find_leaks(odd, items.limit(0)).count() == 0


def test_op10(odd, none):
    got = op10.mix(odd)
    assert got.count() == 16 and set(got.columns) == {*odd.columns, "source_size", "target", "rate", "copies", "taken"}
    rows = got.collect()
    assert all(r.taken <= 2 * r["size"] and r.target <= 2 * r.source_size + 1e-9 for r in rows)
    total = sum(r["size"] for r in rows)
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(1.5 * total)
    assert got.exceptAll(op10.mix(odd.repartition(5))).count() == 0
    assert op10.mix(none).count() == 0
    assert op10.copies_of(got).count() == sum(r.copies for r in rows)
    assert got.agg(F.sum("taken")).first()[0] > 0


def test_op6_rows_that_share_an_id(spark):
    rows = [(1, PROSE, "a"), (2, OTHER, "b"), (2, "quite unlike the rest", "c"), (2, PROSE, "d"), (3, OTHER, "e"), (None, OTHER, "f")]
    given = spark.createDataFrame(rows, "doc_id long, text string, kept_id string")
    kept = op6.deduplicate(given)
    assert kept.columns == given.columns and sorted(r.kept_id for r in kept.collect()) == ["a", "b", "c", "f"]
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in op6.classes(given).collect()) == [(0, 0, 0), (1, 1, 1), (2, 1, 1), (2, 2, 0), (2, 2, 1), (3, 2, 1)]


def test_op2_rows_that_share_an_id(spark):
    rows = [(1, PROSE, "a"), (2, PROSE, "b"), (2, OTHER, "c"), (3, f"{OTHER} and more", "d")]
    given = spark.createDataFrame(rows, "doc_id long, text string, cut_spans string")
    left = op2.remove_repeats(given)
    assert left.columns == given.columns and {r.cut_spans: r.text for r in left.collect()} == {"a": PROSE, "c": OTHER, "d": "and more"}


def test_op2_long_repeated_line():
    shingles = op2.shingle_hashes(np.tile(np.arange(4, dtype=np.uint64), 200_000), 5)
    began = time.process_time()
    got = op2.text_windows(shingles, np.array([0]), np.array([len(shingles)]), 46)
    assert len(got[0]) == 1 and time.process_time() - began < 2



def test_op9_short_items_and_shared_ids(spark):
    rows = [(1, "it is Paris, France."), (1, "nothing here"), (None, "paris france"), (2, "paris francesca"), (3, "x" * 9)]
    given = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, leaking_id string")
    items = spark.createDataFrame([(7, "Paris, France")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.begin, r.end) for r in op9.find_leaks(given, items).collect()) == [(0, 0, 12), (1, 6, 18)]
    assert {(r.doc_id, r.text) for r in op9.decontaminate(given, items).collect()} == {rows[1], rows[3], rows[4]}


def test_op10_clashing_names(spark):
    given = spark.createDataFrame([(1, "a b c", "x", "mine"), (None, "d e", "x", "too"), (None, "f g", None, "three")], "doc_id long, text string, source string, goal_source string")
    got = op10.copies_of(op10.mix(given))
    assert {"goal_source", "copy"} <= set(got.columns) and {r.goal_source for r in got.collect()} <= {"mine", "too", "three"}


def test_op8_unknown_part_types(spark):
    schema = "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string>>"
    rows = [(None, 0, "user", [("per_page", None, "a")]), (None, 0, "user", [("patch", None, "b"), ("text", "x", None)])]
    got = op8.format_conversations(spark.createDataFrame(rows, schema)).collect()
    assert sorted([a.tokens for a in r.attachments] for r in got) == [[0], [0]] and {r.conv_id for r in got} == {None} and all(r.n_turns == 1 for r in got)


def test_op1_chunks_meet_inside_words():
    text = " " + "ab, cd  efg " * 40 + " "
    for size in (7, 16, 50, 10_000):
        pieces = op1.chunked(text, size)
        assert pieces[0] + "".join(p[2:] for p in pieces[1:]) == text
        profiles = op1.Profiles(64, 1)
        whole = profiles.grams([text])
        parts = profiles.grams(pieces)
        count = lambda g: sorted(zip(map(tuple, g[0].tolist()), np.bincount(g[2], minlength=len(g[0])).tolist()))
        assert count(whole) == count(parts)


def test_pipeline_stages_on_no_rows(spark):
    import corpus_pipeline
    from quotelark.llm.common import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs.where("doc_id < 0"), "/root/testdata/sf0.001")
        assert got.count() == 0 and set(docs.columns) <= set(got.columns), name


def test_op9_items_without_letters(spark):
    items = spark.createDataFrame([(1, "∑∫≠"), (2, "**  %% "), (3, " \t"), (4, None), (5, "...")], "item_id long, text string")
    texts = ["see ∑∫≠ here", "a∑∫≠b", "x **\n%% y", "wait ... what", "fine...", "∑∫≠"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("a.b", F.lit(1))
    assert sorted((r.doc_id, r.item_id, r.begin, r.end) for r in op9.find_leaks(docs, items).collect()) == [(0, 1, 4, 7), (2, 2, 2, 7), (3, 5, 5, 8), (5, 1, 0, 3)]
    left = op9.decontaminate(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 4]


def test_op5_ties_go_by_order_and_dotted_names_stay(spark, odd):
    rng = np.random.default_rng(1)
    cosine = rng.integers(0, 4, (50, 40)).astype(np.float32)
    for k in (1, 7, 25, 40):
        want = [sorted(np.lexsort((np.arange(40), -row))[:k]) for row in cosine]
        assert op5.nearest(cosine, k).tolist() == [list(map(int, w)) for w in want]
    dotted = odd.withColumn("a.b", F.lit(1))
    kept = op5.decide(dotted, op5.fit(odd, labels(spark)))
    assert kept.columns == dotted.columns and kept.count() == odd.count()


def test_pipeline_on_odd_rows(spark, odd):
    import corpus_pipeline

    docs = corpus_pipeline.cut(odd.withColumn("a.b", F.lit("dot")))
    for name, stage in corpus_pipeline.STAGES:
        got = corpus_pipeline.cut(stage(spark, docs, "/root/testdata/sf0.001"))
        assert set(docs.columns) - {"size"} <= set(got.columns) and (name == "mixing" or got.columns == docs.columns), name
        assert name in ("mixing", "near_copies") or got.where("doc_id is null or doc_id in (3, 4, 10)").count() >= min(3, docs.where("doc_id is null or doc_id in (3, 4, 10)").count()), name
        docs = got
    texts = [r.text for r in docs.collect()]
    assert len(set(texts)) <= 9 and all(r["a.b"] == "dot" for r in docs.collect())


def test_samples_are_bounded_where_rows_share_an_id(spark):
    docs = spark.createDataFrame([(7, f"text {k % 500}") for k in range(3000)] + [(k, "same") for k in range(100, 130)], "doc_id long, text string")
    given = labels(spark, [(7, 1, 1)] + [(k, 0, 0) for k in range(100, 130)])
    for column in ("toxic", "quality"):
        got = op3.sample(docs, given, column, {1: 10, 0: 20}).collect()
        assert sum(r.label == 1 for r in got) == 10 == len({r.text for r in got if r.label == 1}) and sum(r.label == 0 for r in got) == 20
        assert {(r.doc_id, r.text) for r in got} == {(r.doc_id, r.text) for r in op3.sample(docs.repartition(7), given, column, {1: 10, 0: 20}).collect()}
