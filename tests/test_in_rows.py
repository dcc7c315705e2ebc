"""Steps that are done inside a row, or counted by whole arrays, against the same done token by token."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordmill.operators import counts, evaluate, ner, segment, senses, tokens, windows
from wordmill.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["seg_edits", "seg_oov", "seg_score", "entity_merge", "sense_expand", "sense_expand_again"])
def test_tokens_are_not_shuffled_by_document(spark, name):
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "doc_id" not in "".join(re.findall(r"Join FullOuter[^\n]*", plan))


def cut(rng, text):
    at = sorted({0, len(text), *(rng.randrange(len(text) + 1) for _ in range(4))})
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)]


def test_spans_are_compared_row_by_row(spark):
    rng = random.Random(1)
    rows = [(i, cut(rng, "abcdefgh"), cut(rng, "abcdefgh"[: rng.choice([8, 8, 5])])) for i in range(40)] + [(90, [], ["a"]), (91, ["a"], []), (92, None, ["b"]), (93, ["　", "x　y"], ["x", "y", ""]), (94, [None, "x"], ["x"])]
    frame = spark.createDataFrame(rows, "id long, t array<string>, o array<string>").repartition(3)
    d = {"right": 0, "ins": 0, "del": 0, "sub": 0, "t": 0, "o": 0}
    told = Counter()
    for _, *both in rows:
        spans = []
        for words in both:
            at, own = 0, {}
            for w in (w.replace("　", "") for w in words or [] if w):
                if w:
                    own[at, at + len(w)] = w
                    at += len(w)
            spans.append(own)
        t, o = spans
        d["t"], d["o"], d["right"] = d["t"] + len(t), d["o"] + len(o), d["right"] + len(t.keys() & o.keys())
        told.update((w, s in o) for s, w in t.items())
        run = [0, 0]
        for s in [*sorted(t.keys() | o.keys()), None]:
            if s is None or s in t and s in o:
                d["ins"], d["del"], d["sub"] = d["ins"] + max(run[1] - run[0], 0), d["del"] + max(run[0] - run[1], 0), d["sub"] + min(run)
                run = [0, 0]
            else:
                run[s in o] += 1
    got = evaluate.segmentation_score(frame, "id", "t", "o", spark.createDataFrame([("ab",), ("x",)], "word string")).first()
    assert (got["n_truth"], got["n_output"], got["n_right"]) == (d["t"], d["o"], d["right"])
    outside = [(ok, n) for (w, ok), n in told.items() if w not in ("ab", "x")]
    assert got["oov_rate"] == pytest.approx(sum(n for _, n in outside) / d["t"]) and got["oov_recall"] == pytest.approx(sum(n for ok, n in outside if ok) / sum(n for _, n in outside))
    assert tuple(evaluate.segmentation_edits(frame, "id", "t", "o").first()) == (d["ins"], d["del"], d["sub"])


@pytest.mark.parametrize("method", ["mp", "mix", "full"])
def test_segmenter_holds_few_words(spark, monkeypatch, method):
    """What a batch's rows are cut into is packed as it goes, and what is known is bounded."""
    monkeypatch.setattr(segment, "KNOWN", 5), monkeypatch.setattr(segment, "PACK", 7)
    lexicon, hmm = segment.Lexicon({"ab": -1.0, "bc": -1.0, "c": -2.0}), segment.train_hmm([["ab", "c"], ["今天", "好"]])
    texts = ["abc ab，c bcab", None, "", "今天 abc 好ab", "abc"] * 20
    got = segment.segment(spark, method, lexicon, hmm).func(pa.array(texts, pa.string()))
    assert isinstance(got, pa.Array) and got.to_pylist() == [segment.segment_text(t, method, lexicon, hmm) if t else [] for t in texts]


def test_counted_windows(spark, monkeypatch):
    monkeypatch.setattr(windows, "FRAMES", 5)
    rows = [(1, "x", "ab ab\0é天ab"), (2, "y", ""), (3, None, "a"), (4, "x", "ab ab 𝒳a"), (5, "y", None), (6, None, "ab ab")]
    docs = spark.createDataFrame(rows, "id long, lang string, text string").repartition(2)
    for before, after in ((3, 3), (1, 0)):
        got = {r["frame"]: r["n"] for r in windows.count_frames(docs, F.col("text"), before, after, "#").collect()}
        assert got == Counter(("#" * before + t + "#" * after)[i : i + before + after + 1] for *_, t in rows if t for i in range(len(t)))
    listed = tokens.unicode_words(F.col("text"))
    got = {(r["lang"], r["w1"], r["w2"]): r["n"] for r in windows.count_adjacent(docs, listed, "lang").collect()}
    assert got == Counter(map(tuple, windows.adjacent_pairs(docs, listed, "lang").collect()))
    assert {r["word"]: r["n"] for r in counts.presence_of(docs, listed).collect()} == {r["word"]: r["n"] for r in counts.presence(tokens.explode_tokens(docs, listed, "id"), "id").collect()}


def test_many_signs_do_not_run_over(spark):
    text = "".join(chr(0x4E00 + i) for i in range(3000)) * 2
    docs = spark.createDataFrame([(text,)], "text string")
    got = {r["frame"]: r["n"] for r in windows.count_frames(docs, F.col("text"), 3, 3, "#").collect()}
    assert got == Counter(("###" + text + "###")[i : i + 7] for i in range(len(text)))


def test_emissions_count_words_first(spark):
    docs = spark.createDataFrame([(["ab", "c", "ab"],), ([],), (["", "abcd"],)], "w array<string>")
    got = {(r["tag"], r["ch"]): r["n"] for r in windows.emissions(docs, F.col("w")).collect()}
    assert got == {("B", "a"): 4, ("E", "b"): 3, ("S", "c"): 2, ("M", "b"): 2, ("M", "c"): 2, ("E", "d"): 2}
    plan = windows.emissions(docs, F.col("w"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2


def test_entities_and_senses_inside_the_row(spark):
    docs = spark.createDataFrame([(1, "the and x of the"), (2, ""), (3, "y z"), (4, "of"), (5, None)], "doc_id long, text string")
    listed = tokens.unicode_words(F.col("text"))
    tag = lambda w: F.when(w.isin("the", "and"), "nr").when(w == "of", "ns").otherwise("n")
    flat = tokens.explode_tokens(docs, listed, "doc_id")
    columns = ["doc_id", "first_pos", "word", "tag"]
    want = ner.merge_entities(flat.withColumn("tag", tag(F.col("word"))), "doc_id").select(columns).collect()
    assert sorted(ner.merge_entities_of(docs, listed, tag, "doc_id").select(columns).collect()) == sorted(want) and len(want) == 7
    thesaurus = spark.createDataFrame([("h", "s1", "x"), ("h", "s1", "w"), ("h", "s2", "v")], "word string, sense string, synonym string")
    docs = spark.createDataFrame([(1, "a b x c d"), (2, "a b w c d"), (3, "x"), (4, "a b v c d"), (5, "q a b w c d")], "doc_id long, text string")
    near, flat = windows.neighbours_of(docs, listed, "doc_id", edge=None), tokens.explode_tokens(docs, listed, "doc_id")
    inside, apart = senses.expand_near(near, thesaurus, "doc_id"), senses.expand(flat, thesaurus, "doc_id")
    assert all(sorted(map(str, i.collect())) == sorted(map(str, a.collect())) for i, a in zip(inside, apart, strict=True))
    cut_near = near.where(F.col("word").isin("x", "w", "v"))
    assert sorted(map(tuple, senses.expand_again_near(cut_near, senses.expand_near(cut_near, thesaurus, "doc_id")[1], "doc_id").collect())) == [(1, "h", "s1"), (2, "h", "s1"), (5, "h", "s1")]
