"""Hand-derived micro-fixtures for the operators."""

import math

import pytest
from pyspark.sql import functions as F

from wordmill.functions import chars, strings
from wordmill.operators import bayes, cooc, counts, evaluate, features, maxent, ner, segment, senses, tokens, vocab, windows

M1 = [(1, "pos", "a b"), (2, "pos", "a c"), (3, "neg", "b c"), (4, "neg", "c d")]


@pytest.fixture(scope="module")
def classes(spark):
    return spark.createDataFrame(M1, "doc_id long, label string, text string")


@pytest.fixture(scope="module")
def words(classes):
    return tokens.explode_tokens(classes, tokens.unicode_words(F.col("text")), "doc_id", "label").cache()


def found(df, *keys):
    return {tuple(r[k] for k in keys[:-1]) if len(keys) > 2 else r[keys[0]]: r[keys[-1]] for r in df.collect()}


def test_presence_and_marginals(words):
    seen = counts.presence(words, "doc_id", "label")
    assert found(seen.groupBy("word").agg(F.sum("n").alias("n")), "word", "n") == {"a": 2, "b": 2, "c": 3, "d": 1}
    levels = counts.marginals(seen, "label").where("level = 3").collect()
    assert [r["n"] for r in levels] == [8]


def test_chi_square(words):
    seen = counts.presence(words, "doc_id", "label")
    got = found(features.chi_square(seen, "label"), "word", "chi2")
    assert got == pytest.approx({"a": 5.333333, "d": 2.285714, "c": 1.066667, "b": 0}, abs=1e-6)
    assert found(features.chi_square(seen, "label", compat=True), "word", "chi2")["a"] == pytest.approx(4.333333, abs=1e-6)


def test_multinomial_and_bernoulli(spark, classes, words):
    prior = bayes.priors(classes, "label")
    every = words.select("word").distinct()
    query = spark.createDataFrame([(9, "a c")], "doc_id long, text string")
    own = tokens.explode_tokens(query, tokens.unicode_words(F.col("text")), "doc_id")
    model = bayes.train_multinomial(counts.occurrences(words, "label"), every, prior, "label")
    p = found(bayes.posterior(bayes.score_multinomial(query, own, model, prior, "doc_id", "label"), "doc_id"), "label", "posterior")
    assert p == pytest.approx({"pos": 0.666667, "neg": 0.333333}, abs=1e-6)
    model = bayes.train_bernoulli(counts.presence(words, "doc_id", "label"), every, prior, "label")
    scores = found(bayes.score_bernoulli(query, own, model, prior, "doc_id", "label"), "label", "score")
    assert {k: math.exp(v) for k, v in scores.items()} == pytest.approx({"pos": 0.0703125, "neg": 0.0234375}, abs=1e-7)


def test_pair_score(spark, classes):
    train = counts.pair_counts(counts.unordered_pairs(counts.document_sets(classes, tokens.unicode_words(F.col("text")), "label"), "label"), "label")
    query = counts.unordered_pairs(counts.document_sets(spark.createDataFrame([(9, "a b c")], "doc_id long, text string"), tokens.unicode_words(F.col("text")), "doc_id"), "doc_id")
    got = found(cooc.score_v3(query, train, classes.select("label").distinct(), "doc_id", "label"), "label", "score")
    assert got == pytest.approx({"pos": 7.675284, "neg": 15.350567}, abs=1e-5)
    assert [r["label"] for r in cooc.best(cooc.score_v3(query, train, classes.select("label").distinct(), "doc_id", "label"), "doc_id", "label").orderBy("rank").collect()] == ["pos", "neg"]


def test_pairs_keep_direction(spark):
    rows = spark.createDataFrame([(1, "b a b")], "doc_id long, text string")
    got = found(counts.pair_counts(counts.ordered_pairs(rows, tokens.unicode_words(F.col("text")), "doc_id")), "w1", "w2", "n")
    assert got == {("b", "a"): 1, ("a", "b"): 1}


LEX = segment.Lexicon({"ab": -1.0, "bc": -1.0, "c": -2.0, "a": -3.0, "b": -3.0})
HMM = segment.train_hmm([["ab", "c", "def"], ["今天", "天气", "好"], ["我", "喜欢", "今天"]])


def test_mp_is_the_best_of_all():
    assert segment.mp("abc", LEX) == ["ab", "c"]
    weight = lambda ws: sum(LEX.weight.get(w, LEX.least) for w in ws)
    for text in ("abcab", "bcabcx", "aabbcc"):
        every = list(segment.all_segmentations(text, LEX))
        assert weight(segment.mp(text, LEX)) == max(map(weight, every))
        assert all("".join(ws) == text for ws in every)


def test_segmenters_keep_the_text():
    for text in ("今天天气好", "我喜欢abc12.5天", "", "x"):
        assert "".join(segment.mp(text, LEX)) == text
        assert "".join(segment.mix(text, LEX, HMM)) == text
        assert "".join(segment.hmm_cut(text, HMM)) == text
        assert "".join(segment.query(text, LEX, HMM, longest=9)) == text
    assert segment.full("abc", LEX) == ["ab", "bc"]
    assert segment.level("abc", segment.Lexicon({"abc": -1.0, "ab": -2.0, "c": -2.0})) == [("abc", 0), ("ab", 1)]


def test_viterbi_is_brute_force():
    from itertools import product

    def score(text, tags):
        total = HMM.start[tags[0]] + HMM.emit[tags[0]].get(text[0], segment.MIN_LOG)
        for i in range(1, len(text)):
            total += HMM.trans[tags[i - 1]][tags[i]] + HMM.emit[tags[i]].get(text[i], segment.MIN_LOG)
        return total

    for text in ("今天天气", "我喜欢", "天好"):
        best = max(score(text, t) for t in product("BEMS", repeat=len(text)) if t[-1] in "ES")
        assert score(text, segment.viterbi(text, HMM)) == pytest.approx(best)


def test_hmm_from_tables(spark):
    sentences = [["ab", "c", "def"], ["今天", "天气", "好"], ["我", "喜欢", "今天"], []]
    docs = spark.createDataFrame([(s,) for s in sentences], "words array<string>")
    assert segment.train_hmm_table(docs, F.col("words")) == segment.train_hmm(sentences)


def test_segment_udf_and_pos(spark):
    rows = spark.createDataFrame([(1, "ab，c"), (2, None)], "id long, text string")
    got = {r["id"]: list(r["w"]) for r in rows.select("id", segment.segment(spark, "mp", LEX)("text").alias("w")).collect()}
    assert got == {1: ["ab", "，", "c"], 2: []}
    lexicon = spark.createDataFrame([("ab", "n")], "word string, tag string")
    tagged = segment.pos_tag(spark.createDataFrame([("ab",), ("1.5",), ("q",), ("天",)], "word string"), lexicon)
    assert found(tagged, "word", "tag") == {"ab": "n", "1.5": "m", "q": "eng", "天": "x"}
    assert found(segment.pos_tag(spark.createDataFrame([("q",)], "word string"), lexicon, compat=True), "word", "tag") == {"q": "x"}


def test_bems(spark):
    rows = spark.createDataFrame([(["ab", "c", "def"],)], "w array<string>")
    assert rows.select(F.array_join(windows.tag_sequence(F.col("w")), "")).first()[0] == "BESBME"
    got = found(windows.transitions(rows, F.col("w")), "tag", "next_tag", "n")
    assert got == {("B", "E"): 1, ("E", "S"): 1, ("S", "B"): 1, ("B", "M"): 1, ("M", "E"): 1}
    p = spark.createDataFrame([([[0.1, 0.8, 0.0, 0.1], [0.9, 0.1, 0.0, 0.0], [0.0, 0.3, 0.6, 0.1]],)], "p array<array<double>>")
    assert p.select(F.array_join(windows.constrained_decode(F.col("p")), "")).first()[0] == "BES"


def test_longest_match_and_frames(spark):
    rows = spark.createDataFrame([(1, "abc dab")], "id long, text string")
    assert rows.select(tokens.longest_match(F.col("text"), ["ab", "abc", "d"])).first()[0] == ["abc", "d", "ab"]
    framed = windows.frames(spark.createDataFrame([(1, "xyz")], "id long, text string"), F.col("text"), 1, 1, "#", "id")
    assert [r["frame"] for r in framed.orderBy("pos").collect()] == ["#xy", "xyz", "yz#"]


def test_contexts(spark):
    rows = tokens.explode_tokens(spark.createDataFrame([(1, "x y t z w")], "doc_id long, text string"), tokens.unicode_words(F.col("text")), "doc_id")
    got = found(counts.context_counts(counts.contexts(rows, "doc_id", ["t"])), "prev", "next", "n")
    assert got == {("y", "z"): 1, ("x", "y"): 1, ("z", "w"): 1}
    docs, listed = spark.createDataFrame([(1, "x y t z w"), (2, "t"), (3, "t t"), (4, "")], "doc_id long, text string"), tokens.unicode_words(F.col("text"))
    both = [counts.contexts_of(docs, listed, "doc_id", ["t"]), counts.contexts(tokens.explode_tokens(docs, listed, "doc_id"), "doc_id", ["t"])]
    assert sorted(both[0].select("doc_id", "prev", "next", "word").collect()) == sorted(both[1].select("doc_id", "prev", "next", "word").collect())
    near = [windows.neighbours_of(docs, listed, "doc_id"), windows.neighbours(tokens.explode_tokens(docs, listed, "doc_id"), "doc_id")]
    assert sorted(map(str, near[0].select(near[1].columns).collect())) == sorted(map(str, near[1].collect()))
    assert found(counts.weighted_contexts(docs.where("doc_id = 1"), listed, ["t"]), "word", "weight") == {"y": 2, "z": 2, "x": 1, "w": 1}


def test_segmentation_score(spark):
    rows = spark.createDataFrame([(1, ["ab", "c"], ["a", "b", "c"])], "id long, t array<string>, o array<string>")
    r = evaluate.segmentation_score(rows, "id", "t", "o", spark.createDataFrame([("ab",)], "word string")).first()
    assert (r["recall"], round(r["precision"], 3), round(r["f"], 6)) == (0.5, 0.333, 0.4)
    assert (r["oov_rate"], r["oov_recall"], r["iv_recall"]) == (0.5, 1.0, 0.0)


def test_sense_scores(spark):
    occurrences = spark.createDataFrame([(1, "p", "n", "w")], "id long, prev string, next string, word string")
    seen = spark.createDataFrame([("p", "n", "s1", 3), ("p", "n", "s2", 1)], "prev string, next string, word string, n long")
    thesaurus = spark.createDataFrame([("w", "A", "s1"), ("w", "A", "s2"), ("w", "A", "s3"), ("w", "B", "s2")], "word string, sense string, synonym string")
    assert found(senses.scores(occurrences, seen, thesaurus, ["id"]), "sense", "score") == pytest.approx({"A": 8 / 3, "B": 1.0})
    assert found(senses.scores(occurrences, seen, thesaurus, ["id"], normalise=True), "sense", "score") == pytest.approx({"A": 2 / 3, "B": 0.25})
    assert senses.best(senses.scores(occurrences, seen, thesaurus, ["id"]), ["id"]).first()["sense"] == "A"
    nothing = senses.scores(occurrences, seen.where("n > 9"), thesaurus, ["id"])
    assert senses.best(nothing, ["id"]).first()["sense"] == senses.UNDEFINED


def test_char_predicates(spark):
    rows = spark.createDataFrame([("市长",), ("23市",), ("大",), ("我有24",), ("三人",), ("",)], "s string")
    got = found(rows.select("s", chars.is_zhs(F.col("s")).alias("z")), "s", "z")
    assert got == {"市长": True, "23市": False, "大": True, "我有24": False, "三人": True, "": True}
    assert not rows.where("s = '三人'").select(chars.is_zhs(F.col("s"), no_numbers=True)).first()[0]


def test_strings(spark):
    row = spark.range(1).select(strings.split_any(F.lit("a; b,c,"), ";,").alias("s"), strings.join_slice(F.array(*map(F.lit, "abcd")), 1, 2).alias("j"), strings.occurrences(F.lit("aXbXc"), F.lit("X")).alias("n"), strings.log_sum_exp(F.array(F.lit(0.0), F.lit(0.0))).alias("l")).first()
    assert (row["s"], row["j"], row["n"]) == (["a", "b", "c"], "b c", 2)
    assert row["l"] == pytest.approx(math.log(2))


def test_gis_likelihood_rises(spark, classes, words):
    truth = classes.select("doc_id", "label")
    values = []
    for rounds in (1, 4):
        model = maxent.train_gis(words, truth, "doc_id", "label", rounds=rounds)
        p = maxent.predict(words, truth, model, "doc_id", "label")
        assert all(abs(r[0] - 1) < 1e-9 for r in p.groupBy("doc_id").agg(F.sum("p")).select("sum(p)").collect())
        values.append(maxent.log_likelihood(p, truth, "doc_id", "label").first()["ll"])
    assert values[1] > values[0]


def test_ner(spark):
    rows = spark.createDataFrame([(1, "[张/nr 三/nr]nz 在/p 北京/ns")], "id long, line string")
    each = rows.select("id", F.posexplode(ner.parse_tagged(F.col("line"))).alias("pos", "t")).select("id", "pos", "t.word", "t.tag")
    merged = ner.merge_entities(each, "id").orderBy("first_pos").collect()
    assert [(r["word"], r["tag"]) for r in merged] == [("张三", "nr"), ("在", "p"), ("北京", "ns")]
    weights = ner.train_perceptron([([["w=a"], ["w=b"]], ["X", "Y"]), ([["w=b"], ["w=a"]], ["Y", "X"])])
    assert ner.viterbi_tags([["w=a"], ["w=b"], ["w=a"]], weights, ["X", "Y"]) == ["X", "Y", "X"]


def test_dense_numbers(spark):
    rows = spark.createDataFrame([(x,) for x in (5, 3, 9, 1)], "v long")
    assert found(vocab.number_rows(rows, "v"), "v", "id") == {1: 0, 3: 1, 5: 2, 9: 3}


def test_sentences(spark):
    rows = spark.createDataFrame([(1, i + 1, w) for i, w in enumerate(["a", "b", ".", "c", "!", "d"])], "id long, pos int, word string")
    got = [(r["word"], r["sent"]) for r in tokens.sentences(rows, "id").orderBy("pos").collect()]
    assert got == [("a", 0), ("b", 0), (".", 0), ("c", 1), ("!", 1)]


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "doc_id long, label string, text string")
    each = tokens.explode_tokens(none, tokens.unicode_words(F.col("text")), "doc_id", "label")
    assert features.chi_square(counts.presence(each, "doc_id", "label"), "label").count() == 0
    assert vocab.first_seen(each).count() == 0
