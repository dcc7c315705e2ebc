"""Iterative models and LSI against small exact computations."""

import numpy as np

from wordmill.operators import retrieval


def test_lsi_uses_every_word_and_document(spark):
    rng = np.random.default_rng(3)
    a = np.where(rng.random((40, 400)) < 0.05, rng.random((40, 400)), 0.0)
    for k in range(5):  # five topics that stand out
        a[k::5, k * 30 : k * 30 + 30] += 1 + k / 5
    a[7] = 0  # a document without words
    rows = [(int(d), f"w{j}", float(a[d, j])) for d, j in zip(*np.nonzero(a), strict=True)]
    weights = spark.createDataFrame(rows, "doc_id long, word string, w double")
    documents = spark.createDataFrame([(i,) for i in range(40)], "doc_id long")
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    for topics in (5, 60):
        found, values = retrieval.lsi(weights, "doc_id", topics, documents, rounds=12, least=1e-9, part_rows=100)
        got = {r["doc_id"]: np.array(r["vector"]) for r in found.collect()}
        assert sorted(got) == [*range(40)] and not got[7].any()
        have, want = np.stack([got[i] for i in range(40)]), (u * s)[:, :topics]
        assert np.allclose(values[:5], s[:5], rtol=1e-4)
        assert np.allclose(have @ have.T, want @ want.T, atol=2e-2 if topics == 5 else 1e-6)
    # a new text that has the words of an old one comes to the old one's place
    index, _, words = retrieval.lsi(weights, "doc_id", 60, documents, rounds=3, least=1e-9, part_rows=100, with_words=True)
    again = {r["doc_id"]: np.array(r["vector"]) for r in retrieval.project(weights.where("doc_id in (3, 8)"), words, "doc_id").collect()}
    old = {r["doc_id"]: np.array(r["vector"]) for r in index.collect()}
    assert sorted(again) == [3, 8] and all(np.allclose(again[d], old[d], atol=1e-6) for d in again)


def test_lsi_index_has_every_document(spark):
    from wordmill.plans import catalogue

    sf = "/root/testdata/sf0.001"
    found = catalogue.queries()["lsi_search"](spark, sf)
    ids = {r["doc_id"] for r in catalogue.table(spark, sf, "documents").where("doc_id % 20 = 0").select("doc_id").collect()}
    assert {r["query_id"] for r in found.select("query_id").distinct().collect()} == ids


def test_maxent_query_moves_off_uniform(spark, tmp_path):
    from wordmill.plans import catalogue

    # one long document makes GIS steps short; the others have five words of their class
    docs = [(i, " ".join(("good" if i % 2 else "poor") + chr(97 + j) for j in range(5)), i % 2) for i in range(40)] + [(40, " ".join(chr(97 + i) + chr(97 + j) + "x" for i in range(15) for j in range(20)), 0)]
    spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d[0], d[2], 0) for d in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    p = {(r["doc_id"], r["label"]): r["p"] for r in catalogue.queries()["maxent_gis"](spark, str(tmp_path)).collect()}
    held_out = {d for d, _ in p}
    assert held_out == {d for d in range(41) if d % 3 == 2}  # every third row
    assert min(p[d, label] for d, _, label in docs[:40] if d in held_out) > 0.55


def test_gis_grid_is_gis(spark):
    """Weights in arrays, for several numbers of words at once, against weights in tables."""
    import random

    from wordmill.operators import maxent

    rng = random.Random(2)
    rows = [(i, rng.choice("pqr"), sorted({rng.randrange(9) for _ in range(rng.randrange(5))})) for i in range(30)]
    docs = spark.createDataFrame([r[:2] for r in rows], "id int, label string")
    told = maxent.GisGrid(spark.createDataFrame(rows, "id int, label string, ranks array<int>"), [3, 9, 50]).train(4).predict(spark.createDataFrame(rows, "id int, label string, ranks array<int>"), "id")
    got = {(r["n_words"], r["id"], r["label"]): r["p"] for r in told.collect()}
    for n in (3, 9):
        words = spark.createDataFrame([(i, f"w{k}") for i, _, ranks in rows for k in ranks if k < n], "id int, word string")
        want = maxent.predict(words, docs, maxent.train_gis(words, docs, "id", "label", rounds=4), "id", "label").collect()
        assert len(want) == 90 and all(abs(got[n, r["id"], r["label"]] - r["p"]) < 1e-9 for r in want)
    assert all(abs(got[9, i, y] - got[50, i, y]) < 1e-12 for i, *_ in rows for y in "pqr")


def test_sweep_is_one_size_at_a_time(spark):
    from wordmill.operators import bayes, counts, features

    rows = [(i, "pq"[i % 2], "abcdefgh"[(i * 7 + k) % 8]) for i in range(12) for k in range(1 + i % 4)]
    tokens = spark.createDataFrame(rows, "id int, label string, word string")
    docs = tokens.select("id", "label").distinct()
    prior, seen, occ = bayes.priors(docs, "label"), counts.presence(tokens, "id", "label"), counts.occurrences(tokens, "label")
    scores = features.chi_square(seen, "label")
    held = docs.unionByName(spark.createDataFrame([(99, "p")], "id int, label string"))  # a document without words
    got = {(r["n_words"], r["model"], r["id"], r["label"]): r["score"] for r in bayes.sweep(held, tokens, occ, seen, scores, prior, [2, 5, 20], "id", "label").collect()}
    for n in (2, 5, 20):
        words = features.top(scores, n).select("word")
        both = {"multinomial": bayes.score_multinomial(held, tokens, bayes.train_multinomial(occ, words, prior, "label"), prior, "id", "label"), "bernoulli": bayes.score_bernoulli(held, tokens, bayes.train_bernoulli(seen, words, prior, "label"), prior, "id", "label")}
        for model, told in both.items():
            assert all(abs(got[n, model, r["id"], r["label"]] - r["score"]) < 1e-9 for r in told.collect())


def test_lda_query_sees_rare_words(spark, tmp_path):
    from wordmill.plans import catalogue

    # 2100 words in all documents say nothing; each document's own word is rarer than all of them
    common = " ".join(chr(97 + i // 676) + chr(97 + i // 26 % 26) + chr(97 + i % 26) for i in range(2100))
    spark.createDataFrame([(i, f"{common} own{chr(97 + i)}") for i in range(12)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.queries()["lda_topics"](spark, str(tmp_path)).collect()
    assert {r["topic"] for r in found} == {*range(20)}
    assert {r["word"] for r in found} & {f"own{chr(97 + i)}" for i in range(12)}


def test_lda_rounds_are_carried_on(spark):
    from pyspark.sql import functions as F

    from wordmill.operators import topics

    rows = [(i, ("plum pear " if i % 2 else "iron zinc ") * (1 + i % 3) + f"own{i}") for i in range(40)]
    featured, _ = topics.vectors(spark.createDataFrame(rows, "doc_id long, text string"), F.split("text", " "))
    featured = featured.select("features").persist()
    told = lambda model: [(r["topic"], r["termIndices"], [round(w, 9) for w in r["termWeights"]]) for r in model.describeTopics(4).collect()]

    def jobs(name, run):
        spark.sparkContext.setJobGroup(name, name)
        out = run()
        made = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out, made

    once, of_once = jobs("lda once", lambda: topics.lda(featured, 3, 16))
    model, of_all = jobs("lda until", lambda: topics.lda_until(featured, 3, rounds=4, most=16, least=-1.0))
    assert 16 <= of_once <= of_all <= of_once + 16  # 28 rounds and more, if each step begins anew
    assert told(model) and model.vocabSize() == once.vocabSize() == 44 and model.logPerplexity(featured) > 0
    # the same rounds as pyspark.ml's own, over the same partitions
    assert told(topics.Rounds(featured, 3, 1).until(16)) == told(once)
    featured.unpersist()


def test_labeled_lda_parts_words_by_label(spark):
    """Words of their own label go there; a word of both goes by the rest of its document; unlabelled rows use all labels."""
    from pyspark.sql import functions as F

    from wordmill.operators import topics

    rows = [(i, ["x"] if i % 4 == 0 else ["y"] if i % 4 == 1 else ["x", "y"] if i % 4 == 2 else None, (["xa", "xb"] if i % 2 == 0 else ["ya", "yb"]) * 10 + ["both"]) for i in range(40)] + [(40, ["x"], []), (41, ["y"], None)]
    docs = spark.createDataFrame(rows, "doc_id long, labels array<string>, words array<string>")
    phi, theta = topics.labeled_lda(docs, "doc_id", "labels", "words", sweeps=30, part_tokens=200)
    p = {(r["label"], r["word"]): r["phi"] for r in phi.collect()}
    assert p["x", "xa"] > 0.4 and p["y", "ya"] > 0.4 and p.get(("x", "ya"), 0) < 0.05 and p.get(("y", "xa"), 0) < 0.05
    t = {(r["doc_id"], r["label"]): r["theta"] for r in theta.collect()}
    assert {k for k in t if k[0] == 0} == {(0, "x")} and t[2, "x"] > 0.8 and t[3, "y"] > 0.8 and (41, "y") in t
    tokens = docs.where("size(words) > 0").select("doc_id", F.explode("words").alias("word"))
    assert 1.5 < topics.perplexity(tokens, phi, theta, "doc_id").first()[0] < 3
