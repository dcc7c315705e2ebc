"""Readers and writers over small files."""

from pyspark.sql import functions as F

from wordmill.sources import corpus


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_labelled_and_tokenised(spark, tmp_path):
    write(tmp_path / "sport.txt", "eins\n\nzwei\n")
    write(tmp_path / "sport_p.txt", "a b a\n")
    (tmp_path / "bad.txt").write_bytes(b"ok\n\xff\xfe\n")
    got = sorted((r["label"], r["text"]) for r in corpus.labelled(spark, str(tmp_path)).collect())
    assert got == [("bad", "ok"), ("sport", "eins"), ("sport", "zwei")]
    assert [(r["label"], r["words"]) for r in corpus.tokenised(spark, str(tmp_path)).collect()] == [("sport", ["a", "b", "a"])]


def test_lists_and_lexicons(spark, tmp_path):
    stop = write(tmp_path / "stop.utf8", "# x\n the \n\nand\n")
    assert sorted(r["word"] for r in corpus.word_list(spark, stop).collect()) == ["and", "the"]
    lexicon = corpus.lexicon_weights(corpus.lexicon(spark, write(tmp_path / "lex.utf8", "ab 3 n\nc 1 v\n")))
    assert {r["word"]: round(r["weight"], 6) for r in lexicon.collect()} == {"ab": -0.287682, "c": -1.386294}
    assert {r["word"]: r["tag"] for r in corpus.user_lexicon(spark, write(tmp_path / "user.utf8", "x\ny nz\n")).collect()} == {"x": "", "y": "nz"}
    assert corpus.idf_list(spark, write(tmp_path / "idf.utf8", "x 1.5\nbroken\n")).count() == 1
    assert corpus.config(spark, write(tmp_path / "c.conf", "# no\na = 1\nb=2=3\n")) == {"a": "1", "b": "2=3"}


def test_labels_and_tags(spark, tmp_path):
    rows = corpus.multi_labelled(spark, write(tmp_path / "faq.txt", "[a,b]hello\nplain\n")).collect()
    assert sorted(((r["labels"], r["text"]) for r in rows), key=lambda x: x[1]) == [(["a", "b"], "hello"), (None, "plain")]
    tags = corpus.char_tags(spark, write(tmp_path / "ct.txt", "a N\nb B-PER\n")).orderBy("pos").collect()
    assert [(r["ch"], r["tag"]) for r in tags] == [("a", "N"), ("b", "B-PER")]


def test_thesaurus(spark, tmp_path):
    text = "[DDv 打]\n【击=】 敲 击\n#例句:～门|他～鼓\n【买=】 购\n"
    got = {r["sense"]: (r["word"], r["synonyms"], r["examples"]) for r in corpus.thesaurus(spark, write(tmp_path / "th.txt", text)).collect()}
    assert got == {"击": ("打", ["敲", "击"], ["打门", "他打鼓"]), "买": ("打", ["购"], [])}


def test_hmm_text(spark, tmp_path):
    text = "# start\n-1 -9 -9 -2\n" + "-1 -2 -3 -4\n" * 4 + "a:-0.5,b:-1\nc:-2\nd:-3\ne:-4\n"
    model = corpus.hmm_model(spark, write(tmp_path / "hmm.utf8", text))
    assert model.start["S"] == -2 and model.trans["M"]["E"] == -2 and model.emit["B"] == {"a": -0.5, "b": -1.0}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(["a", "b", "a"],), ([],)], "words array<string>")
    corpus.write_tokenised(rows, str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["a b"]
    assert spark.range(1).select(corpus.normalised_corpus(F.array(F.lit("好"), F.lit("!"), F.lit("x")))).first()[0] == "好 _E_ _P_"
    built = []
    build = lambda: built.append(1) or rows
    assert corpus.cached(spark, str(tmp_path), "c", build).count() == corpus.cached(spark, str(tmp_path), "c", build).count() == 2
    assert built == [1]


def test_jdbc_round_trip(spark, tmp_path):
    """Spark ships with Derby, which stands for the database."""
    from wordmill.sources import corpus

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([("今天", 3), ("好", 1)], "word string, n int")
    try:
        corpus.write_jdbc(rows, url, "words", driver="org.apache.derby.jdbc.EmbeddedDriver", createTableColumnTypes="word VARCHAR(20)")
    except Exception as missing:
        if "ClassNotFound" not in str(missing) and "No suitable driver" not in str(missing):
            raise
        import pytest

        pytest.skip("no Derby here")
    got = corpus.jdbc(spark, url, "words", driver="org.apache.derby.jdbc.EmbeddedDriver").collect()
    assert sorted((r[0], r[1]) for r in got) == [("今天", 3), ("好", 1)]


def test_file_digest_and_models(spark, tmp_path):
    import hashlib

    from pyspark.ml.classification import MultilayerPerceptronClassificationModel
    from pyspark.ml.linalg import Vectors

    from wordmill.functions import strings
    from wordmill.operators import neural

    (tmp_path / "f.bin").write_bytes(b"\x00\xff text")
    assert [r["md5"] for r in strings.file_digests(spark, f"{tmp_path}/f.bin").collect()] == [hashlib.md5(b"\x00\xff text").hexdigest()]
    rows = spark.createDataFrame([(Vectors.dense(x, y), float((x > 0.5) != (y > 0.5))) for x in (0.0, 1.0) for y in (0.0, 1.0)] * 5, ["features", "label"])
    model = neural.perceptron(rows, [2, 6, 2])
    model.write().overwrite().save(f"file://{tmp_path}/model")
    again = MultilayerPerceptronClassificationModel.load(f"file://{tmp_path}/model")
    assert [r["prediction"] for r in again.transform(rows).collect()] == [r["prediction"] for r in model.transform(rows).collect()]
    docs = spark.createDataFrame([(["a", "b", "c"] * 3,)] * 6, "words array<string>")
    assert neural.word_vectors(docs, "words", size=4, least=1).getVectors().count() == 3
