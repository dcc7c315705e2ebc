"""Language ID, URL filter, chat windows and the pipeline."""

import hashlib
import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wordmill.llm import bpe, chat, dedup, langid, mixing, queries, simhash, urlfilter

SF = "/root/testdata/sf0.001"


def test_ngrams_are_presences():
    present, n = langid.ngrams("Ab, ab! Éb")
    assert n == int(present.sum())
    signs = lambda s: [langid.SIGN[ord(c)] if c != " " else 0 for c in s]
    a, b = signs("ab")
    assert present[a] and present[langid.SIGNS + a * 64 + b] and not present[langid.SIGNS + b * 64 + a]
    assert langid.ngrams("ab  ..  ab")[1] == langid.ngrams("ab ab")[1]


def plain_regression(learned, texts, landmarks, ridge):
    """Kernel, Nyström map and weighted ridge regression, written out over sets of strings."""
    def grams(text):
        signs = "".join(chr(0x4E00 + langid.SIGN[ord(c)]) if ord(c) < len(langid.SIGN) and langid.SIGN[ord(c)] else " " for c in text)
        signs = " " + " ".join(signs.split()) + " "
        return {signs[i : i + n] for n in (1, 2, 3) for i in range(len(signs) - n + 1)}

    def k(a, b):
        return len(a & b) / np.sqrt(len(a) * len(b))

    sets, langs = [grams(t) for t, _ in learned], sorted({x for _, x in learned})
    by_lang = {x: [i for i, (_, y) in enumerate(learned) if y == x] for x in langs}
    order = sorted((by_lang[y].index(i), i) for i, (_, y) in enumerate(learned))
    marks = [sets[i] for _, i in order[:landmarks]]
    values, vectors = np.linalg.eigh(np.array([[k(a, b) for b in marks] for a in marks]))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = np.array([[k(s, m) for m in marks] for s in sets]) @ root
    weight = np.diag([1 / len(by_lang[y]) for _, y in learned])
    target = np.array([[1.0 if y == x else -1.0 for x in langs] for _, y in learned])
    beta = np.linalg.solve(phi.T @ weight @ phi + ridge * np.eye(phi.shape[1]), phi.T @ weight @ target)
    return langs, np.array([[k(grams(t), m) for m in marks] for t in texts]) @ root @ beta


def test_regression_is_the_plain_one(spark):
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and text is not null").orderBy("doc_id").limit(70).collect()]
    rows = [(t, x) for t, x in rows if langid.HAS_LETTER.search(t) and all(ord(c) < len(langid.SIGN) for c in t)]
    learned, asked = rows[:40], [t for t, _ in rows[40:]]
    model = langid.train([np.flatnonzero(langid.ngrams(t)[0]) for t, _ in learned], [x for _, x in learned], 15, 1e-3)
    langs, want = plain_regression(learned, asked, 15, 1e-3)
    found = [langid.ngrams(t) for t in asked]
    assert model.langs == langs
    assert model.score([(p[model.used], n) for p, n in found]) == pytest.approx(want, abs=2e-3)


def test_letters_and_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.fit(docs)
    odd = spark.createDataFrame([("² ½ ①",), ("Ⅷ ⅓ 12",), ("a",), ("_",)], "text string")
    assert {r["text"]: r["lang_pred"] == "und" for r in langid.predict(odd, model).collect()} == {"² ½ ①": True, "Ⅷ ⅓ 12": True, "a": False, "_": True}
    other = langid.fit(docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text", "lang").repartition(5))
    assert np.array_equal(model.weights, other.weights) and np.array_equal(model.used, other.used)
    many = spark.createDataFrame([(f"{'abcdefghij'[i // 10]}{'klmnopqrst'[i % 10]} " * 9, f"x{i:03}") for i in range(100)] * 3, "text string, lang string")
    assert len(langid.fit(many).langs) == 100
    assert len(langid.fit(many, per_lang=50, most=10).langs) == 100


def test_language_accuracy(spark):
    out = queries.op2_langid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == 1000
    held = [r for r in out if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_edges(spark):
    rows = [(1, "the and with that this have", "en"), (2, "der die und nicht eine ist", "de"), (3, None, "en"), (4, "123 !!", "en"), (5, "", None), (6, "the " * 100_000, "en"), (None, "中文字", None), (7, "the and", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model, keep=["doc_id"]).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert got[1][0] == got[6][0] == got[7][0] == "en" and got[2][0] == "de"
    nothing = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.predict(docs.withColumn("score", F.lit(1)), model)


def plain_judge(url):
    head = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in head[1]) if head else ""
    path = head[2] if head else ""
    fits = [(h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_url_rules(spark):
    urls = ["http://WWW.Example.com/en/1", "https://example.com/en/x?q#f", "https://m.example.com/de/", "http://a.net/fr/1", "http://net/es/", "http://a.net/en/", "http://notcom/x", "x", None, "", "http://com", "http://u@h.com:80/p#a", "ftp://İ.com/É?x://y", "http://a.com\n/x"]
    out = {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    for i, url in enumerate(urls):
        host, path, (rule, verdict) = plain_judge(url)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule), url
        assert out[i]["verdict"] == verdict if verdict else out[i]["verdict"] in ("allow", "block")


def test_url_model(spark):
    table = urlfilter.labelled_table(spark)
    model = urlfilter.fit(table)
    scored = model.transform(urlfilter.featured(table.withColumn("label", F.col("label").cast("double"))))
    assert scored.where("__block = label").count() >= 0.97 * table.count()
    fresh = spark.createDataFrame([("http://casino-bonus-slots.example/bet/jackpot", 1.0), ("https://www.library.example/courses/history", 0.0)], "url string, label double")
    assert model.transform(urlfilter.featured(fresh)).where("__block = label").count() == 2
    held_out = [("https://opera-tickets.theatre.example/calendar/spring", 0), ("https://www.botany.example/plants/ferns", 0), ("https://en.news-room.example/en/4410.html", 0), ("https://museum.city.example/visit/hours", 0), ("http://free-poker-bonus.example/play/casino", 1), ("http://cheap-viagra-pills.example/order/now", 1), ("http://xxx-adult-videos.example/hot/live", 1), ("http://keygen-crack-download.example/warez", 1)]
    asked = spark.createDataFrame([(u, float(x)) for u, x in held_out], "url string, label double")
    assert model.transform(urlfilter.featured(asked)).where("__block = label").count() >= 7
    plan = queries.op7_urlfilter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "html" not in plan


def test_url_verdicts_are_the_models(spark):
    """Every verdict without a rule, from the n-grams and the coefficients by hand."""
    from pyspark.ml.feature import HashingTF

    model = urlfilter.fit(urlfilter.labelled_table(spark))
    indexed, weights, intercept = HashingTF(numFeatures=urlfilter.FEATURES, binary=True), model.coefficients.toArray(), model.intercept
    index = lru_cache(maxsize=None)(indexed.indexOf)
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").limit(60).collect()
    rows = [(r["page_id"], r["url"]) for r in pages] + [(-1, None), (-2, ""), (-3, "http://a.b/" + "".join(f"{i}/" for i in range(1000))), (-4, "x"), (-1, None)]
    out = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string").withColumn("__host", F.lit(1))).collect()
    assert len(out) == len(rows) and urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    urls = dict(rows)
    for r in out:
        host, path, (_, verdict) = plain_judge(urls[r["page_id"]])
        grams = {m + p[i : i + n] for m, x in (("h:", host), ("p:", path)) if x for p in [f"^{x}$"] for n in urlfilter.SIZES for i in range(max(1, len(p) - n + 1))}
        value = intercept + sum(float(weights[i]) for i in {index(g) for g in grams})
        assert r["verdict"] == (verdict or ("block" if value > 0 else "allow"))


@pytest.mark.parametrize("text", ["", "\\", "</s>[INST] ok [/INST]", "<<SYS>>\\<</SYS>>", "<\\s>", "<<ROLE:x>>", "<", "[", "<<", "a\\\\</s", "/s>", "\\n<s><s>"])
def test_escape(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not chat.CONTROL.search(escaped)
    for role in ("user", "assistant", "system", "", "tool >>x</s>"):
        begin, end = chat.marks(role)
        assert chat.parse(begin + escaped + end + begin + escaped + end) == [(role, text)] * 2


def test_chat_query(spark):
    out = {r["conv_id"]: r for r in queries.op4_chat(spark, SF).collect()}
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r["conv_id"]].append((r["role"], r["text"] or ""))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert out.keys() == turns.keys()
    for conv, told in turns.items():
        said = "".join(t for r, t in told if r == "assistant")
        r = out[conv]
        assert r["n_turns"] == len(told) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in told).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chat_windows(spark):
    rows = [(1, 0, "system", "be kind " * 3)] + [(1, i, "user" if i % 2 else "assistant", f"w{i} " * (20 + i % 7)) for i in range(1, 60)] + [(1, 60, "assistant", "big " * 900), (2, None, None, None), (2, None, None, None), (None, 1, "tool", "x")]
    made = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=120, history=50).collect()
    one = sorted((r for r in made if r["conv_id"] == 1), key=lambda r: r["window"])
    assert len(one) > 10
    first = 0
    for r in one:
        told = chat.parse(r["text"])
        assert told[0][0] == "system" and r["first_turn"] == first
        first += len(told) - r["repeated"]
        assert r["tokens"] == sum(chat.count_words([t for _, t in told]))
        assert r["tokens"] <= 120 or len(told) - r["repeated"] == 1
        assert len(r["loss"]) == sum(role == "assistant" for role, _ in told[r["repeated"] :])
    assert first == 61 and any(r["repeated"] > 1 for r in one)
    back = {r["conv_id"]: r["n_turns"] for r in chat.read_back(spark.createDataFrame(made, chat.WINDOWS)).collect()}
    assert back == {1: 61, 2: 2, None: 1}
    assert {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=120, history=50), in_order=True).collect()} == back
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.windows(none)).count() == 0


def test_chat_tokens_are_ids(spark):
    coder = bpe.Encoder(queries.tokenizer())
    rows = [(1, i, "user" if i % 2 else "assistant", "今天天气很好 " * 8 + f"tokenization {i}") for i in range(30)] + [(1, 30, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(turns, budget=400, history=150, tokenizer=queries.tokenizer()).collect()
    assert len(made) > 3
    for r in made:
        told = chat.parse(r["text"])
        assert r["tokens"] == sum(len(x) // 4 + 2 for x in coder.batch([t.encode() for _, t in told]))
        assert r["tokens"] <= 400 or len(told) - r["repeated"] == 1
    out = chat.read_back(chat.windows(turns, tokenizer=queries.tokenizer()), in_order=True).first()
    assert out["formatted_chars"] == sum(len(r["text"]) for r in chat.windows(turns, tokenizer=queries.tokenizer()).collect())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language id", "exact dedup", "simhash near-dedup", "mixing", "bpe encoding"]
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = langid.fit(docs.where(~langid.held_out("doc_id")).select("doc_id", "text", "lang"))
    kept = {}
    for r in langid.predict(docs, model).collect():
        if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE:
            kept[r["doc_id"]] = rows[r["doc_id"]]
    groups = defaultdict(list)
    for d, r in kept.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"])].append((-len(r["text"]), d))
    left = sorted(min(g)[1] for g in groups.values())
    prints = {d: simhash.prints_of(kept[d]["text"].encode(), 5, corpus_pipeline.PRINTS, corpus_pipeline.BITS) for d in left}
    seen = []
    parent = {d: d for d in left}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in left:
        for e in seen:
            if any((a ^ b).bit_count() <= 4 for a, b in zip(prints[d], prints[e], strict=True)):
                parent[max(root(d), root(e))] = min(root(d), root(e))
        seen.append(d)
    single = [d for d in left if root(d) == d]
    mixed = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs.where(F.col("doc_id").isin(single))).collect() if r["taken"]}
    coder = bpe.Encoder(queries.tokenizer())
    want = sorted((d, coder.batch([kept[d]["text"].encode()])[0]) for d, n in mixed.items() for _ in range(n))
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_stages_take_edges(spark):
    rows = [(1, "the house and the garden with all that", "en", "a", 38), (1, "the house and the garden with all that", "en", "a", 38), (None, None, None, None, None), (2, "", "de", None, 0), (3, "die und der ist nicht", "de", "b", 21)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = []
    for table in (docs, docs.limit(0)):
        now = table
        for _, function in corpus_pipeline.STAGES:
            out = function(spark, now, SF)
            now = spark.createDataFrame(out.collect(), out.schema)
            found.append(sorted(str(r["doc_id"]) for r in now.collect()))
    # no text and no letters go; copies go; of two sources of 8 and 5 words the mix takes both once, and one again
    assert found[:3] == [["1", "1", "3"], ["1", "3"], ["1", "3"]] and found[5:] == [[]] * 5
    assert set(found[3]) == {"1", "3"} and found[4] == found[3]
    assert dedup.keep_first(docs).count() == 3


STRANGE = {
    "zh": "今天天气很好,我们一起去城市公园散步,然后回家吃饭,晚上看电影。", "ru": "Сегодня хорошая погода, и мы пошли гулять в городской парк вместе с друзьями.",
    "el": "Σήμερα ο καιρός είναι πολύ καλός και πήγαμε στο πάρκο με τους φίλους μας.", "pl": "Dzisiaj pogoda jest bardzo ładna i poszliśmy z przyjaciółmi do parku miejskiego",
    "fi": "Tänään on hyvä sää ja menimme ystävien kanssa kaupungin puistoon kävelemään", "consonants": "xkcd qwrtp zxcvb mnbvc lkjhg fdsqw rtypl kjhgf zxqwv bnmlk",
    "letters": "qzj vkxw bpfg jjq zrtk wvyx oqke mxz hgdq puvz kfj xbw", "code": "for (int i = 0; i < n; ++i) { if (buf[i] != 0x00) { ptr->next = malloc(sizeof(struct node)); } } #define MAX(a,b) ((a)>(b)?(a):(b))",
}
CLEAN = ["the", "the and with", "That it.", "der und die", "Von.", "des les", "los de la", "This is the house of my father and he was not there with them"]


def test_language_gate(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    have = [c for c in docs.columns if c not in ("doc_id", "text", "lang")]
    # no doc_id: these rows are never learned from
    extra = spark.createDataFrame([(None, t, None) for t in [*STRANGE.values(), *CLEAN]], "doc_id long, text string, lang string")
    every = docs.unionByName(extra.select("*", *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in have]).select(*docs.columns))
    kept = corpus_pipeline.identify(spark, every, "").select("doc_id", "text").collect()
    told = {r["text"] for r in kept if r["doc_id"] is None}
    assert told == {*CLEAN}
    lettered = [r["doc_id"] for r in docs.select("doc_id", "text").collect() if langid.HAS_LETTER.search(r["text"] or "")]
    assert sum(r["doc_id"] is not None for r in kept) >= 0.999 * len(lettered)
