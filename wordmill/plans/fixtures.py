"""Queries over small fixtures that stand here: operators whose input the driver's tables do not have (Chinese text,
dictionaries, tagged corpora, thesauri, model files), each with SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.functions import chars
from wordmill.operators import counts, evaluate, features, maxent, models, ner, neural, segment, senses, tokens, topics, vocab, windows
from wordmill.plans.catalogue import query
from wordmill.plans.staging import fresh_path, stage
from wordmill.sources import corpus


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, list):
        return "[" + ", ".join(map(literal, x)) + "]"
    return f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else str(x)


def given(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression with these rows."""
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"


def files(spark: SparkSession, contents: dict[str, str | bytes]) -> str:
    """The contents as files of a fresh folder that all executors see."""
    folder = fresh_path(spark, "files")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, data in contents.items():
        out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
        out.write(bytearray(data.encode() if isinstance(data, str) else data))
        out.close()
    return folder


def lines_sql(contents: dict[str, str]) -> str:
    """line(file, v): the lines of these files, carriage returns taken off."""
    return given("f", "file, content", list(contents.items())) + ", line AS (SELECT file, regexp_replace(unnest(string_split(content, chr(10))), '\\r$', '') AS v FROM f)"


# ---- corpora of lines
CORPUS = {"sport.txt": "球队 赢得 比赛\n\n他们 输掉 决赛\r\n  \nthe team won\n", "news.txt": "经济 增长 很快\n今天 天气 好\n", "news_p.txt": "经济 增长\n 增长 经济 增长 \n\n", "sport_p.txt": "球队 比赛\n", "notes.md": "不 是 语料\n"}
POSITIVE_LINES, NEGATIVE_LINES = "好 很 好\n喜欢\n\n", "不 好\n讨厌 不\n"
BRACKETS = "[体育,新闻]球队赢得比赛\n没有标签的文本\n[短]\n[空] !!!\n[长]" + "长" * 520 + "\n[刚好] " + "好" * 512 + "\n"
WORDS = "的\n# 注释\n\n 了 \n是\n"


@query("source_labelled", f"WITH {lines_sql(CORPUS)} SELECT regexp_replace(file, '\\.[^.]*$', '') AS label, v AS text FROM line WHERE trim(v) <> '' AND file LIKE '%.txt' AND NOT file LIKE '%\\_p.txt' ESCAPE '\\'")
def source_labelled(spark, sf_dir):
    broken = CORPUS | {"sport.txt": CORPUS["sport.txt"].encode() + b"\xff\xfe broken \xe4\xb8\n"}  # the undecodable line is skipped
    return corpus.labelled(spark, files(spark, broken))


@query("source_tokenised", f"WITH {lines_sql(CORPUS)}, t AS (SELECT regexp_replace(file, '_p\\.txt$', '') AS label, list_filter(string_split_regex(v, '\\s+'), lambda w: w <> '') AS words FROM line WHERE file LIKE '%\\_p.txt' ESCAPE '\\') SELECT label, array_to_string(words, '|') AS words FROM t WHERE len(words) > 0")
def source_tokenised(spark, sf_dir):
    return corpus.tokenised(spark, files(spark, CORPUS)).withColumn("words", F.array_join("words", "|"))


@query("source_polarity", f"WITH {lines_sql({'pos': POSITIVE_LINES, 'neg': NEGATIVE_LINES})}, t AS (SELECT file AS label, unnest(list_filter(string_split_regex(v, '\\s+'), lambda w: w <> '')) AS word FROM line) SELECT label, word, count(*) AS n FROM t GROUP BY ALL")
def source_polarity(spark, sf_dir):
    folder = files(spark, {"pos": POSITIVE_LINES, "neg": NEGATIVE_LINES})
    return counts.occurrences(tokens.explode_tokens(corpus.polarity(spark, f"{folder}/pos", f"{folder}/neg"), F.col("words"), "label"), "label")


@query("source_brackets", f"WITH {lines_sql({'b': BRACKETS})}, t AS (SELECT trim(v) AS v, regexp_extract(trim(v), '^\\[(.+?)\\](.+)', 1) AS l, trim(regexp_extract(trim(v), '^\\[(.+?)\\](.+)', 2)) AS b FROM line), r AS (SELECT CASE WHEN l = '' THEN NULL ELSE l END AS labels, CASE WHEN l = '' THEN v ELSE b END AS text FROM t) SELECT labels, text FROM r WHERE length(text) <= 512 AND regexp_matches(text, '\\p{{L}}')")
def source_brackets(spark, sf_dir):
    return corpus.multi_labelled(spark, files(spark, {"b": BRACKETS})).select(F.array_join("labels", ",").alias("labels"), "text")


@query("source_word_lists", f"WITH {lines_sql({'w': WORDS})} SELECT 'list' AS kind, trim(v) AS word FROM line WHERE trim(v) <> '' AND NOT starts_with(trim(v), '#') UNION ALL SELECT 'raw', v FROM (SELECT v, row_number() OVER () AS i, count(*) OVER () AS n FROM line) WHERE i < n UNION ALL SELECT DISTINCT 'first', substr(v, 1, 1) FROM line WHERE v <> ''")
def source_word_lists(spark, sf_dir):
    folder = files(spark, {"w": WORDS})
    named = lambda rows, kind, column="word": rows.select(F.lit(kind).alias("kind"), F.col(column).alias("word"))
    return named(corpus.word_list(spark, folder), "list").unionByName(named(corpus.raw_word_list(spark, folder), "raw")).unionByName(named(corpus.characters(spark, folder), "first", "ch"))


# ---- lexicons and models
LEXICON_LINES = "今天 20 t\n天气 30 n\n好 15 a\n天 5 n\n北京 12 ns\n北京大学 8 nt\n大学 10 n\n大学生 6 n\n生活 9 vn\n学生 7 n\n我 25 r\n喜欢 14 v\n"
USER_LINES = "好 x\n云计算\n"
LEX = [(w, int(n), t) for w, n, t in (x.split() for x in LEXICON_LINES.split("\n") if x)]
SENTENCES = [(1, "今天天气好"), (2, "我喜欢北京大学生活"), (3, "大学生活好"), (4, "今天北京，天气好。"), (5, "喜欢学生"), (6, "天天"), (7, "云计算好"), (8, "")]
IDF_LINES = "今天 2.5\n天气 1.5\n坏 行 3\n好 0.5\n"
LEXICON_SQL = given("lex", "word, freq, tag", LEX) + ", weighted AS (SELECT word, ln(freq / CAST(sum(freq) OVER () AS DOUBLE)) AS weight, tag FROM lex)"


@query("source_lexicon", f"WITH {LEXICON_SQL}, {given('own', 'word, tag', [('好', 'x'), ('云计算', '')])}, every AS (SELECT word, weight, tag, false AS own FROM weighted WHERE word NOT IN (SELECT word FROM own) UNION ALL SELECT word, (SELECT max(weight) FROM weighted), tag, true FROM own) SELECT word, round(weight, 9) AS weight, tag, own FROM every")
def source_lexicon(spark, sf_dir):
    folder = files(spark, {"lexicon": LEXICON_LINES, "user": USER_LINES})
    words = corpus.lexicon_weights(corpus.lexicon(spark, f"{folder}/lexicon"))
    return corpus.with_user_words(words, corpus.user_lexicon(spark, f"{folder}/user")).withColumn("weight", F.round("weight", 9))


@query("source_first_char", f"WITH {given('w', 'word', [(w,) for w, _, _ in LEX] + [('abc',), ('天A',)])} SELECT substr(word, 1, 1) AS ch, string_agg(word, ' ' ORDER BY word) AS words FROM w WHERE regexp_full_match(word, '[\\x{{4E00}}-\\x{{9FBB}}]+') GROUP BY 1")
def source_first_char(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w, _, _ in LEX] + [("abc",), ("天A",)], "word string")
    return corpus.first_char_index(words).withColumn("words", F.array_join("words", " "))


@query("source_idf", f"WITH {lines_sql({'i': IDF_LINES})}, p AS (SELECT string_split(v, ' ') AS p FROM line), i AS (SELECT p[1] AS word, CAST(p[2] AS DOUBLE) AS idf FROM p WHERE len(p) = 2) SELECT word, idf, round((SELECT avg(idf) FROM i), 9) AS mean, round((SELECT sum(idf) FROM i) / 4, 9) AS old_mean FROM i")
def source_idf(spark, sf_dir):
    folder = files(spark, {"i": IDF_LINES})
    mean, old = corpus.average_idf(spark, folder), corpus.average_idf(spark, folder, compat=True)
    return corpus.idf_list(spark, folder).select("word", "idf", F.round(F.lit(mean), 9).alias("mean"), F.round(F.lit(old), 9).alias("old_mean"))


CHARACTERS = sorted({c for _, t in SENTENCES for c in t if c not in "，。"})
TAGS = "BEMS"
#: A smooth model: B and M go to E or M, E and S go to B or S; emissions differ by character and tag.
START = {"B": -0.6, "E": segment.MIN_LOG, "M": segment.MIN_LOG, "S": -0.8}
TRANS = {"B": {"B": segment.MIN_LOG, "E": -0.5, "M": -0.93, "S": segment.MIN_LOG}, "E": {"B": -0.59, "E": segment.MIN_LOG, "M": segment.MIN_LOG, "S": -0.81}, "M": {"B": segment.MIN_LOG, "E": -0.33, "M": -1.26, "S": segment.MIN_LOG}, "S": {"B": -0.73, "E": segment.MIN_LOG, "M": segment.MIN_LOG, "S": -0.66}}
EMIT = {t: {c: -2.0 - ((i * 7 + k * 11) % 23) / 10 - i / 1000 for i, c in enumerate(CHARACTERS)} for k, t in enumerate(TAGS)}
HMM_LINES = "\n".join(["# start, transitions, emissions", " ".join(str(START[t]) for t in TAGS), *(" ".join(str(TRANS[a][b]) for b in TAGS) for a in TAGS), *(",".join(f"{c}:{v}" for c, v in EMIT[t].items()) for t in TAGS)])


def own_lexicon() -> segment.Lexicon:
    return segment.Lexicon.of(LEX)


def sentences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SENTENCES, "id int, text string")


# the parts of a text between special symbols; every path through a part's dictionary words and single characters
PART_SQL = LEXICON_SQL + ", " + given("sentence", "id, text", SENTENCES) + """, part AS (SELECT id, unnest(ps) AS text, generate_subscripts(ps, 1) AS k FROM (SELECT id, regexp_extract_all(text, '[ \\t\\n。，]|[^ \\t\\n。，]+') AS ps FROM sentence)),
piece AS (SELECT DISTINCT text FROM part), least AS (SELECT min(weight) AS least FROM weighted),
edge AS (SELECT text, i, j, CAST(substr(text, CAST(i + 1 AS BIGINT), CAST(j - i AS BIGINT)) AS VARCHAR) AS word FROM (SELECT text, i, unnest(range(i + 1, length(text) + 1)) AS j FROM (SELECT text, unnest(range(0, length(text))) AS i FROM piece))),
step AS (SELECT text, i, j, edge.word, coalesce(weight, (SELECT least FROM least)) AS weight, weight IS NOT NULL AS known FROM edge LEFT JOIN weighted ON weighted.word = edge.word WHERE j = i + 1 OR weight IS NOT NULL),
path AS (SELECT text, 0 AS pos, CAST([] AS VARCHAR[]) AS words, CAST([] AS BIGINT[]) AS sizes, CAST(0 AS DOUBLE) AS total FROM piece
 UNION ALL SELECT path.text, step.j, list_append(path.words, step.word), list_append(path.sizes, step.j - step.i), path.total + step.weight FROM path JOIN step ON step.text = path.text AND step.i = path.pos),
whole AS (SELECT * FROM path WHERE pos = length(text)),
mp AS (SELECT text, words FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY round(total, 9) DESC, sizes) AS r FROM whole) WHERE r = 1)"""
HMM_SQL = given("start", "tag, p", list(START.items())) + ", " + given("trans", "a, b, p", [(a, b, p) for a, row in TRANS.items() for b, p in row.items()]) + ", " + given("emit", "tag, ch, p", [(t, c, p) for t, row in EMIT.items() for c, p in row.items()]) + """,
tagged AS (SELECT text, 1 AS pos, start.tag AS tags, start.tag AS last, start.p + emit.p AS total FROM run JOIN start ON true JOIN emit ON emit.tag = start.tag AND emit.ch = substr(text, 1, 1)
 UNION ALL SELECT text, pos + 1, tags || trans.b, trans.b, total + trans.p + emit.p FROM tagged JOIN trans ON trans.a = tagged.last JOIN emit ON emit.tag = trans.b AND emit.ch = substr(text, pos + 1, 1) WHERE pos < length(text) AND trans.p > -1e100 AND total > -1e100),
viterbi AS (SELECT text, tags FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY round(total, 9) DESC, tags) AS r FROM tagged WHERE pos = length(text) AND last IN ('E', 'S')) WHERE r = 1),
cut AS (SELECT text, array_to_string(list_transform(range(1, length(text) + 1), lambda i: substr(text, i, 1) || CASE WHEN substr(tags, i, 1) IN ('E', 'S') THEN '|' ELSE '' END), '') AS words FROM viterbi)"""


def shown(cut) -> DataFrame:
    return cut.select("id", F.array_join("words", "|").alias("words"))


@query("cjk_mp_segment", f"WITH RECURSIVE {PART_SQL} SELECT sentence.id, coalesce(w, '') AS words FROM sentence LEFT JOIN (SELECT id, string_agg(array_to_string(words, '|'), '|' ORDER BY k) AS w FROM part JOIN mp USING (text) GROUP BY id) USING (id)")
def cjk_mp_segment(spark, sf_dir):
    return shown(sentences(spark).select("id", segment.segment(spark, "mp", own_lexicon())("text").alias("words")))


@query("cjk_hmm_segment", f"WITH RECURSIVE {given('sentence', 'id, text', SENTENCES)}, part AS (SELECT id, unnest(ps) AS text, generate_subscripts(ps, 1) AS k FROM (SELECT id, regexp_extract_all(text, '[ \\t\\n。，]|[^ \\t\\n。，]+') AS ps FROM sentence)), run AS (SELECT DISTINCT text FROM part WHERE text NOT IN ('，', '。')), {HMM_SQL} SELECT sentence.id, coalesce(w, '') AS words FROM sentence LEFT JOIN (SELECT id, string_agg(coalesce(rtrim(words, '|'), part.text), '|' ORDER BY k) AS w FROM part LEFT JOIN cut USING (text) GROUP BY id) USING (id)")
def cjk_hmm_segment(spark, sf_dir):
    hmm = corpus.hmm_model(spark, files(spark, {"hmm": HMM_LINES}))
    return shown(sentences(spark).select("id", segment.segment(spark, "hmm", own_lexicon(), hmm)("text").alias("words")))


@query("cjk_mix_segment", f"WITH RECURSIVE {PART_SQL}, w AS (SELECT id, k, i, word, CASE WHEN length(word) = 1 AND word NOT IN ('，', '。') THEN 1 ELSE 0 END AS one FROM (SELECT id, k, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM part JOIN mp USING (text))), g AS (SELECT *, sum(CASE WHEN one = 1 AND before = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY id, k ORDER BY i) AS g FROM (SELECT *, coalesce(lag(one) OVER (PARTITION BY id, k ORDER BY i), 0) AS before FROM w)), grp AS (SELECT id, k, g, one, string_agg(word, '' ORDER BY i) AS text FROM g GROUP BY ALL), run AS (SELECT DISTINCT text FROM grp WHERE one = 1), {HMM_SQL} SELECT sentence.id, coalesce(ws, '') AS words FROM sentence LEFT JOIN (SELECT id, string_agg(CASE WHEN one = 1 THEN rtrim(words, '|') ELSE grp.text END, '|' ORDER BY k, g) AS ws FROM grp LEFT JOIN cut USING (text) GROUP BY id) USING (id)")
def cjk_mix_segment(spark, sf_dir):
    return shown(sentences(spark).select("id", segment.segment(spark, "mix", own_lexicon(), segment.parse_hmm(HMM_LINES))("text").alias("words")))


FULL_SQL = """longer AS (SELECT text, i, j, word FROM step WHERE j > i + 1 AND known),
found AS (SELECT * FROM longer UNION ALL SELECT text, i, j, word FROM step s WHERE j = i + 1 AND NOT EXISTS (SELECT 1 FROM longer l WHERE l.text = s.text AND l.i <= s.i AND l.j > s.i))"""


@query("cjk_full_segment", f"WITH RECURSIVE {PART_SQL}, {FULL_SQL} SELECT id, word, count(*) AS n FROM part JOIN found USING (text) GROUP BY id, word")
def cjk_full_segment(spark, sf_dir):
    cut = sentences(spark).select("id", F.explode(segment.segment(spark, "full", own_lexicon())("text")).alias("word"))
    return cut.groupBy("id", "word").agg(F.count("*").alias("n"))


# every word of the best path that is longer than three characters is replaced by all dictionary words in it (no single
# characters come next to each other in these sentences, so the HMM has nothing to cut)
DICTIONARY_TEXTS = [(1, "我喜欢北京大学"), (2, "北京大学天气好"), (3, "大学生喜欢今天")]
QUERY_SQL = PART_SQL.replace(given("sentence", "id, text", SENTENCES), given("sentence", "id, text", DICTIONARY_TEXTS)).replace("piece AS (SELECT DISTINCT text FROM part)", "piece AS (SELECT DISTINCT text FROM part UNION SELECT word FROM lex)")


@query("cjk_query_segment", f"WITH RECURSIVE {QUERY_SQL}, {FULL_SQL}, w AS (SELECT id, unnest(words) AS word FROM part JOIN mp USING (text)) SELECT id, word, count(*) AS n FROM (SELECT id, word FROM w WHERE length(word) <= 3 UNION ALL SELECT id, found.word FROM w JOIN found ON found.text = w.word WHERE length(w.word) > 3) GROUP BY id, word")
def cjk_query_segment(spark, sf_dir):
    lexicon, hmm = spark.sparkContext.broadcast(own_lexicon()), spark.sparkContext.broadcast(segment.parse_hmm(HMM_LINES))

    @F.pandas_udf("array<string>")
    def cut(texts):
        return texts.map(lambda t: segment.query(t, lexicon.value, hmm.value, longest=3))

    rows = spark.createDataFrame(DICTIONARY_TEXTS, "id int, text string")
    return rows.select("id", F.explode(cut("text")).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n"))


# level 0: the best path; a word of three or more characters is cut again with one character less allowed, and so on
@query("cjk_level_segment", f"""WITH RECURSIVE {LEXICON_SQL}, {given('sentence', 'id, text', DICTIONARY_TEXTS)}, least AS (SELECT min(weight) AS least FROM weighted),
piece AS (SELECT text, 512 AS cap FROM sentence UNION SELECT word, n FROM (SELECT word, unnest(range(2, length(word))) AS n FROM lex WHERE length(word) > 2)),
edge AS (SELECT text, cap, i, j, CAST(substr(text, CAST(i + 1 AS BIGINT), CAST(j - i AS BIGINT)) AS VARCHAR) AS word FROM (SELECT text, cap, i, unnest(range(i + 1, length(text) + 1)) AS j FROM (SELECT text, cap, unnest(range(0, length(text))) AS i FROM piece)) WHERE j - i <= cap),
step AS (SELECT text, cap, i, j, edge.word, coalesce(weight, (SELECT least FROM least)) AS weight FROM edge LEFT JOIN weighted ON weighted.word = edge.word WHERE j = i + 1 OR weight IS NOT NULL),
path AS (SELECT text, cap, 0 AS pos, CAST([] AS VARCHAR[]) AS words, CAST([] AS BIGINT[]) AS sizes, CAST(0 AS DOUBLE) AS total FROM piece
 UNION ALL SELECT path.text, path.cap, step.j, list_append(path.words, step.word), list_append(path.sizes, step.j - step.i), path.total + step.weight FROM path JOIN step ON step.text = path.text AND step.cap = path.cap AND step.i = path.pos),
mp AS (SELECT text, cap, unnest(words) AS word FROM (SELECT *, row_number() OVER (PARTITION BY text, cap ORDER BY round(total, 9) DESC, sizes) AS r FROM path WHERE pos = length(text)) WHERE r = 1),
lev AS (SELECT id, word, 0 AS level FROM sentence JOIN mp ON mp.text = sentence.text AND cap = 512 UNION ALL SELECT lev.id, mp.word, lev.level + 1 FROM lev JOIN mp ON mp.text = lev.word AND mp.cap = length(lev.word) - 1 WHERE length(lev.word) > 2)
SELECT id, word, level, count(*) AS n FROM lev WHERE length(word) > 1 GROUP BY ALL""")
def cjk_level_segment(spark, sf_dir):
    rows = spark.createDataFrame(DICTIONARY_TEXTS, "id int, text string")
    cut = rows.select("id", F.explode(segment.levels(spark, own_lexicon())("text")).alias("w")).select("id", "w.word", "w.level")
    return cut.groupBy("id", "word", "level").agg(F.count("*").alias("n"))


@query("cjk_all_segmentations", f"WITH RECURSIVE {PART_SQL} SELECT text, array_to_string(words, '|') AS words FROM whole WHERE text NOT IN ('，', '。')")
def cjk_all_segmentations(spark, sf_dir):
    segment.register_all_segmentations(spark, own_lexicon())
    parts = sentences(spark).select(F.explode(tokens.presplit(F.col("text"))).alias("text")).where(~F.col("text").isin("，", "。")).distinct()
    parts.createOrReplaceTempView("wordmill_parts")
    return spark.sql("SELECT text, array_join(words, '|') AS words FROM wordmill_parts, LATERAL all_segmentations(text)")


@query("cjk_least_surprise", f"WITH RECURSIVE {PART_SQL}, {given('emit', 'tag, ch, p', [(t, c, p) for t, row in EMIT.items() for c, p in row.items()])}, e AS (SELECT text, words, unnest(words) AS word FROM whole WHERE text NOT IN ('，', '。')), c AS (SELECT text, words, word, unnest(range(1, length(word) + 1)) AS i FROM e), s AS (SELECT text, words, sum(-p) AS cost FROM c JOIN emit ON ch = substr(word, i, 1) AND tag = CASE WHEN length(word) = 1 THEN 'S' WHEN i = 1 THEN 'B' WHEN i = length(word) THEN 'E' ELSE 'M' END GROUP BY text, words) SELECT text, round(min(cost), 6) AS cost FROM s GROUP BY text")
def cjk_least_surprise(spark, sf_dir):
    lexicon, hmm = spark.sparkContext.broadcast(own_lexicon()), spark.sparkContext.broadcast(segment.parse_hmm(HMM_LINES))

    @F.pandas_udf("array<string>")
    def choose(texts):
        return texts.map(lambda t: segment.least_surprise(segment.all_segmentations(t, lexicon.value), hmm.value))

    parts = sentences(spark).select(F.explode(tokens.presplit(F.col("text"))).alias("text")).where(~F.col("text").isin("，", "。")).distinct()
    emit = spark.createDataFrame([(t, c, -p) for t, row in EMIT.items() for c, p in row.items()], "tag string, ch string, cost double")
    each = parts.select("text", choose("text").alias("words")).select("text", F.explode(F.arrays_zip(windows.tag_sequence(F.col("words")).alias("tag"), F.split("text", "").alias("ch"))).alias("p")).select("text", "p.tag", "p.ch")
    return each.join(emit, ["tag", "ch"]).groupBy("text").agg(F.round(F.sum("cost"), 6).alias("cost"))


@query("cjk_classes", f"WITH {given('s', 'text', [(t,) for _, t in SENTENCES] + [('三人行',), ('23市',), ('五',), ('人',), ('a中',), ('中a',), ('éb',)])} SELECT text, regexp_full_match(text, '[\\x{{4E00}}-\\x{{9FBB}}]*') AS zh, regexp_full_match(text, '[\\x{{4E00}}-\\x{{9FBB}}]*') AND NOT regexp_matches(text, '[十百千万亿一二三四五六七八九零几]') AS zh_no_numbers, text IN ({', '.join(literal(c) for c in chars.ZH_NUMBERS)}) AS number, length(text) > 1 AND ascii(text) > 127 AS multibyte, CAST(len(regexp_extract_all(text, '[\\x{{4E00}}-\\x{{9FBB}}]')) AS INTEGER) AS n_zh, CAST(len(regexp_extract_all(text, '[，。]')) AS INTEGER) AS n_end FROM s")
def cjk_classes(spark, sf_dir):
    rows = spark.createDataFrame([(t,) for _, t in SENTENCES] + [("三人行",), ("23市",), ("五",), ("人",), ("a中",), ("中a",), ("éb",)], "text string")
    t = F.col("text")
    return rows.select("text", chars.is_zhs(t).alias("zh"), chars.is_zhs(t, no_numbers=True).alias("zh_no_numbers"), chars.is_zh_number(t).alias("number"), chars.is_multibyte_word(t).alias("multibyte"), chars.count_class(t, chars.ZH_RANGES).alias("n_zh"), chars.count_class(t, chars.TERMINATORS).alias("n_end"))


KEYWORD_TEXTS = [(1, "今天 天气 好 天气 北京大学"), (2, "北京 大学生 生活 生活 的 好"), (3, "云计算 今天")]


@query("cjk_keywords", f"WITH {given('d', 'id, text', KEYWORD_TEXTS)}, {given('idf', 'word, idf', [('今天', 2.5), ('天气', 1.5), ('好', 0.5)])}, t AS (SELECT id, unnest(string_split(text, ' ')) AS word FROM d), tf AS (SELECT id, word, count(*) AS tf FROM t WHERE length(word) > 1 AND word <> '北京' GROUP BY ALL), s AS (SELECT id, word, round(tf * coalesce(idf, (SELECT avg(idf) FROM idf)), 6) AS score FROM tf LEFT JOIN idf USING (word)), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, word) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 2")
def cjk_keywords(spark, sf_dir):
    words = tokens.explode_tokens(spark.createDataFrame(KEYWORD_TEXTS, "id int, text string"), tokens.whitespace_words(F.col("text")), "id")
    return features.keywords(words, "id", corpus.idf_list(spark, files(spark, {"i": IDF_LINES})), ["北京"], 2)


# ---- tagged corpora and entities
TAGGED = "张/nr 三/nr 在/p [北京/ns 大学/n]nt 学习/v 。/w\n李/nr 说/v Spark/nz 很/d 快/a\n  \n上海/ns 上海/ns 好/a\n"
TAG_SQL = lines_sql({"t": TAGGED}) + ", s AS (SELECT row_number() OVER () AS line, v FROM line WHERE trim(v) <> ''), p AS (SELECT line, unnest(ps) AS t, generate_subscripts(ps, 1) AS pos FROM (SELECT line, regexp_extract_all(v, '\\S+/\\S+') AS ps FROM s)), tok AS (SELECT line, pos, regexp_replace(regexp_replace(t, '\\](nt|nz)$', ''), '^\\[', '') AS t FROM p), wt AS (SELECT line, pos, regexp_extract(t, '^(.*)/[^/]*$', 1) AS word, regexp_extract(t, '/([^/]*)$', 1) AS tag FROM tok)"
CLASS_SQL = "CASE tag WHEN 'nr' THEN 'PER' WHEN 'ns' THEN 'LOC' WHEN 'nt' THEN 'ORG' WHEN 'nz' THEN 'MISC' ELSE 'N' END"


def tagged_tokens(spark: SparkSession) -> DataFrame:
    """line (the first word and its successor tell the lines of this fixture apart), pos, word, tag."""
    rows = corpus.tagged(spark, files(spark, {"t": TAGGED})).withColumn("line", F.when(F.col("tokens")[0]["word"] == "张", 1).when(F.col("tokens")[0]["word"] == "李", 2).otherwise(3))
    return rows.select("line", F.posexplode("tokens").alias("pos", "t")).select("line", (F.col("pos") + 1).alias("pos"), "t.word", "t.tag")


@query("ner_tagged", f"WITH {TAG_SQL} SELECT line, pos, word, tag, {CLASS_SQL} AS class FROM wt")
def ner_tagged(spark, sf_dir):
    return tagged_tokens(spark).withColumn("class", ner.entity_class(F.col("tag")))


@query("ner_bio", f"WITH {TAG_SQL}, c AS (SELECT line, pos, word, tag, unnest(range(1, length(word) + 1)) AS i FROM wt), l AS (SELECT substr(word, i, 1) AS ch, i, {CLASS_SQL} AS k FROM c) SELECT ch, CASE WHEN k = 'N' THEN 'N' WHEN i = 1 THEN 'B-' || k ELSE 'I-' || k END AS label, count(*) AS n FROM l GROUP BY ALL")
def ner_bio(spark, sf_dir):
    return ner.bio(tagged_tokens(spark)).groupBy("ch", "label").agg(F.count("*").alias("n"))


@query("ner_merged_lines", f"WITH {TAG_SQL}, e AS (SELECT *, CASE WHEN tag IN ('nr', 'ns', 'nt', 'nz') AND tag = lag(tag) OVER (PARTITION BY line ORDER BY pos) THEN 0 ELSE 1 END AS opens FROM wt), g AS (SELECT *, sum(opens) OVER (PARTITION BY line ORDER BY pos) AS g FROM e), m AS (SELECT line, g, min(pos) AS pos, string_agg(word, '' ORDER BY pos) AS word, any_value(tag) AS tag FROM g GROUP BY line, g) SELECT line, string_agg(CASE WHEN {CLASS_SQL} = 'N' THEN word ELSE word || '/' || {CLASS_SQL} END, ' ' ORDER BY pos) AS text FROM m GROUP BY line")
def ner_merged_lines(spark, sf_dir):
    merged = ner.merge_entities(tagged_tokens(spark), "line").withColumnRenamed("first_pos", "pos").withColumnRenamed("line", "id")
    return ner.render(merged, "id").select(F.col("id").alias("line"), F.col("line").alias("text"))


ATTRIBUTE_SQL = "'w[-2]=' || coalesce(b2, '*') || ' w[-1]=' || coalesce(b1, '*') || ' w[-1]|w[0]=' || coalesce(b1, '*') || '|' || word || ' w[0]=' || word || ' w[1]=' || coalesce(a1, '*') || ' w[0]|w[1]=' || word || '|' || coalesce(a1, '*') || ' w[2]=' || coalesce(a2, '*')"


@query("ner_attributes", f"WITH {TAG_SQL}, l AS (SELECT *, lag(word, 1) OVER z AS b1, lag(word, 2) OVER z AS b2, lead(word, 1) OVER z AS a1, lead(word, 2) OVER z AS a2 FROM wt WINDOW z AS (PARTITION BY line ORDER BY pos)) SELECT 'edges' AS kind, line, pos, {ATTRIBUTE_SQL} AS feats FROM l UNION ALL SELECT 'interior', line, pos, {ATTRIBUTE_SQL} FROM l WHERE b2 IS NOT NULL AND a2 IS NOT NULL")
def ner_attributes(spark, sf_dir):
    words = tagged_tokens(spark)
    told = lambda kind, edge: windows.attributes(words, "line", edge).select(F.lit(kind).alias("kind"), "line", "pos", F.array_join("feats", " ").alias("feats"))
    return told("edges", "*").unionByName(told("interior", None))


@query("ner_attribute_sink", f"WITH {TAG_SQL}, l AS (SELECT *, lag(word, 1) OVER z AS b1, lag(word, 2) OVER z AS b2, lead(word, 1) OVER z AS a1, lead(word, 2) OVER z AS a2 FROM wt WINDOW z AS (PARTITION BY line ORDER BY pos)) SELECT tag || chr(9) || replace({ATTRIBUTE_SQL}, ' ', chr(9)) AS value FROM l")
def ner_attribute_sink(spark, sf_dir):
    path = fresh_path(spark, "attributes")
    corpus.write_attributes(windows.attributes(tagged_tokens(spark), "line"), path, "tag")
    return spark.read.text(path)


CHAR_TAGS = "今 B\n天 E\n\n好 S\n北 B\n京 E\n"


@query("source_char_tags", f"WITH {lines_sql({'c': CHAR_TAGS})} SELECT string_split(v, ' ')[1] AS ch, string_split(v, ' ')[2] AS tag, count(*) AS n FROM line WHERE trim(v) <> '' GROUP BY ALL")
def source_char_tags(spark, sf_dir):
    return corpus.char_tags(spark, files(spark, {"c": CHAR_TAGS})).groupBy("ch", "tag").agg(F.count("*").alias("n"))


PROBABILITIES = [(1, [[0.1, 0.8, 0.05, 0.05], [0.3, 0.2, 0.4, 0.1], [0.2, 0.3, 0.3, 0.2], [0.6, 0.1, 0.1, 0.2]]), (2, [[0.2, 0.1, 0.1, 0.6], [0.5, 0.4, 0.05, 0.05], [0.1, 0.2, 0.6, 0.1], [0.0, 0.7, 0.2, 0.1], [0.3, 0.1, 0.3, 0.3]]), (3, [[0.25, 0.25, 0.25, 0.25]])]


@query("constrained_decode", f"""WITH RECURSIVE {given('p', 'id, i, b, e, m, s', [(k, i + 1, *map(float, row)) for k, rows in PROBABILITIES for i, row in enumerate(rows)])},
d AS (SELECT id, i, CASE WHEN b >= s THEN 'B' ELSE 'S' END AS tag FROM p WHERE i = 1
 UNION ALL SELECT p.id, p.i, CASE WHEN d.tag IN ('B', 'M') THEN CASE WHEN p.e >= p.m THEN 'E' ELSE 'M' END ELSE CASE WHEN p.b >= p.s THEN 'B' ELSE 'S' END END FROM d JOIN p ON p.id = d.id AND p.i = d.i + 1)
SELECT id, string_agg(tag, '' ORDER BY i) AS tags FROM d GROUP BY id""")
def constrained_decode(spark, sf_dir):
    rows = spark.createDataFrame(PROBABILITIES, "id int, p array<array<double>>")
    return rows.select("id", F.array_join(windows.constrained_decode(F.col("p")), "").alias("tags"))


# ---- thesauri and word senses
BLOCKS = "[DDv 打]\n【攻击=】 击 揍\n#例句：他～人|不要～狗\n【购买=】 买 购\n#例句：～酱油丨去～酒\n\n[DDv 看]\n【观察=】 望 瞧\n#例句：～书\n其他\n"
THESAURUS_LINES = "v 【攻击.=】 击 揍\nn 【东西.=】 物 品\nv 【空.=】\nv 【购买=】 买 购\nv 【观察.=】 望 瞧 看\n"
UNIQUE_LINES = "打|【攻击=】 击\n看|【观察=】 望【另=】 瞧\n买|【购买=】 购\n走|没有\n"
BLOCK_ROWS = [("打", "攻击", ["击", "揍"], ["他打人", "不要打狗"]), ("打", "购买", ["买", "购"], ["打酱油", "去打酒"]), ("看", "观察", ["望", "瞧"], ["看书"])]


@query("source_thesaurus", f"WITH {given('b', 'word, sense, synonyms, examples', BLOCK_ROWS)} SELECT word, sense, array_to_string(synonyms, ' ') AS synonyms, array_to_string(examples, '|') AS examples FROM b")
def source_thesaurus(spark, sf_dir):
    return corpus.thesaurus(spark, files(spark, {"t": BLOCKS})).select("word", "sense", F.array_join("synonyms", " ").alias("synonyms"), F.array_join("examples", "|").alias("examples"))


@query("source_thesaurus_words", f"WITH {given('b', 'word, sense, synonyms, examples', BLOCK_ROWS)} SELECT DISTINCT word FROM (SELECT word FROM b UNION ALL SELECT unnest(synonyms) FROM b)")
def source_thesaurus_words(spark, sf_dir):
    return corpus.thesaurus_words(corpus.thesaurus(spark, files(spark, {"t": BLOCKS})))


@query("source_thesaurus_lines", f"WITH {lines_sql({'t': THESAURUS_LINES})}, p AS (SELECT string_split_regex(trim(v), '\\s+') AS p FROM line) SELECT p[1] AS pos, regexp_extract(p[2], '【(.+)\\.=】', 1) AS sense, unnest(p[3:]) AS synonym FROM p WHERE len(p) >= 3 AND p[1] = 'v' AND regexp_matches(p[2], '【.+\\.=】')")
def source_thesaurus_lines(spark, sf_dir):
    return corpus.thesaurus_lines(spark, files(spark, {"t": THESAURUS_LINES}))


@query("source_unique_senses", f"WITH {lines_sql({'u': UNIQUE_LINES})} SELECT DISTINCT string_split(v, '|')[1] AS word FROM line WHERE len(regexp_extract_all(v, '=】')) = 1 AND string_split(v, '|')[1] IN ('打', '看', '走')")
def source_unique_senses(spark, sf_dir):
    return corpus.unique_senses(spark, files(spark, {"u": UNIQUE_LINES}), spark.createDataFrame([("打",), ("看",), ("走",)], "word string"))


@query("thesaurus_index", f"WITH {given('b', 'word, sense, synonyms, examples', BLOCK_ROWS + [('买', '购买', ['购'], ['买书', '买书'])])}, s AS (SELECT word, sense, unnest(synonyms) AS synonym FROM b), many AS (SELECT word FROM b GROUP BY word HAVING count(DISTINCT sense) > 1), x AS (SELECT word, sense, unnest(examples) AS example FROM b) SELECT 'heads' AS kind, synonym AS word, string_agg(DISTINCT word, ' ' ORDER BY word) AS listed FROM s GROUP BY synonym UNION ALL SELECT 'polysemous', word, '' FROM many UNION ALL SELECT 'examples', word || ' ' || sense, string_agg(example, '|' ORDER BY example) FROM x GROUP BY word, sense")
def thesaurus_index(spark, sf_dir):
    rows = spark.createDataFrame(BLOCK_ROWS + [("买", "购买", ["购"], ["买书", "买书"])], "word string, sense string, synonyms array<string>, examples array<string>")
    synonyms = rows.select("word", "sense", F.explode("synonyms").alias("synonym"))
    heads = counts.inverted_index(synonyms, "word", "synonym").select(F.lit("heads").alias("kind"), F.col("synonym").alias("word"), F.array_join("heads", " ").alias("listed"))
    many = senses.polysemous(rows).select(F.lit("polysemous").alias("kind"), "word", F.lit("").alias("listed"))
    told = corpus.gather_examples(rows.select("word", "sense", F.explode("examples").alias("example"))).select(F.lit("examples").alias("kind"), F.concat_ws(" ", "word", "sense").alias("word"), F.array_join("examples", "|").alias("listed"))
    return heads.unionByName(many).unionByName(told)


SENSE_TEXTS = [(1, "a x t y b"), (2, "a x s1 y b"), (3, "c x s2 y d"), (4, "p t q"), (5, "e t"), (6, "x s3 y z w"), (7, "a x t y b t"), (8, "q x s1 y b s2 y d")]
SENSE_WORDS = [("t", "A", "s1"), ("t", "A", "s2"), ("t", "B", "s3"), ("t", "B", "t")]
SENSE_TRUTH = [(1, "t", "A"), (4, "t", "A"), (5, "t", "B"), (7, "t", "B")]
ONE_SHOT = f"""WITH {given('d', 'id, text', SENSE_TEXTS)}, {given('th', 'word, sense, synonym', SENSE_WORDS)}, {given('truth', 'id, word, sense', SENSE_TRUTH)},
tk AS (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM (SELECT id, string_split(text, ' ') AS ws FROM d)),
l AS (SELECT *, lag(word, 1) OVER z AS b1, lag(word, 2) OVER z AS b2, lead(word, 1) OVER z AS a1, lead(word, 2) OVER z AS a2 FROM tk WINDOW z AS (PARTITION BY id ORDER BY pos)),
c AS (SELECT id, n, pos, word, coalesce(b1, '*') AS prev, coalesce(a1, '*') AS next FROM l WHERE b1 IS NOT NULL OR a1 IS NOT NULL UNION ALL SELECT id, n, pos, word, b2, b1 FROM l WHERE b2 IS NOT NULL UNION ALL SELECT id, n, pos, word, a1, a2 FROM l WHERE a2 IS NOT NULL),
cnt AS (SELECT prev, next, word AS synonym, count(*) / CAST(sum(count(*)) OVER (PARTITION BY prev, next) AS DOUBLE) AS share FROM c WHERE word IN ('t', 's1', 's2', 's3') AND NOT (prev = '*' AND next = 'y') AND NOT (next = '*' AND prev = 'y') GROUP BY prev, next, word),
occ AS (SELECT id, prev, next, word FROM c WHERE word = 't' AND n >= 5 AND pos = (SELECT min(pos) FROM tk WHERE tk.id = c.id AND tk.word = 't') AND NOT (prev = '*' AND next = 'y') AND NOT (next = '*' AND prev = 'y')),
sz AS (SELECT word, sense, count(DISTINCT synonym) AS size FROM th GROUP BY ALL),
hit AS (SELECT id, th.word, sense, sum(share) AS s, count(*) AS hits FROM occ JOIN cnt USING (prev, next) JOIN th ON th.word = occ.word AND th.synonym = cnt.synonym WHERE th.synonym <> th.word GROUP BY ALL),
sc AS (SELECT o.id, o.word, sz.sense, coalesce(s * hits / CAST(size AS DOUBLE), 0) AS score FROM (SELECT DISTINCT id, word FROM occ) o JOIN sz USING (word) LEFT JOIN hit ON hit.id = o.id AND hit.word = o.word AND hit.sense = sz.sense),
best AS (SELECT id, word, CASE WHEN score = 0 THEN '_UNDEFINE_' ELSE sense END AS sense, score FROM (SELECT *, row_number() OVER (PARTITION BY id, word ORDER BY round(score, 9) DESC, sense) AS r FROM sc) WHERE r = 1)"""


def one_shot(spark: SparkSession) -> DataFrame:
    docs = spark.createDataFrame(SENSE_TEXTS, "id int, text string")
    known = spark.createDataFrame(SENSE_WORDS, "word string, sense string, synonym string")
    words = tokens.whitespace_words(F.col("text"))
    triples = senses.suppress_half_padded(counts.contexts_of(docs, words, "id", ["t", "s1", "s2", "s3"]), ["y"])
    return senses.one_shot(docs.select("id", words.alias("words")), counts.context_counts(triples), known, "id", ["t"], ["y"])


@query("sense_one_shot", ONE_SHOT + " SELECT id, word, sense, round(score, 6) AS score FROM best")
def sense_one_shot(spark, sf_dir):
    return one_shot(spark).withColumn("score", F.round("score", 6))


@query("sense_evaluation", ONE_SHOT + " SELECT count(*) AS n, CAST(coalesce(sum(CASE WHEN best.sense = truth.sense THEN 1 ELSE 0 END), 0) AS BIGINT) AS good FROM best JOIN truth USING (id, word) WHERE best.sense <> '_UNDEFINE_'")
def sense_evaluation(spark, sf_dir):
    return senses.evaluate(one_shot(spark), spark.createDataFrame(SENSE_TRUTH, "id int, word string, sense string"), ["id"]).withColumn("good", F.coalesce("good", F.lit(0)))


@query("sense_evidence", ONE_SHOT.replace("best AS (", "unused AS (SELECT 1), best AS (") + ", cn AS (SELECT prev, next, word AS synonym, count(*) AS n FROM c WHERE word IN ('t', 's1', 's2', 's3') AND NOT (prev = '*' AND next = 'y') AND NOT (next = '*' AND prev = 'y') GROUP BY ALL) SELECT c.id, th.word, th.sense, th.synonym, c.prev, c.next, cn.n FROM (SELECT * FROM c WHERE word = 't') c JOIN cn USING (prev, next) JOIN th ON th.word = 't' AND th.synonym = cn.synonym WHERE th.synonym <> th.word")
def sense_evidence(spark, sf_dir):
    docs, words = spark.createDataFrame(SENSE_TEXTS, "id int, text string"), tokens.whitespace_words(F.col("text"))
    known = spark.createDataFrame(SENSE_WORDS, "word string, sense string, synonym string")
    triples = counts.contexts_of(docs, words, "id", ["t", "s1", "s2", "s3"])
    return senses.evidence(triples.where("word = 't'"), counts.context_counts(senses.suppress_half_padded(triples, ["y"])), known, ["id"])


@query("sense_report", f"WITH {given('b', 'word, sense, synonyms, examples', BLOCK_ROWS)} SELECT '[[' || word || ']]' || string_agg('  ' || sense || ' :: ' || array_to_string(synonyms, ' ') || ' :: ' || array_to_string(examples, ' | ') || ' :: ' || examples[1], '' ORDER BY sense) AS value FROM b GROUP BY word")
def sense_report(spark, sf_dir):
    path = fresh_path(spark, "senses")
    rows = corpus.thesaurus(spark, files(spark, {"t": BLOCKS}))
    corpus.write_senses(rows.withColumn("more", F.slice("examples", 1, 1)), path)
    return spark.read.text(path)


# ---- sinks, sections, settings
PAIRS = [("sport", "球队", "比赛", 3), ("news", "经济", "增长", 2)]


@query("sink_pairs", f"WITH {given('p', 'label, w1, w2, n', PAIRS)} SELECT label || chr(9) || w1 || '~' || w2 || chr(9) || n AS value FROM p UNION ALL SELECT w1 || chr(9) || w2 || '[' || label || ']:' || n FROM p UNION ALL SELECT 'TAG:' || label || ':' || chr(9) || w1 || '-' || w2 || ':' || n FROM p")
def sink_pairs(spark, sf_dir):
    rows, paths = spark.createDataFrame(PAIRS, "label string, w1 string, w2 string, n int"), []
    for layout in corpus.PAIR_LAYOUTS:
        paths.append(fresh_path(spark, "pairs"))
        corpus.write_pairs(rows, paths[-1], layout)
    return spark.read.text(paths)


@query("sink_tokenised", f"WITH {given('d', 'id, text', KEYWORD_TEXTS)}, w AS (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT id, string_split(text, ' ') AS ws FROM d)), u AS (SELECT id, word, min(i) AS i FROM w GROUP BY id, word) SELECT string_agg(word, ' ' ORDER BY i) AS value FROM u GROUP BY id")
def sink_tokenised(spark, sf_dir):
    path = fresh_path(spark, "tokenised")
    rows = spark.createDataFrame([*KEYWORD_TEXTS, (9, " "), (10, None)], "id int, text string").select(tokens.whitespace_words(F.col("text")).alias("words"))
    corpus.write_tokenised(rows, path)
    return spark.read.text(path)


@query("sink_normalised", f"WITH {given('t', 'id, pos, word', [(1, 1, '今天'), (1, 2, '，'), (1, 3, 'abc'), (1, 4, '!'), (1, 5, '好'), (2, 1, '12')])} SELECT id, string_agg(CASE WHEN regexp_full_match(word, '[\\x{{4E00}}-\\x{{9FBB}}]+') THEN word WHEN word IN ('，', '!') THEN '_E_' ELSE '_P_' END, ' ' ORDER BY pos) AS line FROM t GROUP BY id")
def sink_normalised(spark, sf_dir):
    rows = spark.createDataFrame([(1, ["今天", "，", "abc", "!", "好"]), (2, ["12"])], "id int, words array<string>")
    return rows.select("id", corpus.normalised_corpus(F.col("words")).alias("line"))


@query("model_tables", f"WITH {given('p', 'label, w1, w2, n', PAIRS)} SELECT 'text' AS kind, label || '-' || w1 || '-' || w2 || '-' || n AS line FROM p UNION ALL SELECT 'parquet', label || w1 || w2 || n FROM p UNION ALL SELECT 'cached', label FROM p")
def model_tables(spark, sf_dir):
    rows, path = spark.createDataFrame(PAIRS, "label string, w1 string, w2 string, n int"), fresh_path(spark, "model")
    corpus.write_sections({"pairs": rows}, f"{path}/text")
    corpus.save_tables({"pairs": rows}, f"{path}/tables")
    corpus.cached(spark, f"{path}/cache", "labels", lambda: rows.select("label"))
    kept = corpus.cached(spark, f"{path}/cache", "labels", lambda: rows.limit(0).select("label"))  # the second time it is read
    text = spark.read.text(f"{path}/text/pairs").select(F.lit("text").alias("kind"), F.col("value").alias("line"))
    table = corpus.load_tables(spark, f"{path}/tables", ["pairs"])["pairs"].select(F.lit("parquet").alias("kind"), F.concat("label", "w1", "w2", F.col("n").cast("string")).alias("line"))
    return text.unionByName(table).unionByName(kept.select(F.lit("cached").alias("kind"), F.col("label").alias("line")))


CONFIG = "# comment\nname = wordmill\nport=34770\nurl=a=b\nbad line\n"


@query("source_config", f"WITH {lines_sql({'c': CONFIG})} SELECT trim(string_split(v, '=')[1]) AS k, trim(regexp_extract(v, '=(.*)$', 1)) AS v FROM line WHERE v LIKE '%=%' AND NOT starts_with(trim(v), '#')")
def source_config(spark, sf_dir):
    return spark.createDataFrame(sorted(corpus.config(spark, files(spark, {"c": CONFIG})).items()), "k string, v string")


# ---- scalar functions
SCALARS = [(1, "a; b,c,", "xxabcxx", "/root/", "ab", [0.5, 1.5, -2.0], [1.0, 2.0, 3.0]), (2, "one", "x", "/root", "abab", [3.0, 3.0, 1.0], [0.0, 1.0, 0.0]), (3, ",", "", "", "", [-1.0], [2.0])]


@query("scalar_functions", f"""WITH {given('s', 'id, a, b, c, d, v, w', SCALARS)}, p AS (SELECT *, list_transform(string_split_regex(a, '[;,]'), lambda x: trim(x)) AS ps FROM s)
SELECT id, array_to_string(CASE WHEN ps[-1] = '' THEN ps[:-2] ELSE ps END, '|') AS split_any, trim(b, 'x') AS trimmed, CASE WHEN c LIKE '%/' THEN c || 'f' ELSE c || '/f' END AS joined, CAST(len(regexp_extract_all(d || 'abxab', 'ab')) AS INTEGER) AS n_ab, md5(d) AS digest, round(ln(list_sum(list_transform(v, lambda x: exp(x)))), 9) AS lse, round(exp(v[1]) / list_sum(list_transform(v, lambda x: exp(x))), 9) AS soft, list_position(v, list_max(v)) AS argmax, round(list_dot_product(v, w), 9) AS dot, printf('%s-%03d', d, id) AS formatted, array_to_string(list_sort(v, 'DESC'), ' ') IS NOT NULL AS sorted FROM p""")
def scalar_functions(spark, sf_dir):
    from wordmill.functions import strings

    rows = spark.createDataFrame(SCALARS, "id int, a string, b string, c string, d string, v array<double>, w array<double>")
    v = F.col("v")
    return rows.select("id", F.array_join(strings.split_any(F.col("a"), ";,"), "|").alias("split_any"), strings.trim_char(F.col("b"), "x").alias("trimmed"), strings.path_join(F.col("c"), F.lit("f")).alias("joined"), strings.occurrences(F.concat("d", F.lit("abxab")), F.lit("ab")).alias("n_ab"), strings.md5_text(F.col("d")).alias("digest"), F.round(strings.log_sum_exp(v), 9).alias("lse"), F.round(strings.softmax(v)[0], 9).alias("soft"), strings.argmax(v).cast("int").alias("argmax"), F.round(strings.dot(v, F.col("w")), 9).alias("dot"), F.format_string("%s-%03d", "d", "id").alias("formatted"), F.array_sort(v).isNotNull().alias("sorted"))


@query("argsort_and_json", f"WITH {given('s', 'id, a, b, c, d, v, w', SCALARS)}, e AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM s) SELECT id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY x DESC, i) AS places, any_value(j) AS shown FROM e JOIN (SELECT id AS k, '[' || array_to_string(list_transform(w, lambda x: printf('%.1f', x)), ',') || ']' AS j FROM s) ON k = id GROUP BY id")
def argsort_and_json(spark, sf_dir):
    from wordmill.functions import strings

    rows = spark.createDataFrame(SCALARS, "id int, a string, b string, c string, d string, v array<double>, w array<double>")
    return rows.select("id", F.array_join(F.transform(strings.argsort(F.col("v"), descending=True), lambda i: i.cast("string")), ",").alias("places"), strings.shown(F.col("w")).alias("shown"))


@query("set_operations", f"WITH {given('stop', 'word', [('的',), ('是',), ('打',)])}, {given('aim', 'word', [('打',), ('看',)])}, {given('uni', 'word', [('看',), ('买',)])} SELECT 'stop' AS kind, word FROM stop WHERE word NOT IN (SELECT word FROM aim) UNION ALL SELECT 'stop', '了' UNION ALL SELECT 'both', word FROM uni WHERE word IN (SELECT word FROM aim) UNION ALL SELECT 'white', word FROM (VALUES ('好'), ('天气')) v(word)")
def set_operations(spark, sf_dir):
    column = lambda words: spark.createDataFrame([(w,) for w in words], "word string")
    kind = lambda rows, name: rows.select(F.lit(name).alias("kind"), "word")
    stop = tokens.stop_list(column(["的", "是", "打"]), column(["打", "看"]), ["了"])
    white = tokens.drop_single(column(["好", "天", "天气"]), ["好"])
    return kind(stop, "stop").unionByName(kind(tokens.keep_words(column(["看", "买"]), column(["打", "看"])), "both")).unionByName(kind(white, "white"))


# ---- models on a fixture
GIS_DOCS = [(1, "p", "a b"), (2, "p", "a c"), (3, "q", "b c"), (4, "q", "c d"), (5, "q", "a d d")]
GIS_TOKENS = sorted({(i, w) for i, _, t in GIS_DOCS for w in t.split()})


def gis_sql(rounds: int) -> str:
    """Rounds of iterative scaling as a chain of table expressions."""
    out = f"""WITH {given('doc', 'id, label', [(i, y) for i, y, _ in GIS_DOCS])}, {given('tok', 'id, word', GIS_TOKENS)}, lab AS (SELECT DISTINCT label FROM doc),
feat AS (SELECT word, label, CAST(count(*) AS DOUBLE) AS emp FROM tok JOIN doc USING (id) GROUP BY ALL),
const AS (SELECT CAST(max(n) + 1 AS DOUBLE) AS size FROM (SELECT count(*) AS n FROM tok GROUP BY id)),
hits AS (SELECT g.id, g.label, count(feat.word) AS hits FROM (SELECT doc.id, lab.label FROM doc CROSS JOIN lab) g LEFT JOIN tok ON tok.id = g.id LEFT JOIN feat ON feat.word = tok.word AND feat.label = g.label GROUP BY ALL),
slack AS (SELECT doc.label, sum(size - hits) AS emp FROM doc JOIN hits ON hits.id = doc.id AND hits.label = doc.label CROSS JOIN const GROUP BY doc.label),
w0 AS (SELECT word, label, emp, CAST(0 AS DOUBLE) AS w FROM feat), c0 AS (SELECT label, emp, CAST(0 AS DOUBLE) AS c FROM slack)"""
    for k in range(rounds + 1):
        out += f""",
s{k} AS (SELECT hits.id, hits.label, hits.hits, coalesce(sum(w), 0) + (any_value(size) - any_value(hits.hits)) * any_value(c) AS s FROM hits JOIN c{k} ON c{k}.label = hits.label CROSS JOIN const LEFT JOIN tok ON tok.id = hits.id LEFT JOIN w{k} ON w{k}.word = tok.word AND w{k}.label = hits.label GROUP BY ALL),
p{k} AS (SELECT id, label, hits, exp(s) / sum(exp(s)) OVER (PARTITION BY id) AS p FROM s{k})"""
        if k < rounds:
            out += f""",
w{k + 1} AS (SELECT w{k}.word, w{k}.label, any_value(emp) AS emp, any_value(w) + (ln(any_value(emp)) - ln(sum(p))) / any_value(size) AS w FROM w{k} JOIN tok ON tok.word = w{k}.word JOIN p{k} ON p{k}.id = tok.id AND p{k}.label = w{k}.label CROSS JOIN const GROUP BY w{k}.word, w{k}.label),
c{k + 1} AS (SELECT c{k}.label, any_value(emp) AS emp, any_value(c) + CASE WHEN any_value(emp) > 0 THEN (ln(any_value(emp)) - ln(sum(p * (size - hits)))) / any_value(size) ELSE 0 END AS c FROM c{k} JOIN p{k} ON p{k}.label = c{k}.label CROSS JOIN const GROUP BY c{k}.label)"""
    return out + f" SELECT id, label, round(p, 6) AS p FROM p{rounds}"


@query("maxent_rounds", gis_sql(3))
def maxent_rounds(spark, sf_dir):
    docs = spark.createDataFrame([(i, y) for i, y, _ in GIS_DOCS], "id int, label string")
    words = spark.createDataFrame(GIS_TOKENS, "id int, word string")
    model = maxent.train_gis(words, docs, "id", "label", rounds=3)
    return maxent.predict(words, docs, model, "id", "label").withColumn("p", F.round("p", 6))


@query("maxent_grid_rounds", gis_sql(3))
def maxent_grid_rounds(spark, sf_dir):
    docs = spark.createDataFrame([(i, y) for i, y, _ in GIS_DOCS], "id int, label string")
    words = spark.createDataFrame(GIS_TOKENS, "id int, word string")
    known = spark.createDataFrame([(w, i) for i, w in enumerate("abcd")], "word string, rank int")
    rows = stage(maxent.ranked(words, docs, known, "id"), "maxent-rows")
    told = maxent.GisGrid(rows, [2, 4]).train(3).predict(rows, "id")
    return told.where("n_words = 4").select("id", "label", F.round("p", 6).alias("p"))


PHI = [("x", "a", 0.5), ("x", "b", 0.3), ("x", "c", 0.2), ("y", "a", 0.1), ("y", "b", 0.2), ("y", "c", 0.7)]
THETA = [(1, "x", 0.75), (1, "y", 0.25), (2, "x", 0.4), (2, "y", 0.6)]
TOPIC_TOKENS = [(1, "a"), (1, "a"), (1, "b"), (2, "c"), (2, "b")]


@query("topic_perplexity", f"WITH {given('phi', 'label, word, phi', PHI)}, {given('theta', 'id, label, theta', THETA)}, {given('tok', 'id, word', TOPIC_TOKENS)}, t AS (SELECT row_number() OVER () AS k, id, word FROM tok), p AS (SELECT k, ln(sum(phi * theta)) AS l FROM t JOIN theta USING (id) JOIN phi USING (label, word) GROUP BY k) SELECT round(exp(-sum(l) / count(*)), 6) AS perplexity FROM p")
def topic_perplexity(spark, sf_dir):
    phi, theta = spark.createDataFrame(PHI, "label string, word string, phi double"), spark.createDataFrame(THETA, "id int, label string, theta double")
    return topics.perplexity(spark.createDataFrame(TOPIC_TOKENS, "id int, word string"), phi, theta, "id").withColumn("perplexity", F.round("perplexity", 6))


VECTOR_WORDS = ["a", "c", "d"]


@query("multi_hot", f"WITH {given('d', 'id, label, text', GIS_DOCS)} SELECT id, array_to_string([{', '.join(f'CASE WHEN list_contains(string_split(text, chr(32)), {literal(w)}) THEN 1 ELSE 0 END' for w in VECTOR_WORDS)}], '') AS hot, CASE label WHEN 'p' THEN '10' ELSE '01' END AS one FROM d")
def multi_hot(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    rows = spark.createDataFrame(GIS_DOCS, "id int, label string, text string").withColumn("words", tokens.whitespace_words(F.col("text")))
    made = models.presence_vectors(rows, VECTOR_WORDS)
    digits = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), "")
    return made.select("id", digits(vector_to_array("features")).alias("hot"), digits(models.one_hot(F.col("label"), ["p", "q"])).alias("one"))


@query("character_ids", f"WITH {given('v', 'word, word_id', [('U', 0), ('好', 1), ('天', 2), ('今', 3)])}, {given('d', 'id, text', [(1, '今天好'), (2, '天坏')])}, f AS (SELECT id, i, substr('##' || text || '##', i, 5) AS frame FROM (SELECT id, text, unnest(range(1, length(text) + 1)) AS i FROM d)), c AS (SELECT id, i, unnest(range(1, 6)) AS k, frame FROM f) SELECT id, CAST(i AS INTEGER) AS pos, string_agg(CAST(coalesce(word_id, 0) AS VARCHAR), ',' ORDER BY k) AS ids FROM c LEFT JOIN v ON v.word = substr(frame, k, 1) GROUP BY id, i")
def character_ids(spark, sf_dir):
    known = spark.createDataFrame([("U", 0), ("好", 1), ("天", 2), ("今", 3)], "word string, word_id int")
    framed = windows.frames(spark.createDataFrame([(1, "今天好"), (2, "天坏")], "id int, text string"), F.col("text"), 2, 2, "#", "id")
    return neural.window_ids(framed, known).select("id", "pos", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query("vocab_round_trip", f"WITH {given('v', 'word, word_id', [('a', 1), ('b', 2)])}, {given('t', 'id, word', TOPIC_TOKENS)} SELECT id, coalesce(v.word_id, 0) AS word_id, v.word AS decoded, count(*) AS n FROM t LEFT JOIN v USING (word) GROUP BY ALL")
def vocab_round_trip(spark, sf_dir):
    known = spark.createDataFrame([("a", 1), ("b", 2)], "word string, word_id int")
    coded = vocab.encode(spark.createDataFrame(TOPIC_TOKENS, "id int, word string"), known, unknown=0).drop("word")
    return vocab.decode(coded, known).groupBy("id", "word_id", F.col("word").alias("decoded")).agg(F.count("*").alias("n"))


SPLIT_ROWS = [(i, "neg" if i % 3 == 0 else "pos") for i in range(1, 38)]


@query("ratio_split", f"WITH {given('r', 'id, label', SPLIT_ROWS)}, n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS i, count(*) OVER (PARTITION BY label) AS n, (SELECT count(*) FROM r WHERE label = 'neg') AS base FROM r) SELECT 'train' AS part, id, label FROM n WHERE i <= CAST(floor(base * 0.8) AS INTEGER) UNION ALL SELECT 'test', id, label FROM n WHERE i > n - (base - CAST(floor(base * 0.8) AS INTEGER))")
def ratio_split(spark, sf_dir):
    train, test = evaluate.ratio_split(spark.createDataFrame(SPLIT_ROWS, "id int, label string"), "label", 0.8, "id")
    return train.select(F.lit("train").alias("part"), "id", "label").unionByName(test.select(F.lit("test").alias("part"), "id", "label"))
