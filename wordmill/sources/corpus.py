"""Readers and writers for the text formats of corpora, lexicons, thesauri and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordmill.operators.segment import Hmm, parse_hmm
from wordmill.operators.tokens import unicode_words


def lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, value): lines that are valid UTF-8, carriage returns and byte-order marks taken off."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    rows = reader.text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    return rows.where(F.is_valid_utf8("value")).withColumn("value", F.regexp_replace("value", "^﻿|\r$", ""))


def stem(file: Column) -> Column:
    return F.regexp_replace(file, r"\.[^.]*$", "")


def labelled(spark: SparkSession, path: str, glob: str = "*.txt", exclude_tokenised: bool = True) -> DataFrame:
    """(label, text): a file for each class, a document a line; empty lines are skipped."""
    rows = lines(spark, path, glob).where(F.length(F.trim("value")) > 0)
    if exclude_tokenised:
        rows = rows.where(~F.col("file").endswith("_p.txt"))
    return rows.select(stem(F.col("file")).alias("label"), F.col("value").alias("text"))


def tokenised(spark: SparkSession, path: str, glob: str = "*_p.txt") -> DataFrame:
    """(label, words) of pre-tokenised files."""
    rows = lines(spark, path, glob)
    return rows.select(F.regexp_replace(stem(F.col("file")), "_p$", "").alias("label"), F.filter(F.split("value", r"\s+"), lambda w: w != "").alias("words")).where(F.size("words") > 0)


def polarity(spark: SparkSession, positive: str, negative: str) -> DataFrame:
    """(label pos or neg, words) of two files of blank-joined tokens."""
    read = lambda p, name: lines(spark, p).select(F.lit(name).alias("label"), F.filter(F.split("value", r"\s+"), lambda w: w != "").alias("words"))
    return read(positive, "pos").unionByName(read(negative, "neg")).where(F.size("words") > 0)


def bracket_labels(line: Column, most: int = 512) -> Column:
    """struct<labels,text> of `[a,b]text`; labels are null without brackets; null if the text after them has more than `most` characters."""
    labels = F.regexp_extract(line, r"^\[(.+?)\](.+)", 1)
    body = F.when(labels != "", F.trim(F.regexp_extract(line, r"^\[(.+?)\](.+)", 2))).otherwise(line)
    return F.when(F.char_length(body) <= most, F.struct(F.when(labels != "", F.split(labels, ",")).alias("labels"), body.alias("text")))


def multi_labelled(spark: SparkSession, path: str, words=unicode_words) -> DataFrame:
    """(labels, text, words): documents without words are dropped."""
    rows = lines(spark, path).select(bracket_labels(F.trim("value")).alias("r")).where("r is not null").select("r.labels", "r.text")
    return rows.withColumn("words", words(F.col("text"))).where(F.size("words") > 0)


def segmented(spark: SparkSession, path: str) -> DataFrame:
    """(file, words) of blank-separated words, a sentence a line."""
    return lines(spark, path).select("file", F.filter(F.split("value", r"\s+"), lambda w: w != "").alias("words")).where(F.size("words") > 0)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word): trimmed lines; blank lines and those that begin with # are skipped."""
    return lines(spark, path).select(F.trim("value").alias("word")).where("word <> '' and not startswith(word, '#')")


def raw_word_list(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(F.col("value").alias("word"))


def characters(spark: SparkSession, path: str) -> DataFrame:
    """(ch): the first character of each line."""
    return lines(spark, path).where("value <> ''").select(F.substring("value", 1, 1).alias("ch")).distinct()


def first_char_index(words: DataFrame) -> DataFrame:
    """(ch, words): dictionary words by their first character; CJK words only."""
    from wordmill.functions.chars import is_zhs

    return words.where(is_zhs(F.col("word")) & (F.col("word") != "")).groupBy(F.substring("word", 1, 1).alias("ch")).agg(F.array_sort(F.collect_set("word")).alias("words"))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq, tag) of lines of just three fields; other lines are an error when read."""
    parts = lines(spark, path).where("trim(value) <> ''").select(F.split(F.trim("value"), " ").alias("p"))
    checked = F.when(F.size("p") == 3, F.col("p")).otherwise(F.raise_error(F.lit("a lexicon line has three fields")).cast("array<string>"))
    return parts.select(checked.alias("p")).select(F.col("p")[0].alias("word"), F.col("p")[1].cast("double").alias("freq"), F.col("p")[2].alias("tag"))


def lexicon_weights(words: DataFrame) -> DataFrame:
    """Adds weight: ln(freq / sum of freq)."""
    total = words.agg(F.sum("freq").alias("__total"))
    return words.crossJoin(F.broadcast(total)).withColumn("weight", F.log(F.col("freq") / F.col("__total"))).drop("__total")  # one row


def user_lexicon(spark: SparkSession, path: str) -> DataFrame:
    parts = lines(spark, path).where("trim(value) <> ''").select(F.split(F.trim("value"), " ").alias("p"))
    return parts.select(F.col("p")[0].alias("word"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("tag"))


def average_idf(spark: SparkSession, path: str, compat: bool = False) -> float:
    """The average of idf_list(); compat divides by the number of physical lines, bad ones too."""
    total = idf_list(spark, path).agg(F.sum("idf").alias("s"), F.count("*").alias("n")).first()
    count = lines(spark, path).count() if compat else total["n"]
    return (total["s"] or 0.0) / max(1, count)


def with_user_words(words: DataFrame, user: DataFrame) -> DataFrame:
    """(word, weight, tag, own): a weighted lexicon and user words, which weigh as much as the heaviest and replace namesakes."""
    top = words.agg(F.max("weight").alias("weight"))
    own = user.select("word", "tag").dropDuplicates(["word"]).crossJoin(F.broadcast(top)).select("word", "weight", "tag", F.lit(True).alias("own"))  # one row
    return words.select("word", "weight", "tag", F.lit(False).alias("own")).join(own.select("word"), "word", "left_anti").unionByName(own)


def idf_list(spark: SparkSession, path: str) -> DataFrame:
    """(word, idf) of lines of just two fields."""
    parts = lines(spark, path).select(F.split(F.trim("value"), " ").alias("p")).where(F.size("p") == 2)
    return parts.select(F.col("p")[0].alias("word"), F.col("p")[1].cast("double").alias("idf"))


def hmm_model(spark: SparkSession, path: str) -> Hmm:
    """The text model (one small file) as an Hmm."""
    return parse_hmm(spark.read.text(path, wholetext=True).first()["value"])


def tagged(spark: SparkSession, path: str) -> DataFrame:
    from wordmill.operators.ner import parse_tagged

    return lines(spark, path).where("trim(value) <> ''").select("file", parse_tagged(F.col("value")).alias("tokens"))


def char_tags(spark: SparkSession, path: str) -> DataFrame:
    """(pos, ch, tag) of `char TAG` lines; a whole file keeps its order, so each is one row while parsed."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "line")).where("trim(line) <> ''")
    return rows.select("pos", F.split("line", " ")[0].alias("ch"), F.split("line", " ")[1].alias("tag"))


def thesaurus_blocks(text: Column) -> Column:
    """array<struct<word,sense,synonyms,examples>> of a whole file: `[DDv word]` opens a word, `【sense=】
    syn syn` a sense, other lines with `～` are its examples (cut at | 丨 │ ㄧ, `～` put back)."""
    blocks = F.filter(F.split(text, r"(?=\[DD)"), lambda b: b.startswith("[DD"))

    def sense(word, part):
        head = F.regexp_extract(part, r"^【(.+?)=】", 1)
        synonyms = F.filter(F.split(F.regexp_extract(part, r"^【.+?=】([^\r\n]*)", 1), r"\s+"), lambda s: s != "")
        rest = F.filter(F.split(part, r"[\r\n]+"), lambda x: x.contains("～"))
        examples = F.flatten(F.transform(rest, lambda x: F.split(F.regexp_replace(x, "^#例句[:：]", ""), r"[|丨│ㄧ]")))
        told = F.filter(F.transform(examples, lambda x: F.replace(F.trim(x), F.lit("～"), word)), lambda x: x != "")
        return F.struct(word.alias("word"), head.alias("sense"), synonyms.alias("synonyms"), told.alias("examples"))

    def block(b):
        word = F.regexp_extract(b, r"^\[DD\w*\s+(.+?)\]", 1)
        return F.transform(F.filter(F.split(b, r"(?=【)"), lambda p: p.rlike(r"^【.+?=】")), lambda p: sense(word, p))

    return F.flatten(F.transform(blocks, block))


def thesaurus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.explode(thesaurus_blocks(F.col("value"))).alias("s")).select("s.*")


def thesaurus_lines(spark: SparkSession, path: str, pos: str = "v") -> DataFrame:
    """(pos, sense, synonym) of `v 【….=】 syn syn` lines with at least three fields; the word is in the sense before the point."""
    parts = lines(spark, path).select(F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 3)
    return parts.where(F.col("p")[0] == pos).where(F.col("p")[1].rlike(r"【.+\.=】")).select(F.col("p")[0].alias("pos"), F.regexp_extract(F.col("p")[1], r"【(.+)\.=】", 1).alias("sense"), F.explode(F.slice("p", 3, 1 << 20)).alias("synonym"))


def thesaurus_words(blocks: DataFrame) -> DataFrame:
    """(word): head words and synonyms of thesaurus blocks, for a vocabulary that is made before the corpus is read."""
    return blocks.select(F.explode(F.concat(F.array("word"), "synonyms")).alias("word")).distinct()


def unique_senses(spark: SparkSession, path: str, aims: DataFrame) -> DataFrame:
    """(word): lines `word|...=】...` with just one `=】` whose word is among aims."""
    rows = lines(spark, path).where(F.regexp_count("value", F.lit("=】")) == 1).select(F.split_part("value", F.lit("|"), F.lit(1)).alias("word"))
    return rows.join(aims.select("word"), "word", "left_semi").distinct()


def config(spark: SparkSession, path: str) -> dict[str, str]:
    """`key=value` lines (a small file); # comments are skipped."""
    rows = lines(spark, path).where("value like '%=%' and not startswith(trim(value), '#')").select(F.trim(F.split_part("value", F.lit("="), F.lit(1))).alias("k"), F.trim(F.regexp_extract("value", "=(.*)$", 1)).alias("v"))
    return {r["k"]: r["v"] for r in rows.collect()}


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_jdbc(rows: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()


def write_tokenised(rows: DataFrame, path: str, words: str = "words") -> None:
    """Distinct words of each document, blank-joined; documents without words are dropped."""
    rows.select(F.array_distinct(words).alias("w")).where(F.size("w") > 0).select(F.concat_ws(" ", "w")).write.text(path)


def normalised_corpus(words: Column) -> Column:
    """Words joined by blanks: punctuation as _E_, other words that are not CJK as _P_."""
    from wordmill.functions.chars import PUNCT_RANGES, is_zhs

    return F.array_join(F.transform(words, lambda w: F.when(is_zhs(w), w).when(w.rlike(f"^[{PUNCT_RANGES}]+$"), F.lit("_E_")).otherwise(F.lit("_P_"))), " ")


def write_attributes(rows: DataFrame, path: str, label: str = "label", feats: str = "feats") -> None:
    """Tab-separated label and attributes, a position a line."""
    rows.select(F.concat_ws("\t", label, F.array_join(feats, "\t"))).write.text(path)


PAIR_LAYOUTS = {
    "tilde": lambda: F.concat_ws("\t", "label", F.concat_ws("~", "w1", "w2"), F.col("n").cast("string")),
    "bracket": lambda: F.concat("w1", F.lit("\t"), "w2", F.lit("["), "label", F.lit("]:"), F.col("n").cast("string")),
    "dash": lambda: F.concat(F.lit("TAG:"), "label", F.lit(":\t"), "w1", F.lit("-"), "w2", F.lit(":"), F.col("n").cast("string")),
}


def write_pairs(counts: DataFrame, path: str, layout: str = "tilde") -> None:
    """A line for each pair count, in one of three layouts: `label<TAB>w1~w2<TAB>n`, `w1<TAB>w2[label]:n` or `TAG:label:<TAB>w1-w2:n`."""
    counts.select(PAIR_LAYOUTS[layout]().alias("value")).write.text(path)


def write_senses(found: DataFrame, path: str) -> None:
    """The report of a word-sense stage, a line for each word: found has word, sense, synonyms, examples, more (arrays of sentences)."""
    block = F.concat(F.lit("  "), "sense", F.lit(" :: "), F.concat_ws(" ", "synonyms"), F.lit(" :: "), F.concat_ws(" | ", "examples"), F.lit(" :: "), F.concat_ws(" | ", "more"))
    told = found.select("word", F.struct("sense", block.alias("line")).alias("s")).groupBy("word").agg(F.array_sort(F.collect_list("s")).alias("s"))
    told.select(F.concat(F.lit("[["), "word", F.lit("]]"), F.array_join(F.transform("s", lambda x: x["line"]), "")).alias("value")).write.text(path)


def write_sections(sections: dict[str, DataFrame], path: str) -> None:
    """Tables as text, a folder for each section: fields joined by `-`."""
    for name, rows in sections.items():
        rows.select(F.concat_ws("-", *[F.col(c).cast("string") for c in rows.columns])).write.mode("overwrite").text(f"{path}/{name}")


def save_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A model as Parquet tables; load_tables reads them back, cached() builds them only if missing."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def cached(spark: SparkSession, path: str, name: str, build) -> DataFrame:
    try:
        return spark.read.parquet(f"{path}/{name}")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    build().write.parquet(f"{path}/{name}")
    return spark.read.parquet(f"{path}/{name}")


def gather_examples(rows: DataFrame) -> DataFrame:
    """(word, sense, examples): example sentences of each sense, repeated ones too."""
    return rows.groupBy("word", "sense").agg(F.array_sort(F.collect_list("example")).alias("examples"))


def running_blocks(rows: DataFrame, order: str, opens: Column, key: str = "file") -> DataFrame:
    """Adds block: the number of opening lines so far in a file (for line formats with block headers)."""
    return rows.withColumn("block", F.sum(opens.cast("int")).over(Window.partitionBy(key).orderBy(order)))
