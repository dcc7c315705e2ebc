"""Word-sense resolution from context counts and a thesaurus (word, sense, synonym)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordmill.operators.windows import neighbours

UNDEFINED = "_UNDEFINE_"


def suppress_half_padded(triples: DataFrame, stop: list[str], padding: str = "*") -> DataFrame:
    """Contexts of a padding and a stop word say nothing."""
    half = ((F.col("prev") == padding) & F.col("next").isin(*stop)) | ((F.col("next") == padding) & F.col("prev").isin(*stop))
    return triples.where(~half)


def scores(occurrences: DataFrame, counts: DataFrame, thesaurus: DataFrame, keys: list[str], normalise: bool = False) -> DataFrame:
    """(keys, word, sense, score): sum of the counts of the sense's synonyms in the occurrence's contexts,
    times the number of hits, over the number of the sense's synonyms. normalise divides counts by
    their context's total. occurrences: keys, prev, next, word."""
    if normalise:
        counts = counts.withColumn("n", F.col("n") / F.sum("n").over(Window.partitionBy("prev", "next")))
    sizes = thesaurus.groupBy("word", "sense").agg(F.countDistinct("synonym").alias("size"))
    synonyms = thesaurus.where("synonym <> word").select("word", "sense", "synonym").distinct()
    found = occurrences.join(counts.select("prev", "next", F.col("word").alias("synonym"), "n"), ["prev", "next"]).join(synonyms, ["word", "synonym"])
    summed = found.groupBy(*keys, "word", "sense").agg(F.sum("n").alias("s"), F.count("*").alias("hits"))
    every = occurrences.select(*keys, "word").distinct().join(sizes, "word")
    value = F.coalesce(F.col("s") * F.col("hits") / F.col("size"), F.lit(0.0))
    return every.join(summed, [*keys, "word", "sense"], "left").select(*keys, "word", "sense", value.alias("score"))


def best(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, word, sense): the best sense (ties: the first by name), or _UNDEFINE_ if its score is 0."""
    top = scored.groupBy(*keys, "word").agg(F.min_by("sense", F.struct((-F.round("score", 9)).alias("s"), "sense")).alias("sense"), F.max("score").alias("score"))
    return top.withColumn("sense", F.when(F.col("score") == 0, F.lit(UNDEFINED)).otherwise(F.col("sense")))


def one_shot(docs: DataFrame, counts: DataFrame, thesaurus: DataFrame, key: str, aims: list[str], stop: list[str] = (), least: int = 5) -> DataFrame:
    """(key, word, sense, score): the sense of the first occurrence of each aim in a text of at least so many words; shorter
    texts have no row. docs: key, words array<string>. Counts are shares of their context's total; contexts of a padding and a
    stop word are left out."""
    listed = docs.where(F.size("words") >= least)
    first = F.filter(F.transform(F.array(*[F.lit(a) for a in aims]), lambda a: F.struct(a.alias("word"), F.array_position("words", a).alias("i"))), lambda x: x["i"] > 0)
    w = lambda k: F.get("words", (F.col("a.i") - 1 + k).cast("int"))
    pad = lambda c: F.coalesce(c, F.lit("*"))
    triple = lambda p, n: F.struct(p.alias("prev"), n.alias("next"))
    every = F.array(F.when(w(-1).isNotNull() | w(1).isNotNull(), triple(pad(w(-1)), pad(w(1)))), F.when(w(-2).isNotNull(), triple(w(-2), w(-1))), F.when(w(2).isNotNull(), triple(w(1), w(2))))
    found = listed.select(key, "words", F.explode(first).alias("a")).select(key, F.col("a.word").alias("word"), F.explode(F.array_compact(every)).alias("c")).select(key, "word", "c.prev", "c.next")
    return best(scores(suppress_half_padded(found, list(stop)), counts, thesaurus, [key], normalise=True), [key])


def polysemous(thesaurus: DataFrame, least: int = 2) -> DataFrame:
    """Words with at least that many senses."""
    return thesaurus.groupBy("word").agg(F.countDistinct("sense").alias("senses")).where(F.col("senses") >= least)


def _near(tokens: DataFrame, key: str) -> DataFrame:
    return neighbours(tokens.select(key, "pos", "word"), key, 2, None)


def expand(tokens: DataFrame, thesaurus: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Level 1. A synonym with just one (word, sense) passes its sense on to the occurrence.

    Returns (found: key, pos, synonym, word, sense) and (phrases: phrase, synonym, word, sense), the
    five-word windows with the synonym replaced by each other synonym of the sense. Tokens are shuffled and sorted by key; expand_near() does without."""
    return expand_near(_near(tokens, key), thesaurus, key)


def expand_near(near: DataFrame, thesaurus: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """expand() of words with their neighbours (windows.neighbours_of, no edge)."""
    single = thesaurus.groupBy("synonym").agg(F.countDistinct("word", "sense").alias("k")).where("k = 1").select("synonym")
    unique = thesaurus.join(single, "synonym", "left_semi").select("synonym", "word", "sense").distinct()
    found = near.withColumnRenamed("word", "synonym").join(unique, "synonym")
    others = thesaurus.select("word", "sense", F.col("synonym").alias("other")).distinct()
    inside = found.where("b2 is not null and a2 is not null").join(others, ["word", "sense"]).where("other <> synonym")
    phrases = inside.select(F.concat_ws(" ", "b2", "b1", "other", "a1", "a2").alias("phrase"), F.col("other").alias("synonym"), "word", "sense").distinct()
    return found.select(key, "pos", "synonym", "word", "sense"), phrases


def expand_again(tokens: DataFrame, phrases: DataFrame, key: str) -> DataFrame:
    """Level 2: (key, word, sense) of texts that contain a phrase of level 1; joined on the phrase."""
    return expand_again_near(_near(tokens, key), phrases, key)


def expand_again_near(near: DataFrame, phrases: DataFrame, key: str) -> DataFrame:
    """expand_again() of words with their neighbours; near should be cut before to words that stand in the middle of a phrase."""
    five = near.where("b2 is not null and a2 is not null").select(key, F.concat_ws(" ", "b2", "b1", "word", "a1", "a2").alias("phrase"))
    return five.join(phrases.select("phrase", "word", "sense"), "phrase").select(key, "word", "sense").distinct()


def evidence(occurrences: DataFrame, counts: DataFrame, thesaurus: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, word, sense, synonym, prev, next, n): the context counts that speak for each sense."""
    synonyms = thesaurus.where("synonym <> word").select("word", "sense", "synonym").distinct()
    found = occurrences.join(counts.select("prev", "next", F.col("word").alias("synonym"), "n"), ["prev", "next"])
    return found.join(synonyms, ["word", "synonym"]).select(*keys, "word", "sense", "synonym", "prev", "next", "n")


def evaluate(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """One row (n, good): predictions that are undefined or missing are left out."""
    known = predicted.where(F.col("sense").isNotNull() & (F.col("sense") != UNDEFINED))
    joined = known.join(truth.select(*keys, "word", F.col("sense").alias("truth")), [*keys, "word"])
    return joined.agg(F.count("*").alias("n"), F.sum((F.col("sense") == F.col("truth")).cast("long")).alias("good"))


def expand_inverted(thesaurus: DataFrame) -> DataFrame:
    """(synonym, words): the head words of each synonym."""
    return thesaurus.groupBy("synonym").agg(F.array_sort(F.collect_set("word")).alias("words"))
