"""Counting: occurrences, presence, marginals, pairs and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def occurrences(tokens: DataFrame, *by: str) -> DataFrame:
    return tokens.groupBy(*by, "word").agg(F.count("*").alias("n"))


def presence(tokens: DataFrame, doc: str, *by: str) -> DataFrame:
    """In how many documents a word is. Distinct first: both aggregates combine before their shuffle."""
    return tokens.select(doc, *by, "word").distinct().groupBy(*by, "word").agg(F.count("*").alias("n"))


def document_frequency(tokens: DataFrame, doc: str, least: int = 1) -> DataFrame:
    """(word, df, tf): documents with the word and its occurrences, for words in at least so many documents."""
    per = tokens.groupBy(doc, "word").agg(F.count("*").alias("n"))
    return per.groupBy("word").agg(F.count("*").alias("df"), F.sum("n").alias("tf")).where(F.col("df") >= least)


def presence_of(docs: DataFrame, words: Column) -> DataFrame:
    """(word, n): in how many rows a word is. Each row's distinct words are counted at once, (row, word) is never shuffled."""
    return docs.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def marginals(counts: DataFrame, label: str) -> DataFrame:
    """(word, label), (word), (label) and () sums of n in one pass; level is grouping_id(word, label)."""
    return counts.groupingSets([["word", label], ["word"], [label], []], "word", label).agg(F.sum("n").alias("n"), F.grouping_id("word", label).cast("int").alias("level"))


def document_sets(docs: DataFrame, words: Column, *keep: str) -> DataFrame:
    """keep and words: the sorted distinct words of each row."""
    return docs.select(*keep, F.array_sort(F.array_distinct(words)).alias("words"))


def _spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly before they are multiplied: n words are shuffled for the n(n-1)/2 pairs that tasks then make."""
    return rows.repartition(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def unordered_pairs(sets: DataFrame, *keep: str) -> DataFrame:
    """keep, w1 < w2: pairs of distinct words of each row. Pairs are made one after the other, never held as an array.

    A row makes n(n-1)/2 pairs of its n words; cut words first (min_df, best words) for long texts."""
    heads = _spread(sets.where(F.size("words") > 1).select(*keep, "words")).select(*keep, "words", F.posexplode("words").alias("__i", "w1"))
    return heads.select(*keep, "w1", F.explode(F.slice("words", F.col("__i") + 2, F.size("words"))).alias("w2"))


def ordered_pairs(docs: DataFrame, words: Column, *keep: str) -> DataFrame:
    """keep, w1, w2: every two positions i < j with different words, direction kept."""
    return unordered_pairs(docs.select(*keep, words.alias("words")), *keep).where("w1 <> w2")


def pair_counts(pairs: DataFrame, *by: str, least: int = 1) -> DataFrame:
    """(by, w1, w2, n) with n at least `least`."""
    return pairs.groupBy(*by, "w1", "w2").agg(F.count("*").alias("n")).where(F.col("n") >= least)


PADDING = "*"


def contexts_of(docs: DataFrame, words: Column, key: str, aims: list[str], padding: str = PADDING) -> DataFrame:
    """contexts() of rows that hold all their words, made inside the row: nothing is shuffled or sorted."""
    listed = docs.select(key, words.alias("words"))
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(*aims))

    def triples(i):
        w = lambda k: F.get("words", i + k)
        pad = lambda c: F.coalesce(c, F.lit(padding))
        triple = lambda p, n: F.struct(p.alias("prev"), n.alias("next"), F.get("words", i).alias("word"))
        return F.array(F.when(w(-1).isNotNull() | w(1).isNotNull(), triple(pad(w(-1)), pad(w(1)))), F.when(w(-2).isNotNull(), triple(w(-2), w(-1))), F.when(w(2).isNotNull(), triple(w(1), w(2))))

    return listed.where(F.size("words") > 0).select(key, F.explode(F.array_compact(F.flatten(F.transform(at, triples)))).alias("c")).select(key, "c.prev", "c.next", "c.word")


def contexts(tokens: DataFrame, key: str, aims: list[str], padding: str = PADDING) -> DataFrame:
    """(prev, next, word) of each aim: its neighbours, the two before it and the two after it; a pair
    of two paddings is left out. Tokens are shuffled and sorted by key; contexts_of() does without."""
    w = Window.partitionBy(key).orderBy("pos")
    near = tokens.select(key, "pos", "word", *[F.lag("word", n).over(w).alias(f"b{n}") for n in (1, 2)], *[F.lead("word", n).over(w).alias(f"a{n}") for n in (1, 2)]).where(F.col("word").isin(*aims))
    pad = lambda c: F.coalesce(F.col(c), F.lit(padding))
    triple = lambda p, n: F.struct(p.alias("prev"), n.alias("next"))
    every = F.array(F.when(F.col("b1").isNotNull() | F.col("a1").isNotNull(), triple(pad("b1"), pad("a1"))), F.when(F.col("b2").isNotNull(), triple(F.col("b2"), F.col("b1"))), F.when(F.col("a2").isNotNull(), triple(F.col("a1"), F.col("a2"))))
    return near.select(key, "word", F.explode(F.array_compact(every)).alias("c")).select(key, "c.prev", "c.next", "word")


def context_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("prev", "next", "word").agg(F.count("*").alias("n"))


def weighted_contexts(docs: DataFrame, words: Column, aims: list[str]) -> DataFrame:
    """(aim, word, weight): words next to an aim count 2, those two away 1. Made inside the row, then summed."""
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(*aims))
    near = F.transform(at, lambda i: F.array(*[F.struct(F.get("words", i).alias("aim"), F.get("words", i + k).alias("word"), F.lit(v).alias("v")) for k, v in ((-1, 2), (1, 2), (-2, 1), (2, 1))]))
    each = docs.select(words.alias("words")).where(F.size("words") > 0).select(F.explode(F.flatten(near)).alias("e")).where("e.word is not null")
    return each.groupBy("e.aim", "e.word").agg(F.sum("e.v").alias("weight"))


def row_share(counts: DataFrame, by: list[str], name: str = "share") -> DataFrame:
    """n over the sum of n of its row."""
    return counts.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def inverted_index(pairs: DataFrame, head: str, member: str) -> DataFrame:
    return pairs.groupBy(member).agg(F.array_sort(F.collect_set(head)).alias("heads"))
