"""Classifiers by co-occurring word pairs: for each pair a score for each class, then the mean.

train (label, w1, w2, n) becomes one row a pair with its counts by class, so that a document's pairs are joined once,
whatever the number of classes, and the classes' scores are columns of one aggregate. Functions with `unique` take pairs that are distinct for a document and
have the lower word first; they need no further shuffle for that."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TINY = 1e-10


def wide(train: DataFrame, label: str) -> DataFrame:
    """(w1, w2, by: map of class to n, total): one row a pair; the map is as large as the number of classes."""
    return train.groupBy("w1", "w2").agg(F.map_from_entries(F.collect_list(F.struct(F.col(label).alias("l"), "n"))).alias("by"), F.sum("n").alias("total"))


def _scored(pairs: DataFrame, model: DataFrame, labels: DataFrame, doc: str, label: str, value: Callable[[str], Column], how: Callable[[Column], Column], unique: bool) -> DataFrame:
    """(doc, label, score): how() over a document's distinct pairs of value(class). unique: pairs are distinct already."""
    names = sorted(r[0] for r in labels.select(label).distinct().collect())  # the model's classes
    own = pairs.select(doc, "w1", "w2")
    joined = (own if unique else own.distinct()).join(model, ["w1", "w2"], "left")
    each = joined.groupBy(doc).agg(*[how(value(name)).alias(f"s{i}") for i, name in enumerate(names)])
    listed = F.array(*[F.struct(F.lit(name).alias("l"), F.col(f"s{i}").alias("s")) for i, name in enumerate(names)])
    return each.select(doc, F.explode(listed).alias("e")).select(doc, F.col("e.l").alias(label), F.col("e.s").alias("score"))


def _direct(train: DataFrame, words: DataFrame, label: str) -> DataFrame:
    """wide() of pairs without direction, with c: the sum of both words' counts."""
    both = train.select(label, F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2"), "n").groupBy(label, "w1", "w2").agg(F.sum("n").alias("n"))
    c1, c2 = (words.select(F.col("word").alias(w), F.col("n").alias(c)) for w, c in (("w1", "c1"), ("w2", "c2")))
    return wide(both, label).join(c1, "w1").join(c2, "w2").withColumn("c", F.col("c1") + F.col("c2"))


def _undirected(pairs: DataFrame, doc: str, unique: bool) -> DataFrame:
    """Pairs with the lower word first, as unique ones are."""
    return pairs if unique else pairs.select(doc, F.least("w1", "w2").alias("w1"), F.greatest("w1", "w2").alias("w2"))


def _ratio(name: str) -> Column:
    return F.log(F.coalesce(F.col("by")[name] / F.col("c"), F.lit(0.0)) + TINY)


def score_v0(pairs: DataFrame, train: DataFrame, words: DataFrame, labels: DataFrame, doc: str, label: str, unique: bool = False) -> DataFrame:
    """(doc, label, score): sum of log(pair / (c1 + c2) + 1e-10), both directions of a pair added."""
    return _scored(_undirected(pairs, doc, unique), _direct(train, words, label), labels, doc, label, _ratio, F.sum, unique)


def score_v1(pairs: DataFrame, train: DataFrame, words: DataFrame, labels: DataFrame, doc: str, label: str, unique: bool = False) -> DataFrame:
    """(doc, label, score): mean of -log(pair / (c1 + c2) + 1e-10); lower is better."""
    return _scored(_undirected(pairs, doc, unique), _direct(train, words, label), labels, doc, label, lambda name: -_ratio(name), F.avg, unique)


def score_v2(pairs: DataFrame, train: DataFrame, words: DataFrame, labels: DataFrame, doc: str, label: str, n: int = 5, unique: bool = False) -> DataFrame:
    """As v1 with counts of words within the class (words: label, word, n); a pair the class lacks has -log(1e-10)."""
    c1, c2 = (words.select(label, F.col("word").alias(w), F.col("n").alias(c)) for w, c in (("w1", "c1"), ("w2", "c2")))
    model = wide(train.join(c1, [label, "w1"]).join(c2, [label, "w2"]).select(label, "w1", "w2", (F.col("n") / (F.col("c1") + F.col("c2"))).alias("n")), label)
    return best(_scored(pairs, model, labels, doc, label, lambda name: -F.log(F.coalesce(F.col("by")[name], F.lit(0.0)) + TINY), F.avg, unique), doc, label, n)


def _share(name: str, weighted: bool) -> Column:
    value = -F.log(F.col("by")[name] / F.col("total") + TINY)
    return F.coalesce(value * F.col("by")[name] if weighted else value, -F.log(F.lit(TINY)))


def score_v3(pairs: DataFrame, train: DataFrame, labels: DataFrame, doc: str, label: str, weighted: bool = True, unique: bool = False) -> DataFrame:
    """(doc, label, score): mean over pairs of -n log(n / sum over classes n + 1e-10); a pair that the
    class (or any class) lacks has -log(1e-10). weighted=False leaves the factor n out."""
    return _scored(pairs, wide(train, label), labels, doc, label, lambda name: _share(name, weighted), F.avg, unique)


def evidence_v3(pairs: DataFrame, train: DataFrame, doc: str, label: str, weighted: bool = True) -> DataFrame:
    """(doc, w1, w2, label, n, score): what each pair that some class has contributes to the classes that have it."""
    known = pairs.select(doc, "w1", "w2").distinct().join(wide(train, label), ["w1", "w2"])
    each = known.select(doc, "w1", "w2", "total", F.explode("by").alias(label, "n"))
    value = -F.log(F.col("n") / F.col("total") + TINY)
    return each.select(doc, "w1", "w2", label, "n", (value * F.col("n") if weighted else value).alias("score"))


def best(scores: DataFrame, doc: str, label: str, n: int = 5) -> DataFrame:
    """The n classes with the lowest scores of each document."""
    rank = F.row_number().over(Window.partitionBy(doc).orderBy("score", label))
    return scores.withColumn("rank", rank).where(F.col("rank") <= n)
