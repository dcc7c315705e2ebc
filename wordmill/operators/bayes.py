"""Naive Bayes in log space, trained and applied by aggregates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordmill.operators import features
from wordmill.plans.staging import stage


def select_words(counts: DataFrame, label: str, n: int) -> DataFrame:
    return features.top(features.chi_square(counts, label), n).select("word")


def priors(docs: DataFrame, label: str) -> DataFrame:
    """(label, n_docs, log_prior), a row for each class."""
    per = docs.groupBy(label).agg(F.count("*").alias("n_docs"))
    return per.withColumn("log_prior", F.log(F.col("n_docs") / F.sum("n_docs").over(Window.partitionBy())))


def train_multinomial(counts: DataFrame, words: DataFrame, prior: DataFrame, label: str, alpha: float = 1.0) -> DataFrame:
    """(label, word, ll): log (n + alpha) / (sum n + alpha N) over the selected words."""
    size = words.agg(F.count("*").alias("size"))
    grid = words.crossJoin(F.broadcast(prior.select(label)))  # the model: words x classes
    own = counts.join(words, "word", "left_semi")
    full = grid.join(own, ["word", label], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = full.groupBy(label).agg(F.sum("n").alias("total"))
    return full.join(F.broadcast(total), label).crossJoin(F.broadcast(size)).select(label, "word", F.log((F.col("n") + alpha) / (F.col("total") + alpha * F.col("size"))).alias("ll"))


def train_bernoulli(presence: DataFrame, words: DataFrame, prior: DataFrame, label: str) -> DataFrame:
    """(label, word, p): (documents of the class with the word + 1) / (documents + 2)."""
    grid = words.crossJoin(F.broadcast(prior.select(label, "n_docs")))
    full = grid.join(presence.join(words, "word", "left_semi"), ["word", label], "left")
    return full.select(label, "word", ((F.coalesce("n", F.lit(0)) + 1) / (F.col("n_docs") + 2)).alias("p"))


def score_multinomial(docs: DataFrame, tokens: DataFrame, model: DataFrame, prior: DataFrame, doc: str, label: str) -> DataFrame:
    """(doc, label, score) for every document and class; repeated tokens count each time."""
    seen = tokens.groupBy(doc, "word").agg(F.count("*").alias("tf"))
    sums = seen.join(model, "word").groupBy(doc, label).agg(F.sum(F.col("tf") * F.col("ll")).alias("s"))
    grid = docs.select(doc).crossJoin(F.broadcast(prior.select(label, "log_prior")))
    return grid.join(sums, [doc, label], "left").select(doc, label, (F.col("log_prior") + F.coalesce("s", F.lit(0.0))).alias("score"))


def score_bernoulli(docs: DataFrame, tokens: DataFrame, model: DataFrame, prior: DataFrame, doc: str, label: str) -> DataFrame:
    """As above: a constant for each class (all words absent) plus a term for each word that is there."""
    absent = model.groupBy(label).agg(F.sum(F.log(1 - F.col("p"))).alias("absent"))
    odds = model.select(label, "word", (F.log("p") - F.log(1 - F.col("p"))).alias("ll"))
    sums = tokens.select(doc, "word").distinct().join(odds, "word").groupBy(doc, label).agg(F.sum("ll").alias("s"))
    base = prior.join(absent, label).select(label, (F.col("log_prior") + F.col("absent")).alias("base"))
    grid = docs.select(doc).crossJoin(F.broadcast(base))
    return grid.join(sums, [doc, label], "left").select(doc, label, (F.col("base") + F.coalesce("s", F.lit(0.0))).alias("score"))


def posterior(scores: DataFrame, doc: str) -> DataFrame:
    """Adds posterior: the softmax of the scores of a document."""
    whole = Window.partitionBy(doc)
    shifted = scores.withColumn("__e", F.exp(F.col("score") - F.max("score").over(whole)))
    return shifted.withColumn("posterior", F.col("__e") / F.sum("__e").over(whole)).drop("__e")


def best(scores: DataFrame, doc: str, label: str, digits: int = 6) -> DataFrame:
    """(doc, label) with the highest score; ties: the least label."""
    return scores.groupBy(doc).agg(F.min_by(label, F.struct((-F.round("score", digits)).alias("s"), F.col(label).alias("l"))).alias(label))


def accuracy(predicted: DataFrame, truth: DataFrame, doc: str, label: str) -> DataFrame:
    joined = predicted.join(truth.select(doc, F.col(label).alias("truth")), doc)
    return joined.agg(F.count("*").alias("n"), F.sum((F.col(label) == F.col("truth")).cast("long")).alias("correct"))


def sweep(docs: DataFrame, tokens: DataFrame, occurrences: DataFrame, presence: DataFrame, scores: DataFrame, prior: DataFrame, sizes: list[int], doc: str, label: str, alpha: float = 1.0) -> DataFrame:
    """(n_words, model, doc, label, score): multinomial and bernoulli scores with the n best words, for all sizes in one pass.

    scores: word, chi2. A word belongs to the first size that has it, so the sums for a size are those of its words and of all
    smaller sizes: documents are joined with the model once, whatever the number of sizes."""
    sizes = sorted(sizes)
    best = features.top(scores, sizes[-1])
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("chi2"), "word")))  # the model's words
    step = F.lit(len(sizes))
    for i in range(len(sizes) - 1, -1, -1):
        step = F.when(F.col("rank") <= sizes[i], i).otherwise(step)
    words = ranked.select("word", step.alias("step"))
    grid = words.crossJoin(F.broadcast(prior.select(label, "n_docs")))
    model = grid.join(occurrences.select("word", label, "n"), ["word", label], "left").join(presence.select("word", label, F.col("n").alias("with")), ["word", label], "left")
    p = (F.coalesce("with", F.lit(0)) + 1) / (F.col("n_docs") + 2)
    model = stage(model.select("word", label, "step", F.coalesce("n", F.lit(0)).alias("n"), p.alias("p")), "sweep-model")
    upto = lambda value, i: F.sum(F.when(F.col("step") <= i, value).otherwise(0.0))
    each = range(len(sizes))
    fixed = model.groupBy(label).agg(*[upto(F.col("n"), i).alias(f"total{i}") for i in each], *[upto(F.lit(1), i).alias(f"size{i}") for i in each], *[upto(F.log(1 - F.col("p")), i).alias(f"absent{i}") for i in each])
    seen = tokens.groupBy(doc, "word").agg(F.count("*").alias("tf")).join(model, "word")
    ll, odds = F.col("tf") * F.log(F.col("n") + alpha), F.log("p") - F.log(1 - F.col("p"))
    sums = seen.groupBy(doc, label).agg(*[upto(ll, i).alias(f"ll{i}") for i in each], *[upto(F.col("tf"), i).alias(f"tf{i}") for i in each], *[upto(odds, i).alias(f"odds{i}") for i in each])
    every = docs.select(doc).crossJoin(F.broadcast(prior.select(label, "log_prior").join(fixed, label))).join(sums, [doc, label], "left")
    nought = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    multinomial = [F.struct(F.lit(n).alias("n_words"), F.lit("multinomial").alias("model"), (F.col("log_prior") + nought(f"ll{i}") - nought(f"tf{i}") * F.log(F.col(f"total{i}") + alpha * F.col(f"size{i}"))).alias("score")) for i, n in enumerate(sizes)]
    bernoulli = [F.struct(F.lit(n).alias("n_words"), F.lit("bernoulli").alias("model"), (F.col("log_prior") + F.col(f"absent{i}") + nought(f"odds{i}")).alias("score")) for i, n in enumerate(sizes)]
    return every.select(doc, label, F.explode(F.array(*multinomial, *bernoulli)).alias("e")).select("e.n_words", "e.model", doc, label, "e.score")
