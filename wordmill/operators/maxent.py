"""Maximum entropy: joint (word, label) features, GIS training, prediction.

train_gis() keeps weights in tables, for any number of words. GisGrid trains on the best words for several numbers of them
at once: a round is one pass over documents as arrays of word ranks, with the weights (words x labels, a model) broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordmill.plans.staging import stage


def joint_features(tokens: DataFrame, docs: DataFrame, doc: str, label: str) -> DataFrame:
    """(word, label, empirical): features seen in training and how many documents have each."""
    return tokens.select(doc, "word").distinct().join(docs.select(doc, label), doc).groupBy("word", label).agg(F.count("*").cast("double").alias("empirical"))


def _scores(presence: DataFrame, docs: DataFrame, weights: DataFrame, correction: DataFrame, labels: DataFrame, doc: str, label: str, size: float) -> DataFrame:
    """(doc, label, score): sum of weights of the features on, plus the correction feature's share."""
    on = presence.join(weights, "word").groupBy(doc, label).agg(F.sum("weight").alias("s"), F.count("*").alias("hits"))
    grid = docs.select(doc).crossJoin(F.broadcast(labels.join(correction, label)))  # a row for each class
    full = grid.join(on, [doc, label], "left")
    hits = F.coalesce("hits", F.lit(0))
    return full.select(doc, label, hits.alias("hits"), (F.coalesce("s", F.lit(0.0)) + (F.lit(size) - hits) * F.col("correction")).alias("score"))


def posterior(scores: DataFrame, doc: str) -> DataFrame:
    whole = Window.partitionBy(doc)
    e = F.exp(F.col("score") - F.max("score").over(whole))
    return scores.withColumn("__e", e).withColumn("p", F.col("__e") / F.sum("__e").over(whole)).drop("__e")


def train_gis(tokens: DataFrame, docs: DataFrame, doc: str, label: str, rounds: int = 40, rate_size: float | None = None) -> tuple[DataFrame, DataFrame, float]:
    """Generalised iterative scaling: each round is one join and two aggregates; weights are written out
    every round, so lineage does not grow. Returns (weights: word, label, weight; correction: label,
    correction; size). size is the largest number of features of a document plus one."""
    presence = stage(tokens.select(doc, "word").distinct(), "maxent-presence")
    docs = stage(docs.select(doc, label), "maxent-docs")
    labels = stage(docs.select(label).distinct(), "maxent-labels")
    features = stage(joint_features(presence, docs, doc, label), "maxent-features")
    most = presence.groupBy(doc).agg(F.count("*").alias("n")).agg(F.max("n").alias("m")).first()["m"] or 0
    size = float(rate_size or most + 1)
    own = presence.join(docs, doc).join(features.select("word", label), ["word", label]).groupBy(doc, label).agg(F.count("*").alias("hits"))
    slack = docs.join(own, [doc, label], "left").groupBy(label).agg(F.sum(F.lit(size) - F.coalesce("hits", F.lit(0))).alias("empirical"))
    weights = stage(features.select("word", label, "empirical", F.lit(0.0).alias("weight")), "maxent-weights")
    correction = stage(slack.select(label, "empirical", F.lit(0.0).alias("correction")), "maxent-correction")
    for _ in range(rounds):
        p = posterior(_scores(presence, docs, weights, correction, labels, doc, label, size), doc)
        expected = presence.join(p, doc).groupBy("word", label).agg(F.sum("p").alias("expected"))
        new = weights.join(expected, ["word", label], "left")
        step = (F.log("empirical") - F.log(F.coalesce("expected", F.lit(1e-300)))) / size
        fresh = p.groupBy(label).agg(F.sum(F.col("p") * (F.lit(size) - F.col("hits"))).alias("expected"))
        weights = stage(new.select("word", label, "empirical", (F.col("weight") + step).alias("weight")), "maxent-weights")
        correction = stage(correction.join(fresh, label).select(label, "empirical", (F.col("correction") + F.when(F.col("empirical") > 0, (F.log("empirical") - F.log("expected")) / size).otherwise(0.0)).alias("correction")), "maxent-correction")
    return weights.select("word", label, "weight"), correction.select(label, "correction"), size


def predict(tokens: DataFrame, docs: DataFrame, model: tuple[DataFrame, DataFrame, float], doc: str, label: str) -> DataFrame:
    """(doc, label, p) for every document and class."""
    weights, correction, size = model
    presence = tokens.select(doc, "word").distinct()
    return posterior(_scores(presence, docs, weights, correction, correction.select(label), doc, label, size), doc).select(doc, label, "p")


def log_likelihood(predicted: DataFrame, docs: DataFrame, doc: str, label: str) -> DataFrame:
    return predicted.join(docs.select(doc, label), [doc, label]).agg(F.sum(F.log("p")).alias("ll"))


def logistic(features: DataFrame, label: str = "label", column: str = "features", ridge: float = 0.01):
    """Multinomial logistic regression by L-BFGS, in place of an external optimiser."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(family="multinomial", labelCol=label, featuresCol=column, regParam=ridge, maxIter=50).fit(features)


class GisGrid:
    """GIS with the best n words, for each n of sizes. rows: label, ranks array<int> (distinct ranks, from 0, of a document's words)."""

    #: Numbers in a row of partial sums.
    CHUNK = 1 << 14

    def __init__(self, rows: DataFrame, sizes: list[int], label: str = "label"):
        self.rows, self.sizes, self.label = rows, sorted(sizes), label
        self.labels = sorted(r[0] for r in rows.select(label).distinct().collect())  # the model's classes
        below = lambda n: F.size(F.filter("ranks", lambda r: r < n))
        found = rows.agg(F.max(F.array_max("ranks")).alias("top"), *[F.max(below(n)).alias(f"m{n}") for n in self.sizes]).first()
        self.words = min(self.sizes[-1], (found["top"] if found["top"] is not None else -1) + 1)
        self.most = [float((found[f"m{n}"] or 0) + 1) for n in self.sizes]  # the correction constant of each size
        self.shapes = [(min(n, self.words), len(self.labels)) for n in self.sizes]
        counts = self._sums(None)
        self.seen = [c > 0 for c, _ in counts]
        self.weights = [np.zeros(s) for s in self.shapes]
        self.correction = [np.zeros(len(self.labels)) for _ in self.sizes]
        self.empirical = self._sums("truth")

    def _sums(self, how: str | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each size: sums by (word, label), and by label of what the correction features have. None: occurrences; truth:
        of the documents' own labels; model: weighted with their probabilities."""
        shapes, label, labels, most = self.shapes, self.label, self.labels, self.most
        model = (getattr(self, "seen", None), getattr(self, "weights", None), getattr(self, "correction", None))
        shared = self.rows.sparkSession.sparkContext.broadcast(model)
        chunk = self.CHUNK

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen, weights, correction = shared.value
            total = [(np.zeros(s), np.zeros(s[1])) for s in shapes]
            place = {x: i for i, x in enumerate(labels)}
            for pdf in batches:
                ranks = [np.asarray(r, np.int64) for r in pdf["ranks"]]
                own = np.array([place[x] for x in pdf[label]], np.int64)
                size = np.array([len(r) for r in ranks])
                flat, row = (np.concatenate(ranks) if len(ranks) else np.zeros(0, np.int64)), np.repeat(np.arange(len(ranks)), size)
                truth = np.eye(len(labels))[own]
                for k, (n, _) in enumerate(shapes):
                    at, of = flat[flat < n], row[flat < n]
                    if how is None:
                        p, on = truth, np.ones((len(at), len(labels)))
                    else:
                        on = seen[k][at]
                        hits = add_rows(on, of, len(ranks))
                        p = truth if how == "truth" else softmax(add_rows(weights[k][at] * on, of, len(ranks)) + (most[k] - hits) * correction[k])
                        total[k][1][:] += (p * (most[k] - hits)).sum(axis=0)
                    for j in range(len(labels)):
                        total[k][0][:, j] += np.bincount(at, p[of, j] * on[:, j], n)
            vector = np.concatenate([np.concatenate([a.ravel(), b]) for a, b in total])
            for i in range(0, len(vector), chunk):
                yield pd.DataFrame({"i": [i // chunk], "v": [vector[i : i + chunk]]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"i": [pdf["i"].iloc[0]], "v": [np.sum(np.stack(pdf["v"].to_numpy()), axis=0)]})

        parts = self.rows.select(label, "ranks").mapInPandas(run, "i int, v array<double>").groupBy("i").applyInPandas(add, "i int, v array<double>")
        vector = np.concatenate([np.array(r["v"]) for r in sorted(parts.collect(), key=lambda r: r["i"])])  # as large as the model
        out, at = [], 0
        for n, m in shapes:
            out.append((vector[at : at + n * m].reshape(n, m), vector[at + n * m : at + n * m + m]))
            at += n * m + m
        shared.destroy()
        return out

    def train(self, rounds: int = 40) -> GisGrid:
        for _ in range(rounds):
            for k, ((want, slack), (have, fresh)) in enumerate(zip(self.empirical, self._sums("model"), strict=True)):
                on = self.seen[k]
                self.weights[k][on] += (np.log(want[on]) - np.log(np.maximum(have[on], 1e-300))) / self.most[k]
                some = slack > 0
                self.correction[k][some] += (np.log(slack[some]) - np.log(fresh[some])) / self.most[k]
        return self

    def predict(self, rows: DataFrame, doc: str) -> DataFrame:
        """(n_words, doc, label, p) for every row (doc, ranks), size and class."""
        shared = self.rows.sparkSession.sparkContext.broadcast((self.seen, self.weights, self.correction))
        sizes, shapes, labels, most = self.sizes, self.shapes, self.labels, self.most

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen, weights, correction = shared.value
            for pdf in batches:
                ranks = [np.asarray(r, np.int64) for r in pdf["ranks"]]
                flat, row = (np.concatenate(ranks) if len(ranks) else np.zeros(0, np.int64)), np.repeat(np.arange(len(ranks)), [len(r) for r in ranks])
                for k, (n, _) in enumerate(shapes):
                    at, of = flat[flat < n], row[flat < n]
                    hits = add_rows(seen[k][at].astype(float), of, len(ranks))
                    p = softmax(add_rows(weights[k][at] * seen[k][at], of, len(ranks)) + (most[k] - hits) * correction[k])
                    yield pd.DataFrame({"n_words": sizes[k], doc: np.repeat(pdf[doc].to_numpy(), len(labels)), "label": labels * len(pdf), "p": p.ravel()})

        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        own = self.rows.schema[self.label].dataType.simpleString()
        return rows.select(doc, "ranks").mapInPandas(run, f"n_words int, `{doc}` {kinds[doc]}, label {own}, p double")


def add_rows(values: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    """Sums of the lines of values that belong to each row."""
    return np.stack([np.bincount(of, values[:, j], rows) for j in range(values.shape[1])], axis=1)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def ranked(tokens: DataFrame, docs: DataFrame, words: DataFrame, doc: str) -> DataFrame:
    """docs with ranks array<int>: the distinct ranks of its words. words: word, rank (a model's)."""
    own = tokens.select(doc, "word").distinct().join(words.select("word", "rank"), "word").groupBy(doc).agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    return docs.join(own, doc, "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<int>")))
