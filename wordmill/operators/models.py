"""Classifiers of pyspark.ml behind one name each, and grids over methods and numbers of features."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.operators import features

#: Stands for its namesake; a nu-SVC has no counterpart in Spark.
METHODS = {
    "multinomial_nb": lambda: NaiveBayes(modelType="multinomial"),
    "bernoulli_nb": lambda: NaiveBayes(modelType="bernoulli"),
    "logistic": lambda: LogisticRegression(maxIter=30, regParam=0.01),
    "linear_svc": lambda: OneVsRest(classifier=LinearSVC(maxIter=20, regParam=0.01)),
}


def presence_vectors(docs: DataFrame, words: list[str], column: str = "words") -> DataFrame:
    """Adds features: presence of each of the words (a model of bounded size)."""
    model = CountVectorizerModel.from_vocabulary(words, inputCol=column, outputCol="features")
    return model.setBinary(True).transform(docs)


def one_hot(label: Column, values: list[str]) -> Column:
    """array<double>: 1 at the place of the label among values (all 0 for another)."""
    return F.array(*[F.coalesce((label == v).cast("double"), F.lit(0.0)) for v in values])


def fit(method: str, featured: DataFrame, label: str = "label"):
    return METHODS[method]().setLabelCol(label).setFeaturesCol("features").fit(featured)


def grid(train: DataFrame, test: DataFrame, counts: DataFrame, methods: list[str], sizes: list[int], label: str = "label") -> DataFrame:
    """(method, n_words, n, correct): held-out results of each method with the n best words by chi-square.

    train, test: words array<string>, label double. A row of the result for each fit."""
    best = [r["word"] for r in features.top(features.chi_square(counts, label), max(sizes)).collect()]  # the model's words
    out = None
    for size in sizes:
        own, held = presence_vectors(train, best[:size]).select("features", label).persist(), presence_vectors(test, best[:size])
        for method in methods:
            told = fit(method, own, label).transform(held)
            row = told.agg(F.count("*").alias("n"), F.sum((F.col("prediction") == F.col(label)).cast("long")).alias("correct")).select(F.lit(method).alias("method"), F.lit(size).alias("n_words"), "n", "correct")
            out = row if out is None else out.unionByName(row)
        own.unpersist()
    return out
