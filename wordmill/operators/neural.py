"""Feature preparation and pyspark.ml substitutes for the neural models."""

from __future__ import annotations

from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNKNOWN, PAD = "U", "P"


def word_vectors(docs: DataFrame, words: str, size: int = 100, window: int = 4, least: int = 3, rounds: int = 1, seed: int = 1):
    return Word2Vec(vectorSize=size, windowSize=window, minCount=least, maxIter=rounds, seed=seed, inputCol=words, outputCol="vector").fit(docs)


def window_ids(frames: DataFrame, vocabulary: DataFrame, frame: str = "frame", name: str = "ids") -> DataFrame:
    """ids array<int>: the characters of a frame as ids, unknown ones as 0 (a map of the vocabulary's
    top words: its size is the model's)."""
    known = vocabulary.agg(F.map_from_entries(F.collect_list(F.struct("word", "word_id"))).alias("m"))
    listed = frames.crossJoin(F.broadcast(known))  # one row
    return listed.withColumn(name, F.transform(F.regexp_extract_all(frame, F.lit(r"([\s\S])"), F.lit(1)), lambda c: F.coalesce(F.col("m")[c], F.lit(0)))).drop("m")


def perceptron(features: DataFrame, layers: list[int], label: str = "label", column: str = "features", seed: int = 1):
    """Feed-forward classifier (sigmoid hidden layers, in place of tanh ones)."""
    return MultilayerPerceptronClassifier(layers=layers, labelCol=label, featuresCol=column, maxIter=50, seed=seed).fit(features)


def next_character_model(histories: DataFrame) -> DataFrame:
    """(history, next, n, p): an n-gram model over histories, in place of a recurrent generator."""
    counts = histories.groupBy("history", "next").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("history")))


def generate(model: DataFrame, start: str, length: int) -> str:
    """The likeliest continuation, character by character (a lookup for each; demonstration only)."""
    size, out = len(start), start
    for _ in range(length):
        row = model.where(F.col("history") == out[-size:]).orderBy(F.desc("p"), "next").select("next").first()
        if row is None:
            break
        out += row["next"]
    return out
