"""Scoring and counting over streams: stateless scoring with a static model, optional event-time counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.operators.tokens import unicode_words


def requests(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of request rows from Parquet files; files_per_trigger is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def socket_requests(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines of a socket, for demonstrations."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load().withColumnRenamed("value", "text")


def score_with_lists(rows: DataFrame, positive: list[str], negative: list[str], text: str = "text") -> DataFrame:
    """Adds n_tokens and score (positive less negative words): stateless, the same for batch and stream."""
    words = unicode_words(F.col(text))
    hits = lambda known: F.size(F.filter(words, lambda w: w.isin(*known)))
    return rows.withColumns({"n_tokens": F.size(words), "score": hits(positive) - hits(negative)})


def score_stream(stream: DataFrame, apply, sink: str, checkpoint: str):
    """Apply a batch function to each micro-batch and append it to Parquet; a batch that is run again
    writes the same folder, so replies are exactly once. An empty request gets its empty result."""

    def write(batch: DataFrame, number: int) -> None:
        apply(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, by: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event-time window; rows later than the watermark are dropped by a stream."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
