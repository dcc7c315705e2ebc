"""8. Mixing sources to target weights, in native DataFrame operations.

Targets: sources by code point (null last) have the weights in turn and share `share` of all words; a
target stops at `limit` times its source's size and the excess is shared again by weight until none
is above. In closed form: sources by (cap / weight) are filled in turn, which one running sum finds.

The mix: every row gets a hash-random key; a source's rows are cut into equal ranges of the key
(a range holds a bounded number of rows whatever the source's size), the ranges' word counts are
summed in order, and the exact cut is found by sorting only the range that the budget ends in. Full
epochs come first; the rest of the budget is the rows before the cut. A decision is thus a
comparison with its source's cut, and texts are never shuffled.

Edge cases: null text has size 0 and is taken 0 times; a null source is a source of its own, last;
sources with no words have target 0; rows that are equal in id, text and source are taken together or
left together; an empty table gives an empty result; texts of any length are counted whole and never shuffled;
further columns keep their values whatever their names. Keys depend on id and text only,
so that reruns agree whatever the partitions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordmill.llm.common import stage, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, LIMIT = 1.5, 2.0
#: Rows of a source in one range of keys, about; sources up to this many are joined by broadcast.
RANGE_ROWS, BROADCAST_SOURCES = 4096, 10_000
KEY_BITS = 48


def sort_key(key: Column, text: Column) -> Column:
    """Uniform in 0 to 2**48 - 1: the leading 48 bits of the MD5 of id and text."""
    seed = F.concat_ws("\u0001", F.coalesce(key.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(seed.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """source, source_size, rows -> and target double. One row a source goes in and out."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sources.withColumn("w", F.element_at(F.lit(list(weights)).cast("array<double>"), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    weighted = weighted.withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    order = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    level = weighted.withColumn("level", left / F.sum("w").over(onward)).withColumn("capped", F.col("level") >= F.col("cap") / F.col("w"))
    # the first that is not capped has the highest level of those, which holds from there on
    shared = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)
    return level.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(shared * F.col("w"))).drop("w", "cap", "level", "capped")


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, k for each row."""
    return docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), sort_key(F.col(key), F.col(text)).alias("k"))


def plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """A row for each source: source, source_size, target, epochs (full passes), and cut_k: the last
    pass takes rows whose key is less."""
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, share, limit)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(0).cast("long")
    sources = sources.withColumn("epochs", full).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("ranges", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(RANGE_ROWS))).cast("long"))
    sources = stage(sources, "mix-sources")
    few = sources.count() <= BROADCAST_SOURCES
    per = F.broadcast(sources) if few else sources
    place = F.floor(F.col("k") / F.lit(float(1 << KEY_BITS)) * F.col("ranges")).cast("long")
    ranged = rows.join(per, rows["source"].eqNullSafe(sources["source"])).select(rows["source"], "size", "k", "rest", place.alias("range"))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = sums.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    ends = ends.select(F.col("source").alias("s"), F.col("range").alias("r"), "before")
    ends = F.broadcast(ends) if few else ends  # a row for each source at most
    inside = ranged.join(ends, ranged["source"].eqNullSafe(ends["s"]) & (F.col("range") == F.col("r")))
    # rows of one key (equal in id and text) are one block
    blocks = inside.groupBy("source", "k", "rest", "before").agg(F.sum("size").alias("size"))
    by_key = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(by_key), F.lit(0))
    # a block is taken if that brings the words nearer to the budget than leaving it
    left_out = blocks.withColumn("start", start).where(F.col("start") + F.col("size") / 2 > F.col("rest"))
    cut = left_out.groupBy(F.col("source").alias("s")).agg(F.min("k").alias("cut_k"))
    # the whole range is taken if even its last block brings the words nearer
    after = ends.join(sources, ends["s"].eqNullSafe(sources["source"])).select("s", ((F.col("r") + 1) * F.lit(float(1 << KEY_BITS)) / F.col("ranges")).cast("long").alias("end_k"))
    out = sources.join(cut, sources["source"].eqNullSafe(cut["s"]), "left").drop("s")
    out = out.join(after, out["source"].eqNullSafe(after["s"]), "left")
    return out.select("source", "source_size", "target", "epochs", F.coalesce("cut_k", "end_k").alias("cut_k"))


def decided(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """rows with source_size, target and times (how often the mix takes the row)."""
    few = plans.count() <= BROADCAST_SOURCES
    per = plans.withColumnRenamed("source", "__s")
    out = rows.join(F.broadcast(per) if few else per, rows["source"].eqNullSafe(F.col("__s")), "left").drop("__s")
    return out.withColumn("times", F.when(F.col("size") == 0, 0).otherwise(F.col("epochs") + F.when(F.col("k") < F.col("cut_k"), 1).otherwise(0)).cast("long"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs."""
    rows = stage(keyed(docs, key, text, source), "mix-rows")
    out = decided(rows, stage(plan(rows, weights, share, limit), "mix-plan"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """The mix itself: rows of docs as often as they are taken, with all their columns, no text shuffled."""
    rows = stage(keyed(docs, key, text, source), "mix-rows")
    plans = stage(plan(rows, weights, share, limit), "mix-plan")
    fresh = uuid.uuid4().hex  # helper columns clash with none of docs
    s, e, c, t, x = (f"{n}_{fresh}" for n in "sectx")
    per = plans.select(F.col("source").alias(s), F.col("epochs").alias(e), F.col("cut_k").alias(c))
    per = F.broadcast(per) if per.count() <= BROADCAST_SOURCES else per
    joined = docs.join(per, docs[f"`{source}`"].cast("string").eqNullSafe(F.col(s)))
    body = docs[f"`{text}`"]
    times = F.when(~F.coalesce(body.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)), 0).otherwise(F.col(e) + F.when(sort_key(docs[f"`{key}`"], body) < F.col(c), 1).otherwise(0))
    return joined.withColumn(t, times.cast("int")).where(F.col(t) > 0).withColumn(x, F.explode(F.sequence(F.lit(1), F.col(t)))).select(*[F.col(f"`{n}`") for n in docs.columns])
