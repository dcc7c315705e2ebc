"""Splits, accuracy and segmentation scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordmill.operators.vocab import number_rows
from wordmill.plans.staging import stage


def hash_split(rows: DataFrame, key: str, share: float, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a hash of the key: stable, no shuffle, the share is met on average."""
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000))
    return rows.where(place < share * 1_000_000), rows.where(place >= share * 1_000_000)


def every_nth(rows: DataFrame, key: str, n: int = 30) -> tuple[DataFrame, DataFrame]:
    """(train, test): rows whose dense id is a multiple of n are held out."""
    held = F.pmod(F.col(key), F.lit(n)) == 0
    return rows.where(~held), rows.where(held)


def spans(rows: DataFrame, key: str, words: str) -> DataFrame:
    """(key, word, start, stop) of the words of each row in their joined text; full-width spaces count as blanks."""
    clean = F.filter(F.transform(F.col(words), lambda w: F.replace(w, F.lit("\u3000"), F.lit(""))), lambda w: w != "")
    each = rows.select(key, F.posexplode(clean).alias("pos", "word"))
    stop = F.sum(F.char_length("word")).over(Window.partitionBy(key).orderBy("pos"))
    return each.withColumn("stop", stop).select(key, "word", (F.col("stop") - F.char_length("word")).alias("start"), "stop")


def _matched(batch: pa.RecordBatch):
    """Spans of the words of a batch of rows (truth, output), row by row, by whole arrays: the truth's words and which of them are right, and the numbers
    of both sides' words, of right ones, insertions, deletions and substitutions."""
    sides = []
    for side in ("truth", "output"):
        lists = batch.column(side)
        flat = pc.fill_null(pc.replace_substring(lists.flatten(), "\u3000", ""), "")
        size = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        keep = size > 0
        sides.append((flat.filter(pa.array(keep)), row[keep], size[keep]))
    total = [np.bincount(row, size, len(batch)).astype(np.int64) for _, row, size in sides]
    base = np.concatenate(([0], np.cumsum(np.maximum(*total) + 1)))  # rows' texts one after the other, as long as the longer side
    starts = []
    for (_, row, size), own in zip(sides, total, strict=True):
        before = np.cumsum(own) - own
        starts.append(np.cumsum(size) - size - before[row] + base[row])
    (words, row_w, size_w), (_, row_g, size_g) = sides
    start_w, start_g = starts
    at = np.searchsorted(start_g, start_w)
    near = np.minimum(at, max(0, len(start_g) - 1))
    ok = (start_g[near] == start_w) & (size_g[near] == size_w) if len(start_g) else np.zeros(len(start_w), bool)
    mark = np.zeros(len(start_g), bool)
    mark[near[ok]] = True
    both = start_w[ok]
    gap_w, gap_g = (np.searchsorted(both, start[~hit]) + row[~hit] for start, hit, row in ((start_w, ok, row_w), (start_g, mark, row_g)))
    many = len(both) + len(batch) + 1
    d, i = np.bincount(gap_w, minlength=many), np.bincount(gap_g, minlength=many)
    told = {"n_truth": len(start_w), "n_output": len(start_g), "n_right": len(both), "insertions": np.maximum(i - d, 0).sum(), "deletions": np.maximum(d - i, 0).sum(), "substitutions": np.minimum(d, i).sum()}
    return words, ok, {k: int(v) for k, v in told.items()}


def _pieces(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[pa.RecordBatch]:
    """A few rows at a time."""
    for batch in batches:
        for k in range(0, len(batch), most):
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(k, most)]) for c in batch.columns], schema=batch.schema)


def _compared(rows: DataFrame, truth: str, output: str) -> DataFrame:
    """One row: sums of _matched() over all rows; a row is compared where it is, nothing but counts is shuffled."""
    names = ["n_truth", "n_output", "n_right", "insertions", "deletions", "substitutions"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            yield pa.RecordBatch.from_pylist([_matched(batch)[2]], pa.schema([(n, pa.int64()) for n in names]))

    told = rows.select(F.col(truth).alias("truth"), F.col(output).alias("output")).mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return told.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def _words_right(rows: DataFrame, truth: str, output: str) -> DataFrame:
    """(word, n, ok): how often the truth has each word, and how often it is right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            words, ok, _ = _matched(batch)
            coded = words.dictionary_encode()
            at, many = coded.indices.to_numpy(), len(coded.dictionary)
            yield pa.RecordBatch.from_arrays([coded.dictionary, *[pa.array(np.bincount(x, minlength=many).astype(np.int64)) for x in (at, at[ok])]], ["word", "n", "ok"])

    each = rows.select(F.col(truth).alias("truth"), F.col(output).alias("output")).mapInArrow(run, "word string, n long, ok long")
    return each.groupBy("word").agg(F.sum("n").alias("n"), F.sum("ok").alias("ok"))


def segmentation_score(rows: DataFrame, key: str, truth: str, output: str, known: DataFrame | None = None) -> DataFrame:
    """One row: n_truth, n_output, n_right, recall, precision, f (and oov_rate, oov_recall, iv_recall for
    known words). Words are right where their spans are equal. key: a row for each."""
    total = _compared(rows, truth, output).select("n_truth", "n_output", "n_right")
    r, p = F.col("n_right") / F.col("n_truth"), F.col("n_right") / F.col("n_output")
    scored = total.withColumn("recall", F.round(r, 9)).withColumn("precision", F.round(p, 9)).withColumn("f", F.round(2 * p * r / (p + r), 9))
    if known is None:
        return scored
    marked = _words_right(rows, truth, output).join(known.select("word").distinct().withColumn("iv", F.lit(True)), "word", "left")
    oov = F.col("iv").isNull()
    of = lambda c, ok: F.sum(F.when(ok, F.col(c))) / F.sum(F.when(ok, F.col("n")))
    rates = marked.agg((F.coalesce(F.sum(F.when(oov, F.col("n"))), F.lit(0)) / F.sum("n")).alias("oov_rate"), of("ok", oov).alias("oov_recall"), of("ok", ~oov).alias("iv_recall"))
    return scored.crossJoin(rates)  # one row each


def right(predicted: Column, truth: Column) -> Column:
    return F.avg((predicted == truth).cast("double"))


def ratio_split(rows: DataFrame, label: str, share: float, *order: str, first: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test): of each class, in the given order, the first share of the first class's number of rows, and the last 1 - share
    of it. first: that class (default: the least label). Numbers come from one range sort, no class is sorted in one task."""
    placed = stage(number_rows(rows, label, *order, name="__i"), "ratio-split")
    sizes = {r[label]: (r["low"], r["n"]) for r in placed.groupBy(label).agg(F.min("__i").alias("low"), F.count("*").alias("n")).collect()}  # a row for each class
    if not sizes:
        return placed.drop("__i"), placed.drop("__i")
    base = sizes[min(sizes) if first is None else first][1]
    head, tail = int(base * share), base - int(base * share)
    bounds = F.create_map(*[F.lit(x) for name, (low, _) in sizes.items() for x in (name, low)]), F.create_map(*[F.lit(x) for name, (low, n) in sizes.items() for x in (name, low + n)])
    low, high = bounds[0][F.col(label)], bounds[1][F.col(label)]
    return placed.where(F.col("__i") < low + head).drop("__i"), placed.where(F.col("__i") >= high - tail).drop("__i")


def segmentation_edits(rows: DataFrame, key: str, truth: str, output: str) -> DataFrame:
    """One row: insertions, deletions, substitutions. Between two words that both sides have, with d words of the truth and i of
    the output, min(d, i) are substitutions, the rest deletions or insertions. key: a row for each."""
    return _compared(rows, truth, output).select("insertions", "deletions", "substitutions")
