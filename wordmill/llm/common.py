"""Helpers shared by the training-data operators: staging in the shared folder, Arrow slices."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.plans.staging import fresh_path, release, remove, shared_folder, stage

__all__ = ["fresh_path", "release", "remaining", "remove", "row_key", "shared_folder", "slices", "small_batches", "stage", "utf8", "word_count"]

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Text bytes that a Python worker holds as objects at a time.
SLICE_BYTES = 4 << 20

#: The white space of the word contracts: space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Keys of rows that are broadcast at once, at most; more are joined by a shuffle.
BROADCAST_KEYS = 1 << 18


def row_key(docs: DataFrame, key: str, text: str) -> tuple[Column, Column]:
    """What tells rows apart: the id (long, maybe null) and the MD5 of the text (null is empty)."""
    return docs[f"`{key}`"].cast("long"), F.unhex(F.md5(F.coalesce(docs[f"`{text}`"], F.lit("")).cast("binary")))


def remaining(docs: DataFrame, id_of: Column, digest_of: Column, gone: DataFrame, again: DataFrame) -> DataFrame:
    """docs without the rows whose key (row_key()) is in gone, and with one row for each key in again.

    gone and again: doc_id, digest. Texts are not shuffled where the keys are at most BROADCAST_KEYS. Of rows with one key
    in again, that with the least hash of all its columns stays; helper columns have fresh names."""
    mark = uuid.uuid4().hex
    i, d = f"id_{mark}", f"digest_{mark}"
    repeated = again.count()
    out = [gone.select(F.col("doc_id").alias(f"g{i}"), F.col("digest").alias(f"g{d}"))]
    out += [again.select(F.col("doc_id").alias(f"g{i}"), F.col("digest").alias(f"g{d}"))] if repeated else []
    keys = out[0] if not repeated else out[0].unionByName(out[1])
    small = gone.count() + repeated <= BROADCAST_KEYS
    keyed = docs.select("*", id_of.alias(i), digest_of.alias(d))
    join = lambda other, how: keyed.join(F.broadcast(other) if small else other.hint("merge"), F.col(i).eqNullSafe(F.col(f"g{i}")) & (F.col(d) == F.col(f"g{d}")), how)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    left = join(keys, "left_anti").select(*columns)
    if not repeated:
        return left
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    one = join(out[1], "left_semi").groupBy(i, d).agg(F.min_by(F.struct(*columns), F.xxhash64(*hashed)).alias("row"))
    return left.unionByName(one.select("row.*"))


def small_batches(spark: SparkSession) -> None:
    """Rows of text come to Python by the thousand, not by ten thousand (unless the session says otherwise):
    both sides hold a whole record batch in memory, and texts are long."""
    if spark.conf.get(BATCH_ROWS, "10000") == "10000":
        spark.conf.set(BATCH_ROWS, "1000")


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text of each piece stays near limit bytes (one row at least)."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            total += n or 0
            if total >= limit:
                yield batch.slice(start, i + 1 - start)
                start, total = i + 1, 0
        if start < len(sizes):
            yield batch.slice(start)
        del batch
        pa.default_memory_pool().release_unused()


def utf8(column: pa.Array) -> list[bytes]:
    """The values as UTF-8 bytes; null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def word_count(column):
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null counts as 0."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
