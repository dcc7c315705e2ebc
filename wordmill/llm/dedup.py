"""5. Exact dedup against a persistent digest index.

The index is a table of digests, bucketed and sorted by digest. A batch is deduplicated within
itself (one aggregate, combined before the shuffle), joined against the index by a sort-merge
anti-join (the index side is neither shuffled nor sorted again), and its new digests are appended.

Texts are equal when they are identical after deleting every character of [\\x20\\x09-\\x0D]. Of equal
texts the row with the most code points, then the least id, stays. Earlier calls win over later ones. Within
a call, rows go to the index in batches, long texts first, so that what a batch finds in the index has won.

Edge cases: null text counts as empty; a null id is after all others; of rows that are equal in id,
digest and length that of the least MD5 of its text is kept, and exactly one; an empty batch appends nothing. Texts of
any length are hashed whole; further columns keep their values whatever their names. Copies never meet in one
task by text: groups of any size are aggregated, and the join back to rows is one whose skewed
partitions Spark splits.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.llm.common import remaining, remove, row_key, shared_folder, stage

WHITE = "\t\n\x0b\x0c\r "
LAST = 2**63 - 1
#: Batches in which the rows of a call go to the index.
BATCHES = 2


def normalised(text):
    """Column: the text without white space of [\\x20\\x09-\\x0D]; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id long, digest binary (SHA-256 of the normalised text), n_chars long, raw binary (MD5 of the text); one scan."""
    id_of, raw = row_key(docs, key, text)
    return docs.select(id_of.alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text)).cast("binary"), 256)).alias("digest"), F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n_chars"), raw.alias("raw"))


class DigestIndex:
    """A bucketed, sorted table of (digest, keep_id, keep_chars, keep_raw, batch); made when it is first appended to."""

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None, path: str | None = None):
        self.spark = spark
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or max(1, min(4096, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        self.path = path or f"{shared_folder(spark)}/{self.table}"

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], "digest binary, keep_id long, keep_chars long, keep_raw binary, batch string")
        return self.spark.table(self.table)

    def add(self, rows: DataFrame) -> str:
        """Deduplicate rows of digests() and append the digests the index does not have; the batch's name.

        Run again with the same rows (after a failure between two batches), it appends nothing."""
        batch = uuid.uuid4().hex
        best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.coalesce("doc_id", F.lit(LAST)).alias("id"), "raw")).alias("b")
        groups = rows.groupBy("digest").agg(best)
        new = groups.select("digest", F.nullif(F.col("b.id"), F.lit(LAST)).alias("keep_id"), (-F.col("b.n")).alias("keep_chars"), F.col("b.raw").alias("keep_raw"), F.lit(batch).alias("batch"))
        if self.exists():
            known = self.read().select("digest").hint("merge")
            new = new.join(known, "digest", "left_anti")
        new.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).mode("append").format("parquet").saveAsTable(self.table)
        return batch

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        remove(self.spark, self.path)


def bands(rows: DataFrame, batches: int) -> list[DataFrame]:
    """Rows of digests() cut by length into at most so many batches, long texts first; one length is in one batch."""
    found = rows.select(F.percentile_approx("n_chars", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] if batches > 1 else []
    cuts = sorted({c for c in found or [] if c > 0}, reverse=True)
    tops, ends = [None, *cuts], [*cuts, 0]
    return [rows.where((F.col("n_chars") >= low) & (F.lit(True) if top is None else F.col("n_chars") < top)) for top, low in zip(tops, ends, strict=True)]


def mark(rows: DataFrame, index: DigestIndex, batches: list[str]) -> DataFrame:
    """A row for each row of digests(), which the index has got as these batches: doc_id, keep_id, group_size (within rows), kept, digest, raw.

    A row is kept if one of these batches made the index's entry from it. Rows are first counted by (digest, id,
    length, text), which is even whatever the groups' sizes; the groups are joined to these counts, not to texts."""
    same = rows.groupBy("digest", "doc_id", "n_chars", "raw").agg(F.count("*").alias("n"))
    sizes = same.groupBy("digest").agg(F.sum("n").alias("group_size"))
    # a row of `same` for each distinct (digest, id, length, text): a group of any size is split by Spark's skew join
    entries = index.read().select("digest", "keep_id", "keep_chars", "keep_raw", F.col("batch").isin(*batches).alias("mine"))
    found = stage(entries.join(sizes, "digest"), "digest-groups")
    first = F.col("mine") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars")) & (F.col("raw") == F.col("keep_raw"))
    return same.join(found.hint("merge"), "digest").select("doc_id", "keep_id", "group_size", first.alias("kept"), "digest", "raw", "n")


def indexed(docs: DataFrame, key: str, text: str, index: DigestIndex | None, batches: int) -> DataFrame:
    """mark() of docs, which go to the index (None: one for this call alone, dropped again) in batches."""
    own = index or DigestIndex(docs.sparkSession)
    rows = stage(digests(docs, key, text), "digests")
    marked = mark(rows, own, [own.add(band) for band in bands(rows, batches)])
    if index is None:
        own.drop()  # mark() has written what it takes from the index
    return marked


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", index: DigestIndex | None = None, batches: int = BATCHES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs, dropped ones too."""
    marked = indexed(docs, key, text, index, batches)
    copy = F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))
    each = marked.select("doc_id", "keep_id", "group_size", "kept", copy.alias("copy"), "digest")
    return each.select("doc_id", "keep_id", "group_size", (F.col("kept") & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", index: DigestIndex | None = None, batches: int = BATCHES) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    marked = indexed(docs, key, text, index, batches)
    told = stage(marked.where("not kept or n > 1").select("doc_id", F.col("raw").alias("digest"), "kept"), "digest-told")
    return remaining(docs, *row_key(docs, key, text), told.where("not kept"), told.where("kept"))
