"""9. Sharding by Karmarkar-Karp differencing.

Rows with equal texts are a group that is never split. Groups of at least 1/(64 shards) of all bytes
are items of their own (so at most 64 x shards of them); all others are dealt by hash into 64 x
shards bins. The items and bins, whose number depends on the shards only, are split by
differencing: the two partial partitions with the largest spread are combined in opposite order,
again and again, until one is left.

Slots: rows of a bin are dealt by a hash of id, size and checksum into pieces of bounded size; rows equal in these are counted
first and are one row of their piece. Counts of pieces are summed in order within each shard, and rows are numbered within
their piece, so no shard, hot group or hot id is sorted in one task.

Law `bytes`: shards' bytes are as near equal as groups that can't be split allow.

Edge cases: a null text has no bytes (size: the overhead) and is grouped with empty texts; a null id
is numbered first in its piece; repeated rows each get a slot; an empty table gives an empty result; texts of any length count
whole and are never shuffled; further columns are not read, whatever their names.
Two texts with one 64-bit hash are put into one group, which only makes that group larger.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordmill.llm.common import stage

OVERHEAD = 16
BINS_PER_SHARD = 64
PIECE_ROWS = 512


def differencing(sizes: list[int], shards: int) -> list[int]:
    """Karmarkar-Karp for any number of parts: the part of each item. O(n log n + n parts log parts)."""
    if not sizes:
        return []
    heap: list[tuple] = []
    for i, size in enumerate(sizes):
        # parts of a partial partition, largest first: (sum, items)
        heap.append((-size, i, [(size, (i,))] + [(0, ())] * (shards - 1)))
    if shards == 1:
        return [0] * len(sizes)
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = sorted(((x + y, (p, q)) for (x, p), (y, q) in zip(a, reversed(b), strict=True)), key=lambda z: -z[0])
        least = joined[-1][0]
        heapq.heappush(heap, (least - joined[0][0], number, [(x - least, p) for x, p in joined]))
        number += 1
    out = [0] * len(sizes)
    for part, (_, items) in enumerate(heap[0][2]):
        todo = [items]
        while todo:
            x = todo.pop()
            if isinstance(x, int):
                out[x] = part
            else:
                todo.extend(x)
    return out


def shard(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size long, text_crc32 long, law string, shard int, slot long, grown_shard int (null)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stage(docs.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(body) + overhead).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("g")), "shard-rows")
    total = rows.agg(F.sum("size").alias("n")).first()["n"] or 0
    bins = shards * BINS_PER_SHARD
    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    large = [r["g"] for r in groups.where(F.col("bytes") >= F.lit(max(1, -(-total // bins)))).select("g").orderBy("g").collect()]  # at most `bins`
    spark = docs.sparkSession
    own = F.broadcast(spark.createDataFrame([(g, bins + i) for i, g in enumerate(large)], "lg long, item int"))
    item = F.coalesce(F.col("item"), F.pmod(F.col("g"), F.lit(bins)).cast("int"))
    summed = groups.join(own, F.col("g") == F.col("lg"), "left").groupBy(item.alias("item")).agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).orderBy("item").collect()  # at most 2 x bins
    part = differencing([r["bytes"] for r in summed], shards)
    known = F.broadcast(spark.createDataFrame([(r["item"], p, max(1, -(-r["rows"] // PIECE_ROWS))) for r, p in zip(summed, part, strict=True)], "i int, shard int, pieces long"))
    placed = rows.join(own, F.col("g") == F.col("lg"), "left").withColumn("item", item).join(known, F.col("item") == F.col("i"))
    same = placed.groupBy("shard", "item", "pieces", "doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    dealt = stage(same.withColumn("piece", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.col("pieces"))).drop("pieces"), "shard-pieces")
    counts = dealt.groupBy("shard", "item", "piece").agg(F.sum("n").alias("rows"))
    upto = Window.partitionBy("shard").orderBy("item", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("rows").over(upto), F.lit(0))).select(F.col("item").alias("si"), F.col("piece").alias("sp"), "start")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("item", "piece").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = dealt.withColumn("inside", before).join(starts, (F.col("item") == F.col("si")) & (F.col("piece") == F.col("sp")))
    each = numbered.select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"), (F.col("start") + F.col("inside")).alias("first"))
    return each.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("copy")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
