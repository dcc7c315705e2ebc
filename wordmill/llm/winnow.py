"""3. Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; of each window of w hashes the least is chosen, the
rightmost if several are equal. Chosen hashes are kept with their positions, so that any passage
of at least w + k - 1 code points that two texts share leaves a common hash in both, at a known place.

Edge cases: a null text is the empty text, whose fingerprint is empty; a text of fewer than k
code points has the hash of the whole text at position 0; fewer than w hashes are one window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmill.llm import order
from wordmill.llm.common import slices, small_batches

K, W = 16, 32
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def kgram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash (modulo 2**64, then mixed) of each k-gram. Hashes of 2n-grams are made from
    two of n-grams, so a hash takes about log2 k steps over the whole text."""
    def span(size: int) -> tuple[np.ndarray, int]:
        if size == 1:
            return points.astype(np.uint64) + np.uint64(1), BASE
        half, power = span(size // 2)
        out = half[: len(half) - size // 2] * np.uint64(power) + half[size // 2 :]
        power = power * power & MASK
        if size % 2:
            out = out[:-1] * np.uint64(BASE) + (points[size - 1 :].astype(np.uint64) + np.uint64(1))
            power = power * BASE & MASK
        return out, power

    h = span(k)[0]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Positions chosen: of each window the least hash, the rightmost of equal ones."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    w = min(w, n)
    best, value, width = np.arange(n), h, 1
    while width < w:
        step = min(width, w - width)  # windows that overlap are fine: the least of both stays the least
        right = value[step:]
        left = value[: len(right)]
        take = right <= left
        best = np.where(take, best[step:], best[: len(right)])
        value = np.where(take, right, left)
        width += step
    return np.unique(best)


def winnow(text: str | None, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(hashes uint64, positions int64) of a text, in order of position."""
    points = code_points(text or "")
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = kgram_hashes(points, min(k, len(points)))
    at = window_minima(h, w)
    return h[at], at


def digest(hashes: np.ndarray, positions: np.ndarray) -> str:
    """The fingerprint as a string: equal for equal lists of hashes and positions."""
    return hashlib.sha256(hashes.astype("<u8").tobytes() + positions.astype("<i8").tobytes()).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of hashes in common, 2 |A & B| / (|A| + |B|) over distinct hashes; 1 if both are empty."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    return 2.0 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b))


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, w: int = W) -> DataFrame:
    """docs without text, and hashes array<long> (bits of the unsigned hash), positions array<long>. No shuffle."""
    keep = [c for c in docs.columns if c != text]
    if clash := {"hashes", "positions"} & {*keep}:
        raise ValueError(f"columns {sorted(clash)} would clash")
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("positions", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "__text"):
            found = [winnow(t, k, w) for t in piece.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(len(keep))), pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int64()))], names=schema.names)

    return docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text}`"].alias("__text")).mapInArrow(run, schema)


def edit(text: str, following: str) -> str:
    """The last half of the text (rounded down) replaced by as many first code points of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_hashes long, edited_n_hashes long"


def compare_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, w: int = W, partitions: int | None = None) -> DataFrame:
    """For each document, by descending key: its fingerprint, that of its text edited with the next
    document's (after the last: the first), and the likeness of both and of the next to it.

    Texts are shuffled once, to ranges of the key; the first document of each range also goes to the
    range whose last one it follows. Rows stream through a task, two texts at a time. Repeated keys
    are ordered by a hash of the text; a null key comes last."""
    small_batches(docs.sparkSession)
    n = partitions or order.partitions_of(docs)
    cuts = order.bounds(docs, key, n)
    ranked = F.coalesce(F.col(key), F.lit(order.LOWEST))
    tops = docs.groupBy(order.part_of(F.col(key), cuts).alias("p")).agg(F.max(ranked).alias("top")).orderBy("p").collect()  # a row for each range
    own = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), ranked.alias("rank"), order.part_of(F.col(key), cuts).alias("part"))
    follows = {a["p"]: b["p"] for a, b in zip(tops, tops[1:], strict=False)}
    follows |= {tops[-1]["p"]: tops[0]["p"]} if tops else {}
    to = F.lit(None).cast("int")
    for row in tops:
        to = F.when((F.col("part") == row["p"]) & (F.col("rank") == row["top"]), F.lit(follows[row["p"]])).otherwise(to)
    if len(tops) > 64:  # a long chain of conditions is slow; a bounded map (a row for each range) is not
        where = F.create_map(*[F.lit(x) for r in tops for x in (r["p"], r["top"])])
        goes = F.create_map(*[F.lit(x) for a, b in follows.items() for x in (a, b)])
        to = F.when(where[F.col("part")] == F.col("rank"), goes[F.col("part")])
    both = own.withColumn("__to", F.explode(F.array_compact(F.array(F.struct(F.col("part").alias("p"), F.lit(0).alias("copy")), F.when(to.isNotNull(), F.struct(to.alias("p"), F.lit(1).alias("copy")))))))
    dealt = order.spread(both.select("id", "text", "rank", F.col("__to.p").alias("part"), F.col("__to.copy").alias("copy")), "part", n)
    sorted_rows = dealt.sortWithinPartitions("part", "copy", F.desc("rank"), F.xxhash64("text"), "text").select("id", "text", "part", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def pack() -> pa.RecordBatch:
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_hashes", "edited_n_hashes"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)
            rows.clear()
            return out

        def told(row: tuple, following: tuple) -> None:
            (doc, body, h, p), (_, after, after_h, _) = row, following
            changed = edit(body, after)
            eh, ep = winnow(changed, k, w)
            rows.append((doc, len(body), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), digest(h, p), digest(eh, ep), likeness(h, eh), likeness(h, after_h), len(h), len(eh)))

        waits, part = None, None
        for piece in slices(batches, "text"):
            for doc, body, here, copy in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                if waits is None and copy:
                    continue  # a further copy of the same key, or a range whose rows have all been told
                now = (doc, body, *winnow(body, k, w))
                if waits is not None and part == here:
                    told(waits, now)
                waits, part = (None if copy else now), here
            if rows:
                yield pack()

    return sorted_rows.mapInArrow(run, COMPARED)
