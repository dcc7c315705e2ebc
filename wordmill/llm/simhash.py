"""6. SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits if and only if some variant lies within r bits of both.
So every distinct fingerprint emits all its variants within r bits, and fingerprints that share a
variant are linked (each collision is verified by counting the bits).

The shuffle does not carry the variants (2081 of 64 bits for r = 2) one by one. A variant's leading b bits say
which task gets it, so a fingerprint is sent to each of the 1 + b + b(b-1)/2 leading parts that any of its
variants has, packed with the others that the same task sends there; the receiver makes the variants that fall
there, sorts them and finds collisions. b grows with the number of fingerprints; a part is cut
further, in memory, by more bits until a block of variants is small.

A document can have several prints (independent fingerprints, of fewer bits if wanted); documents are linked
if any print links them. The nodes of the graph are classes of equal first prints, and every print's fingerprint
travels with its node, so that collisions are links between nodes at once.

All fingerprints with one variant in common are mutually linked, so a chain through them keeps every
link's component: a part passes on a star to the least node of each component that it sees, never all pairs.
Parts that see a group of near copies whole pass on the same stars, which are made distinct; with many prints a node
is in many different stars. The components of the union come from rounds that leave a node one link, each written out.

Edge cases: null and empty texts, and texts without words, have fingerprint zero, linked like any
other; fewer than `words` words are one shingle; equal fingerprints are one class from the start, so
copies cost one row; a null id never becomes a component's name unless no other id is in it; further columns
keep their values whatever their names; texts of any length are read whole, a bounded number of shingles at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wordmill.llm import order
from wordmill.llm.common import remaining, row_key, slices, small_batches, stage, utf8

BITS = 64
SEED = 42
#: Variants that a task holds at a time; those, and fingerprints, that it should get at most.
BLOCK, PART, POINTS = 1 << 20, 1 << 30, 1 << 23
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
TO_LOWER = bytes.maketrans(UPPER, LOWER)
#: Shingles whose bits are counted at a time: bits are summed in bytes, 255 shingles to a byte.
COUNTED = 255 * 16
#: Entries that a task packs at a time.
PACKED = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def remixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """Independent hashes for the print of that number; those of print 0 are the given ones."""
    if not number:
        return hashes
    x = hashes + np.uint64(number * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(hashes: np.ndarray, number: int = 1, bits: int = BITS) -> list[int]:
    """Prints of so many bits: bits that are set in over half of the hashes. Further hashes are remixed ones."""
    many = -(-number * bits // BITS)
    count = np.zeros(many * BITS, np.int64)
    for at in range(0, len(hashes), COUNTED):
        some = hashes[at : at + COUNTED]
        every = np.stack([remixed(some, i) for i in range(many)], axis=1)
        each = np.unpackbits(every.view(np.uint8), axis=1, bitorder="little").view(np.uint64)
        count += np.add.reduceat(each, range(0, len(each), 255), axis=0).view(np.uint8).sum(axis=0, dtype=np.int64)
    set_bits = np.zeros((number, BITS), bool)
    set_bits[:, :bits] = (count * 2 > len(hashes))[: number * bits].reshape(number, bits)
    return np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).ravel().tolist()


def prints_of(text: bytes, words: int = 4, prints: int = 1, bits: int = BITS) -> list[int]:
    """SimHashes of a text (UTF-8) from its shingles' XXH64 hashes, and remixed ones as far as more bits are wanted."""
    parts = text.translate(TO_LOWER).split()  # bytes.split() cuts at just [\x20\x09-\x0D]
    if not parts:
        return [0] * prints
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(words, len(parts)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    return majority(hashes, prints, bits)


def fingerprint(text: bytes, words: int = 4) -> int:
    return prints_of(text, words)[0]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, prints: int = 1, bits: int = BITS, more: Sequence = ()) -> DataFrame:
    """doc_id long, fp long (the first fingerprint's bits), fps array<long> (all of them), columns more. One scan, no shuffle."""
    small_batches(docs.sparkSession)
    taken = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *more)
    names = taken.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            made = np.array([prints_of(t, words, prints, bits) for t in utf8(piece.column(1))], np.uint64).view(np.int64)
            all_prints = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, prints), pa.int32()), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(made[:, 0]), all_prints, *piece.columns[2:]], names=["doc_id", "fp", "fps", *names])

    return taken.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("fps", T.ArrayType(T.LongType())), *(taken.schema[c] for c in names)]))


@lru_cache(maxsize=256)
def flips(positions: range, most: int) -> np.ndarray:
    """Masks that flip at most so many of these bits."""
    return np.array([sum(1 << p for p in c) for k in range(most + 1) for c in combinations(positions, k)], np.uint64)


def colliding(made: np.ndarray, owner: np.ndarray, points: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring owners of equal variants, without repeats. made: variants; owner: places in points.

    Variant and owner are sorted as one number, where they fit into 64 bits; else the variant's hash stands in,
    and if that makes two variants of one, all is sorted again by the variants themselves."""
    low = max(1, int(len(points)).bit_length())
    mask = np.uint64((1 << low) - 1)
    wide = int(made.max()).bit_length() + low > 64
    key = ((made * ODD) & ~mask) if wide else made << np.uint64(low)
    key = np.sort(key | owner.astype(np.uint64))
    same = np.flatnonzero((key[1:] ^ key[:-1]) <= mask)
    a, b = key[same] & mask, key[same + 1] & mask
    pairs = np.unique(a << np.uint64(32) | b)
    a, b = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    near = np.bitwise_count(points[a] ^ points[b]) <= distance  # verified
    if wide and not near.all():
        by = np.argsort(made, kind="stable")
        made, owner = made[by], owner[by]
        same = np.flatnonzero(made[1:] == made[:-1])
        pairs = np.unique(np.stack([owner[same], owner[same + 1]]), axis=1)
        return pairs[0], pairs[1]
    return a[near], b[near]


def forest(points: np.ndarray, nodes: np.ndarray, lead: int, prefix: int, radius: int, bits: int = BITS) -> list[tuple[int, int]]:
    """Links (node, the least node of its component here) for the fingerprints points (of nodes) whose variants
    within radius, with these leading bits, collide. Equal points are linked where these are their own leading bits.
    Beyond the points, memory is bounded by BLOCK."""
    by = np.lexsort((nodes, points))
    points, nodes = points[by], nodes[by]
    first = np.flatnonzero(np.concatenate(([True], points[1:] != points[:-1])))
    least = np.repeat(nodes[first], np.diff(np.append(first, len(points))))
    equal = (nodes != least) & (points >> np.uint64(bits - lead) == np.uint64(prefix)) if lead else nodes != least
    out = np.unique(np.stack([nodes[equal], least[equal]]), axis=1).T.tolist()
    points, nodes = points[first], nodes[first]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def cut(ids: np.ndarray, lead: int, prefix: int) -> None:
        # variants with these leading bits: as many flips as the point's own leading bits need, the rest below
        need = np.bitwise_count((points[ids] >> np.uint64(bits - lead)) ^ np.uint64(prefix)) if lead else np.zeros(len(ids), np.uint8)
        ids, need = ids[need <= radius], need[need <= radius]
        if len(ids) < 2:
            return
        low = [flips(range(bits - lead), radius - k) for k in range(radius + 1)]
        if sum(int((need == k).sum()) * len(low[k]) for k in range(radius + 1)) > BLOCK and lead < bits - 6:
            cut(ids, lead + 1, prefix * 2)
            cut(ids, lead + 1, prefix * 2 + 1)
            return
        keep = np.uint64((1 << (bits - lead)) - 1)
        made, owner = [], []
        for k in range(radius + 1):
            own = np.flatnonzero(need == k)
            if len(own):
                made.append(((points[ids[own]] & keep)[:, None] ^ low[k][None, :]).ravel())
                owner.append(np.repeat(own, len(low[k])))
        a, b = colliding(np.concatenate(made), np.concatenate(owner), points[ids], 2 * radius)
        for a, b in zip(nodes[ids[a]].tolist(), nodes[ids[b]].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)

    cut(np.arange(len(points), dtype=np.int32), lead, prefix)
    return [*map(tuple, out), *((x, root(x)) for x in [*parent] if root(x) != x)]


def leading_bits(count: int, radius: int, bits: int = BITS) -> int:
    """Leading bits b that give a task, evenly dealt, at most PART variants and POINTS fingerprints."""
    variants = len(flips(range(bits), radius))
    lead = 3
    while lead < 24 and (count * variants >> lead > PART or count * len(flips(range(lead), radius)) >> lead > POINTS):
        lead += 1
    return lead


def links(distinct: DataFrame, distance: int = 4, prints: int = 1, bits: int = BITS) -> DataFrame:
    """Links (a, b long: nodes) that span the components of distinct rows (node long, fps array<long>), where two
    rows are linked if any of their prints is within distance bits. A node may have several rows."""
    radius = (distance + 1) // 2
    if 2 * radius != distance:
        raise ValueError("meeting in the middle takes an even distance")
    lead = leading_bits(distinct.count(), radius, bits)
    masks = flips(range(lead), radius).astype(np.uint64)
    parts = prints << lead
    tasks = min(parts, 1 << 15)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = max(1, PACKED // len(masks)), []

        def packed() -> Iterator[pa.RecordBatch]:
            nodes = np.concatenate([n for n, _ in held])
            every = np.concatenate([p for _, p in held])
            for number in range(prints):
                points = every[:, number]
                part = ((points >> np.uint64(bits - lead))[:, None] ^ masks[None, :]).ravel()
                by = np.argsort(part, kind="stable")
                edges = np.flatnonzero(np.concatenate(([True], np.diff(part[by]) != 0)))
                at = pa.py_buffer((np.append(edges, len(by)) * 8).astype(np.int32))
                taken = by // len(masks)
                columns = [pa.Array.from_buffers(pa.binary(), len(edges), [None, at, pa.py_buffer(np.ascontiguousarray(x[taken]))]) for x in (points, nodes)]
                named = part[by][edges].astype(np.int64) + (number << lead)
                yield pa.RecordBatch.from_arrays([pa.array((named % tasks).astype(np.int32)), pa.array(named), *columns], names=["task", "part", "points", "nodes"])

        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            prints_here = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, prints)
            for k in range(0, len(nodes), rows):
                held.append((nodes[k : k + rows], prints_here[k : k + rows]))
                if sum(len(n) for n, _ in held) >= rows:
                    yield from packed()
                    held = []
        if held:
            yield from packed()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def ended() -> Iterator[pa.RecordBatch]:
            points, nodes = (np.frombuffer(b"".join(x[i] for x in held), kind) for i, kind in enumerate((np.uint64, np.int64)))
            found = forest(points, nodes, lead, part & ((1 << lead) - 1), radius, bits)
            if found:
                both = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for batch in batches:
            for here, points, nodes in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if held and here != part:
                    yield from ended()
                    held = []
                part = here
                held.append((points, nodes))
        if held:
            yield from ended()

    sent = distinct.select("node", "fps").mapInArrow(deal, "task int, part long, points binary, nodes binary")
    return order.spread(sent, "task", tasks).sortWithinPartitions("part").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node long, root long (not the node itself): components of edges (a, b), by the least id.

    A node's parent is the least of its lower neighbours. In a round a node keeps one link, to its parent's parent;
    its links to other lower neighbours become links from these to the parent, which say the same of the component.
    So the many stars of a group soon are one, of a link for each node, and a path halves; the rounds end with stars.
    Edges are read once; aggregates combine before their shuffle."""
    new = edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("lower"), F.lit(True).alias("moved"))
    while True:
        held = stage(new.groupBy("node", "lower").agg(F.max("moved").alias("moved")), "edges")
        if not held.where("moved").limit(1).count():
            return held.select("node", F.col("lower").alias("root"))
        parent = stage(held.groupBy("node").agg(F.min("lower").alias("least"), F.count("*").alias("n")), "parents")
        above = parent.select(F.col("node").alias("up"), F.col("least").alias("top"))
        kept = parent.join(above, F.col("least") == F.col("up"), "left").select("node", F.coalesce("top", "least").alias("lower"), F.col("top").isNotNull().alias("moved"))
        several = parent.where("n > 1").select(F.col("node").alias("of"), "least")
        passed = held.join(several, F.col("node") == F.col("of")).where("lower <> least").select(F.col("lower").alias("node"), F.col("least").alias("lower"), F.lit(True).alias("moved"))
        new = kept.unionByName(passed)


def grouped(rows: DataFrame, first, distance: int, prints: int, bits: int) -> DataFrame:
    """fp, first (the aggregate of that name over the component's rows), many (whether the component has several
    fingerprints or the fingerprint several rows), for every distinct fingerprint of rows (fp, fps), written out."""
    classes = stage(rows.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n")), "simhash-classes")
    distinct = classes.select(F.col("fp").alias("node"), F.array("fp").alias("fps")) if prints == 1 else stage(rows.select(F.col("fp").alias("node"), "fps").distinct(), "simhash-distinct")
    roots = components(links(distinct, distance, prints, bits))
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    own = stage(classes.join(linked, classes["fp"] == linked["node"], "left").drop("node"), "simhash-linked")
    # a component's row counts as one for each of its fingerprints, and is written before it is joined back
    names = stage(own.where("root is not null").groupBy("root").agg(F.min("first").alias("named")).withColumnRenamed("root", "of"), "simhash-names")
    inside = own.where("root is not null").join(names, F.col("root") == F.col("of")).select("fp", F.col("named").alias("first"), F.lit(True).alias("many"))
    return stage(inside.unionByName(own.where("root is null").select("fp", "first", (F.col("n") > 1).alias("many"))), "simhash-groups")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4, prints: int = 1, bits: int = BITS) -> DataFrame:
    """doc_id, fp long, component_id (least doc_id reachable by links, itself included), for every row.

    Documents are linked if any of their prints (of so many bits) is within distance bits."""
    rows = stage(fingerprints(docs, key, text, words, prints, bits), "simhash")
    named = grouped(rows, F.min("doc_id"), distance, prints, bits).select(F.col("fp").alias("f"), F.col("first").alias("component_id"))
    return rows.join(named, rows["fp"] == named["f"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, distance: int = 4, prints: int = 1, bits: int = BITS) -> DataFrame:
    """One row of each component stays: that of the least id (null ids last), of equal ids that of the least digest.

    Survivors are known by id and text, so neither null nor repeated ids merge components; of rows
    that are equal in both, one stays."""
    id_of, digest_of = row_key(docs, key, text)
    rows = stage(fingerprints(docs, key, text, words, prints, bits, [digest_of.alias("digest")]), "simhash")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    groups = grouped(rows, F.min(rank), distance, prints, bits).where("many").select(F.col("fp").alias("f"), F.col("first.doc_id").alias("id"), F.col("first.digest").alias("d"))
    same = rows.groupBy("fp", "doc_id", "digest").agg(F.count("*").alias("n"))
    told = stage(same.join(groups, F.col("fp") == F.col("f")).select("doc_id", "digest", "n", (F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d"))).alias("stays")), "simhash-told")
    return remaining(docs, id_of, digest_of, told.where("not stays"), told.where("stays and n > 1"))
