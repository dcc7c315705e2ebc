"""Positional features: neighbours, frames, runs, tags."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordmill.operators.vocab import number_rows

EDGE = "*"
#: Characters whose frames are counted at a time.
FRAMES = 1 << 22


def neighbours(tokens: DataFrame, key: str, reach: int = 2, edge: str | None = EDGE) -> DataFrame:
    """Adds b2, b1, a1, a2 (words before and after; edge where there are none)."""
    w = Window.partitionBy(key).orderBy("pos")
    pad = (lambda c: F.coalesce(c, F.lit(edge))) if edge is not None else (lambda c: c)
    named = {f"b{n}": pad(F.lag("word", n).over(w)) for n in range(reach, 0, -1)} | {f"a{n}": pad(F.lead("word", n).over(w)) for n in range(1, reach + 1)}
    return tokens.withColumns(named)


def neighbours_of(docs: DataFrame, words: Column, *keep: str, reach: int = 2, edge: str | None = EDGE) -> DataFrame:
    """keep, pos, word and its neighbours, of rows that hold all their words: made inside the row, nothing is shuffled."""
    pad = (lambda c: F.coalesce(c, F.lit(edge))) if edge is not None else (lambda c: c)
    names = {f"b{n}": -n for n in range(reach, 0, -1)} | {f"a{n}": n for n in range(1, reach + 1)}
    near = F.transform("words", lambda w, i: F.struct((i + 1).alias("pos"), w.alias("word"), *[pad(F.get("words", i + k)).alias(n) for n, k in names.items()]))
    return docs.select(*keep, words.alias("words")).select(*keep, F.explode(near).alias("e")).select(*keep, "e.*")


def adjacent_pairs(docs: DataFrame, words: Column, *keep: str) -> DataFrame:
    """keep, w1, w2: each word and its successor, made inside the row."""
    listed = docs.select(*keep, words.alias("words")).where(F.size("words") > 1)
    both = F.arrays_zip(F.slice("words", 1, F.size("words") - 1).alias("w1"), F.slice("words", 2, F.size("words")).alias("w2"))
    return listed.select(*keep, F.explode(both).alias("p")).select(*keep, "p.w1", "p.w2")


def attributes(tokens: DataFrame, key: str, edge: str | None = EDGE) -> DataFrame:
    """feats: the seven attributes of a position for a sequence tagger (interior ones only if edge is None)."""
    near = neighbours(tokens, key, 2, edge)
    if edge is None:
        near = near.where("b2 is not null and a2 is not null")
    named = [("w[-2]", "b2"), ("w[-1]", "b1"), ("w[-1]|w[0]", None), ("w[0]", "word"), ("w[1]", "a1"), ("w[0]|w[1]", None), ("w[2]", "a2")]
    both = {"w[-1]|w[0]": F.concat_ws("|", "b1", "word"), "w[0]|w[1]": F.concat_ws("|", "word", "a1")}
    feats = F.array(*[F.concat(F.lit(f"{name}="), F.col(c) if c else both[name]) for name, c in named])
    return near.select(*tokens.columns, feats.alias("feats"))


def characters(docs: DataFrame, text: Column, *keep: str) -> DataFrame:
    """keep, pos (from 1), word: each character of the text."""
    return docs.select(*keep, F.posexplode(F.regexp_extract_all(text, F.lit(r"([\s\S])"), F.lit(1))).alias("pos", "word")).withColumn("pos", F.col("pos") + 1)


def frames(docs: DataFrame, text: Column, before: int, after: int, pad: str, *keep: str) -> DataFrame:
    """keep, pos, frame: the characters around each position, padded; made inside the row (no shuffle)."""
    padded = F.concat(F.lit(pad * before), text, F.lit(pad * after))
    # a look-ahead matches at every character, so overlapping frames come from one pass over the text
    every = F.regexp_extract_all(padded, F.lit(rf"(?=([\s\S]{{{before + after + 1}}}))"), F.lit(1))
    made = docs.where(F.char_length(text) > 0).select(*keep, F.posexplode(every).alias("pos", "frame"))
    return made.withColumn("pos", F.col("pos") + 1)


def _codes(batches: Iterator[pa.RecordBatch], before: int, after: int, pad: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of texts of about FRAMES characters at a time: the code points with their paddings, and where frames start."""
    texts, held = [], 0
    every = itertools.chain.from_iterable(b.column(0).to_pylist() for b in batches)
    for text in itertools.chain(every, [None]):
        if text:
            texts.append(text)
            held += len(text)
        if texts and (held >= FRAMES or text is None):
            size = np.array([len(t) for t in texts])
            code = np.frombuffer("".join(pad * before + t + pad * after for t in texts).encode("utf-32-le"), np.uint32)
            yield code, np.arange(size.sum()) + np.repeat(np.arange(len(size)) * (before + after), size)
            texts, held = [], 0


def count_frames(docs: DataFrame, text: Column, before: int, after: int, pad: str) -> DataFrame:
    """(frame, n): how often each of the frames() occurs. Frames of a piece of text are numbers until they are counted, so what Spark adds up
    are the different ones of each piece."""
    width = before + after + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, at in _codes(batches, before, after, pad):
            used = np.zeros(0x110000, np.int64)
            used[code] = 1
            size = int(used.sum())
            ids = (np.cumsum(used) - 1)[code]
            key, values = ids[at], size
            for k in range(1, width):
                if values * size >= 1 << 62:
                    known, key = np.unique(key, return_inverse=True)
                    values = len(known)
                key, values = key * size + ids[at + k], values * size
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            for i in range(0, len(first), 1 << 18):
                points = code[at[first[i : i + (1 << 18)]][:, None] + np.arange(width)]
                long = (1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)).sum(axis=1)
                ends = np.concatenate(([0], np.cumsum(long))).astype(np.int32)
                frames = pa.StringArray.from_buffers(len(long), pa.py_buffer(ends), pa.py_buffer(points.tobytes().decode("utf-32-le").encode()))
                yield pa.RecordBatch.from_arrays([frames, pa.array(n[i : i + (1 << 18)].astype(np.int64))], ["frame", "n"])

    return docs.select(text.alias("text")).mapInArrow(run, "frame string, n long").groupBy("frame").agg(F.sum("n").alias("n"))


def count_adjacent(docs: DataFrame, words: Column, by: str) -> DataFrame:
    """(by, w1, w2, n): counts of adjacent_pairs(); those of some rows are counted by whole arrays before Spark adds them up."""
    kind = docs.select(by).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            lists, group = batch.column("words"), batch.column(by).dictionary_encode("encode")
            row = np.repeat(np.arange(len(batch)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            if len(row) < 2:
                continue
            coded = lists.flatten().dictionary_encode()
            code, many = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            first = np.flatnonzero(row[1:] == row[:-1])
            own = group.indices.to_numpy().astype(np.int64)[row[first]]
            seen, n = np.unique((own * many + code[first]) * many + code[first + 1], return_counts=True)
            parts = [group.dictionary.take(pa.array(seen // many // many)), coded.dictionary.take(pa.array(seen // many % many)), coded.dictionary.take(pa.array(seen % many))]
            yield pa.RecordBatch.from_arrays([*parts, pa.array(n.astype(np.int64))], [by, "w1", "w2", "n"])

    told = docs.select(by, words.alias("words")).mapInArrow(run, f"`{by}` {kind}, w1 string, w2 string, n long")
    return told.groupBy(by, "w1", "w2").agg(F.sum("n").alias("n"))


def histories(docs: DataFrame, text: Column, size: int, pad: str, *keep: str) -> DataFrame:
    """keep, pos, history (the size characters before), next (the character): for next-character models."""
    framed = frames(docs, text, size, 0, pad, *keep)
    return framed.select(*keep, "pos", F.substring("frame", 1, size).alias("history"), F.substring("frame", size + 1, 1).alias("next"))


def bems(word: Column) -> Column:
    """Tags of a word's characters: S, or B, M..., E."""
    n = F.char_length(word)
    return F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(F.lit("S"))).otherwise(F.concat(F.array(F.lit("B")), F.array_repeat(F.lit("M"), n - 2), F.array(F.lit("E"))))


def tag_sequence(words: Column) -> Column:
    return F.flatten(F.transform(words, bems))


def transitions(docs: DataFrame, words: Column) -> DataFrame:
    """(tag, next_tag, n, share): transitions of BEMS tags within each row, share of the tag's.

    Counted from the words' lengths (inside a word and at its border to the next), so no row is made for a character."""
    sizes = docs.select(F.filter(F.transform(words, lambda w: F.char_length(w)), lambda n: n > 0).alias("s"))
    each = sizes.select(F.explode(F.transform("s", lambda n, i: F.struct(n.alias("n"), F.get("s", i + 1).alias("m")))).alias("e")).select("e.*")
    n, m = F.col("n"), F.col("m")
    told = {("B", "E"): n == 2, ("B", "M"): n > 2, ("M", "E"): n > 2, ("M", "M"): F.greatest(n - 3, F.lit(0)), ("E", "B"): (n > 1) & (m > 1), ("E", "S"): (n > 1) & (m == 1), ("S", "B"): (n == 1) & (m > 1), ("S", "S"): (n == 1) & (m == 1)}
    sums = each.agg(*[F.coalesce(F.sum(v.cast("long")), F.lit(0)).alias(a + b) for (a, b), v in told.items()])
    counts = sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("tag"), F.lit(b).alias("next_tag"), F.col(a + b).alias("n")) for a, b in told])).alias("e")).select("e.*").where("n > 0")
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("tag")), 9))


def emissions(docs: DataFrame, words: Column, smooth: int = 1) -> DataFrame:
    """(tag, ch, n): how often a tag stands over a character, plus smoothing. Words are counted first, so each different word is taken apart once a task."""
    seen = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    each = seen.select("n", F.explode(F.arrays_zip(bems(F.col("word")).alias("tag"), F.regexp_extract_all("word", F.lit(r"([\s\S])"), F.lit(1)).alias("ch"))).alias("p"))
    return each.groupBy(F.col("p.tag").alias("tag"), F.col("p.ch").alias("ch")).agg((F.sum("n") + smooth).alias("n"))


def runs(tokens: DataFrame, key: str, same: str) -> DataFrame:
    """(key, run, same, first_pos, last_pos, words): maximal runs of consecutive positions with one value."""
    w = Window.partitionBy(key).orderBy("pos")
    start = F.when(F.col(same).eqNullSafe(F.lag(same).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = tokens.withColumn("__s", start).withColumn("run", F.sum("__s").over(w))
    grouped = numbered.groupBy(key, "run", same).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    return grouped.withColumn("words", F.transform("w", lambda x: x["word"])).drop("w")


def joined_frames(docs: DataFrame, text: str, *order: str, reach: int = 2, least: int = 5) -> DataFrame:
    """(order, pos, frame): each character's frame over the whole corpus, whose texts (of at least so many characters) follow one another
    in this order; the first and last characters of all have none. A text is joined with its neighbours' ends, never with all."""
    rows = number_rows(docs.where(F.char_length(text) >= max(least, reach)).select(*order, F.col(text).alias("__text")), *order, name="__i")
    before = rows.select((F.col("__i") + 1).alias("__i"), F.substring("__text", -reach, reach).alias("__before"))
    after = rows.select((F.col("__i") - 1).alias("__i"), F.substring("__text", 1, reach).alias("__after"))
    near = rows.join(before, "__i", "left").join(after, "__i", "left")
    padded = F.concat(F.coalesce("__before", F.lit("")), "__text", F.coalesce("__after", F.lit("")))
    every = F.regexp_extract_all(padded, F.lit(rf"(?=([\s\S]{{{2 * reach + 1}}}))"), F.lit(1))
    first = F.when(F.col("__before").isNull(), reach + 1).otherwise(1)
    return near.select(*order, first.alias("__first"), F.posexplode(every).alias("__p", "frame")).select(*order, (F.col("__p") + F.col("__first")).alias("pos"), "frame")


def constrained_decode(probabilities: Column) -> Column:
    """BEMS tags from rows of four probabilities (B, E, M, S): greedy, only legal successors.

    The first tag is B or S; after B or M comes M or E; after E or S comes B or S."""
    tags = F.array(*[F.lit(t) for t in "BEMS"])

    def step(acc, p):
        inner = (F.element_at(acc, -1) == "B") | (F.element_at(acc, -1) == "M")
        legal = F.when((F.size(acc) > 0) & F.coalesce(inner, F.lit(False)), F.array(*[F.lit(x) for x in (0.0, 1.0, 1.0, 0.0)])).otherwise(F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 1.0)]))
        masked = F.zip_with(p, legal, lambda a, b: F.when(b == 0, -1.0).otherwise(a))
        return F.concat(acc, F.array(F.element_at(tags, F.array_position(masked, F.array_max(masked)).cast("int"))))

    return F.aggregate(probabilities, F.array().cast("array<string>"), step)
