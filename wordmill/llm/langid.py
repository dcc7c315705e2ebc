"""2. Language identification by string kernels.

Kernel: blended-spectrum presence, k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), where G is the set
of n-grams (n = 1 to 3) of the lower-cased text, all that is no letter taken as one border sign.
Nyström: phi(x) = k(x, landmarks) W with W the inverse root of the landmarks' kernel matrix;
one-versus-rest kernel ridge regression on phi with targets +1 and -1. A batch is scored by two
matrix products: presences x landmarks' presences, then (normalised) x coefficients.

What is learned from is bounded: at most per_lang different texts of each language, and fewer if that would be more than
most in all (parameters), chosen by a hash of text and language; every language is learned. Executors turn those texts into
sets of n-grams; only these reach the driver, never texts. All rows are scored, on their whole texts.

The gate (predict(gate=True)) tells texts that are like nothing learned from, which the regression cannot: its
best value is near 0.5 there. Counted are a text's distinct 3-grams that some landmark has. A text is out if
their share is below least_known, three quarters of the 1 % quantile of that share over the rows learned from
(a landmark is held against all others), by more than 1 / sqrt(number of its 3-grams), the allowance for short texts.

Edge cases: a null text, and one without letters (of Unicode's categories L), is `und` with score 0. Rows with a null text or
language are never learned from. An empty learning table gives `und` for every row. Equal scores:
the language that is first by code point wins. Repeated rows count once in what is learned, and are scored one by one.
Further columns are carried through (one named lang_pred or score: ValueError).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from wordmill.llm.common import slices, small_batches

SIGNS = 64
#: Places of 1-, 2- and 3-grams in the table of n-grams.
SPACE = SIGNS + SIGNS**2 + SIGNS**3
#: Where the places of 3-grams begin.
THREE = SIGNS + SIGNS**2
HAS_LETTER = regex.compile(r"\p{L}")


def sign_table() -> np.ndarray:
    """Code point (below U+0250) to sign: 0 border, 1-26 a-z, letters beyond by code point."""
    out = np.zeros(0x250, np.int32)
    for c in range(0x250):
        low = chr(c).lower()[0]
        if low.isalpha():
            out[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % (SIGNS - 27)
    return out


SIGN = sign_table()


def ngrams(text: str) -> tuple[np.ndarray, int]:
    """Presence of each n-gram of a text, and how many are present. Whole text, any length."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if points.size and points.max() >= len(SIGN):
        signs = SIGN[np.minimum(points, len(SIGN) - 1)]
        for i in np.flatnonzero(points >= len(SIGN)):
            low = chr(points[i]).lower()[0]
            signs[i] = 27 + ord(low) % (SIGNS - 27) if low.isalpha() else 0
    else:
        signs = SIGN[points]
    signs = np.concatenate(([0], signs, [0]))
    border = signs == 0
    signs = signs[~(border & np.concatenate(([False], border[:-1])))]  # runs of borders are one
    present = np.zeros(SPACE, bool)
    present[signs] = True
    two = signs[:-1] * SIGNS + signs[1:]
    present[SIGNS + two] = True
    present[SIGNS + SIGNS**2 + two[:-1] * SIGNS + signs[2:]] = True
    return present, int(np.count_nonzero(present))


@dataclass
class Model:
    """langs; used: n-grams that any landmark has; marks: landmarks' presences over these; size:
    of each landmark's set; weights: landmarks x langs; least_known: the gate's share of known 3-grams."""

    langs: list[str]
    used: np.ndarray
    marks: np.ndarray
    size: np.ndarray
    weights: np.ndarray
    least_known: float = 0.0

    def score(self, rows: list[tuple[np.ndarray, int]]) -> np.ndarray:
        """Regression values of a batch (rows x langs), targets being -1 and 1. rows: which of the used
        n-grams a text has, and the size of its set."""
        have = np.stack([p for p, _ in rows]).astype(np.float32)
        many = np.array([max(n, 1) for _, n in rows], np.float32)
        kernel = (have @ self.marks.T) / np.sqrt(many[:, None] * self.size[None, :])
        return kernel @ self.weights

    def strange(self, present: np.ndarray) -> bool:
        """The gate: too few of the 3-grams present are any landmark's."""
        three = int(np.count_nonzero(present[THREE:]))
        known = int(np.count_nonzero(present[self.used[self.used >= THREE]]))
        return three > 0 and known / three < self.least_known - 1 / np.sqrt(three)


def known_share(sets: list[np.ndarray], chosen: list[int]) -> float:
    """1 % quantile, over all sets, of the share of 3-grams that a landmark (for a landmark: another one) has."""
    owners = np.zeros(SPACE, np.int64)
    for i in chosen:
        owners[sets[i]] += 1
    own = {*chosen}
    shares = [float((owners[three] > (i in own)).mean()) for i, three in ((i, s[s >= THREE]) for i, s in enumerate(sets)) if len(three)]
    return float(np.quantile(shares, 0.01)) if shares else 0.0


def train(sets: list[np.ndarray], labels: list[str], landmarks: int, ridge: float) -> Model | None:
    """Nyström kernel ridge regression; the first rows of each language in turn are landmarks."""
    langs = sorted({*labels})
    if not langs:
        return None
    turn: dict[str, int] = {}
    order = []
    for i, lang in enumerate(labels):
        order.append((turn.get(lang, 0), i))
        turn[lang] = turn.get(lang, 0) + 1
    chosen = [i for _, i in sorted(order)[:landmarks]]
    used = np.unique(np.concatenate([sets[i] for i in chosen]))
    place = np.full(SPACE, -1, np.int64)
    place[used] = np.arange(len(used))

    def dense(ids: list[int]) -> np.ndarray:
        out = np.zeros((len(ids), len(used)), np.float32)
        for row, i in enumerate(ids):
            at = place[sets[i]]
            out[row, at[at >= 0]] = 1
        return out

    marks = dense(chosen)
    size = np.array([len(sets[i]) for i in chosen], np.float32)
    own = (marks @ marks.T / np.sqrt(size[:, None] * size[None, :])).astype(np.float64)
    values, vectors = np.linalg.eigh(own)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    # sums over blocks of rows of phi' phi and phi' y
    left, right = np.zeros((root.shape[1],) * 2), np.zeros((root.shape[1], len(langs)))
    count = {x: labels.count(x) for x in langs}
    for start in range(0, len(sets), 512):
        ids = list(range(start, min(start + 512, len(sets))))
        many = np.array([len(sets[i]) for i in ids], np.float32)
        kernel = dense(ids) @ marks.T / np.sqrt(np.maximum(many, 1)[:, None] * size[None, :])
        phi = kernel @ root
        target = np.array([[1.0 if labels[i] == x else -1.0 for x in langs] for i in ids])
        weight = np.array([1 / count[labels[i]] for i in ids])
        left += phi.T @ (phi * weight[:, None])
        right += phi.T @ (target * weight[:, None])
    beta = np.linalg.solve(left + ridge * np.eye(len(left)), right)
    return Model(langs, used, marks, size, (root @ beta).astype(np.float32), 0.75 * known_share(sets, chosen))


def sample(labelled: DataFrame, text: str, lang: str, per_lang: int, most: int) -> DataFrame:
    """At most per_lang rows (lang, grams array<int>, key) of each language, of different texts, by a hash of text and language.

    A first pass estimates each language's number of different texts; then a threshold on the hash leaves few, copies
    of a text are merged where they are found, and only the rest is ranked, so no language's rows meet in one task."""
    rows = labelled.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("__text")).where("lang is not null and __text is not null")
    rows = rows.withColumn("__k", F.xxhash64("__text", "lang"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("__k", 0.02).alias("n")).collect()}  # a row for each language
    if not sizes:
        return rows.select("lang", F.array().cast("array<int>").alias("grams"), F.lit(0).cast("long").alias("key")).limit(0)
    per_lang = max(1, min(per_lang, most // len(sizes)))
    rates = labelled.sparkSession.createDataFrame([(name, (min(1.0, 1.5 * (per_lang + 20) / max(1, n)) - 0.5) * 2.0**64) for name, n in sizes.items()], "l string, bound double")
    few = rows.join(F.broadcast(rates), (F.col("lang") == F.col("l")) & (F.col("__k").cast("double") <= F.col("bound")))
    few = few.groupBy("lang", "__k").agg(F.first("__text").alias("__text")).select("lang", "__text", "__k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "__text"):
            sets = [np.flatnonzero(ngrams(t)[0]).astype(np.int32) if HAS_LETTER.search(t) else None for t in piece.column(1).to_pylist()]
            keep = [i for i, s in enumerate(sets) if s is not None]
            take = pa.array(keep, pa.int32())
            yield pa.RecordBatch.from_arrays([piece.column(0).take(take), pa.array([sets[i] for i in keep], pa.list_(pa.int32())), piece.column(2).take(take)], names=["lang", "grams", "key"])

    made = few.mapInArrow(run, T.StructType([T.StructField("lang", T.StringType()), T.StructField("grams", T.ArrayType(T.IntegerType())), T.StructField("key", T.LongType())]))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key", F.hash("grams")))
    return made.withColumn("__r", rank).where(F.col("__r") <= per_lang).drop("__r")


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_lang: int = 400, most: int = 25_600, landmarks: int = 192, ridge: float = 1e-3) -> Model | None:
    """Learn from at most per_lang texts of each language, and most in all (or one of each); their n-gram sets come to the driver."""
    small_batches(labelled.sparkSession)
    rows = sorted(sample(labelled, text, lang, per_lang, most).collect(), key=lambda r: (r["key"], r["lang"]))
    return train([np.array(r["grams"], np.int64) for r in rows], [r["lang"] for r in rows], landmarks, ridge)


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, batch_rows: int = 128, gate: bool = False) -> DataFrame:
    """Columns keep (default: all) and lang_pred string, score double in 0 to 1. One scan, no shuffle.

    gate: texts that are like nothing learned from are `und` with score 0, too."""
    keep = docs.columns if keep is None else keep
    if clash := {"lang_pred", "score"} & {*keep}:
        raise ValueError(f"columns {sorted(clash)} would clash")
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: landmarks x n-grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for piece in slices(batches, "__text"):
            texts = piece.column(len(keep)).to_pylist()
            said, scores = ["und"] * len(texts), [0.0] * len(texts)
            some = [i for i, t in enumerate(texts) if t is not None and HAS_LETTER.search(t)] if known else []
            for at in range(0, len(some), batch_rows):
                ids = some[at : at + batch_rows]
                rows, strange = [], []
                for i in ids:
                    present, n = ngrams(texts[i])
                    rows.append((present[known.used], n))
                    strange.append(gate and known.strange(present))
                values = known.score(rows)
                best = values.argmax(axis=1)
                for row, i in enumerate(ids):
                    if strange[row]:
                        continue
                    said[i] = known.langs[best[row]]
                    scores[i] = float(min(1.0, max(0.0, (values[row, best[row]] + 1) / 2)))
            yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(len(keep))), pa.array(said, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text}`"].alias("__text")).mapInArrow(run, schema)


def held_out(doc_id):
    """Column: the row is never learned from (crc32 of the id as text, mod 4, is 2); null ids are held out too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))
