"""Dictionary and HMM segmenters. Lattices and Viterbi need state along a text, so these run as
vectorised Python over Arrow batches, with the lexicon as a broadcast variable (a model, not data)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the log probability of what was never seen.
MIN_LOG = -3.14e100
#: Symbols that are tokens of their own and end a sentence.
SPECIAL = " \t\n。，"
STATES = "BEMS"
#: Words that a worker holds as objects at a time: of parts it knows, of rows it has cut.
KNOWN, PACK = 1 << 20, 1 << 16
_CUT = re.compile(f"[{SPECIAL}]|[^{SPECIAL}]+")
_ASCII = re.compile(r"[A-Za-z][A-Za-z0-9]*|[0-9][0-9.]*")


@dataclass
class Lexicon:
    """Words with log weights and tags; user words weigh as much as the heaviest word."""

    weight: dict[str, float]
    tag: dict[str, str] = field(default_factory=dict)
    user: set[str] = field(default_factory=set)

    def __post_init__(self):
        self.least = min(self.weight.values(), default=0.0)
        self.longest = max(map(len, self.weight), default=1)

    @classmethod
    def of(cls, rows, user=()) -> Lexicon:
        """rows: (word, freq, tag); user: words or (word, tag). Weight is ln(freq / sum of freq)."""
        rows = list(rows)
        total = sum(f for _, f, _ in rows) or 1
        weight = {w: math.log(f / total) for w, f, _ in rows if f > 0}
        top = max(weight.values(), default=0.0)
        own = [(u, "") if isinstance(u, str) else u for u in user]
        return cls(weight | {w: top for w, _ in own}, {w: t for w, _, t in rows} | dict(own), {w for w, _ in own})

    def insert(self, word: str, tag: str = "") -> Lexicon:
        """A lexicon with one more user word."""
        top = max(self.weight.values(), default=0.0)
        return Lexicon(self.weight | {word: top}, self.tag | {word: tag}, self.user | {word})


@dataclass
class Hmm:
    """Log probabilities: start and trans by state, emit by state and character."""

    start: dict[str, float]
    trans: dict[str, dict[str, float]]
    emit: dict[str, dict[str, float]]


def train_hmm(sentences) -> Hmm:
    """Relative counts of states, transitions and emissions of segmented sentences (lists of words)."""
    start, trans, emit = ({s: 0.0 for s in STATES}, {s: dict.fromkeys(STATES, 0.0) for s in STATES}, {s: {} for s in STATES})
    for words in sentences:
        tags = "".join("S" if len(w) == 1 else "B" + "M" * (len(w) - 2) + "E" for w in words)
        if not tags:
            continue
        start[tags[0]] += 1
        for a, b in zip(tags, tags[1:], strict=False):
            trans[a][b] += 1
        for t, ch in zip(tags, "".join(words), strict=True):
            emit[t][ch] = emit[t].get(ch, 0) + 1
    return _as_logs(start, trans, emit)


def train_hmm_table(docs: DataFrame, words: Column) -> Hmm:
    """train_hmm() of a column of words (array<string>), counted by executors; what comes to the driver has the model's size."""
    from wordmill.operators import windows

    listed = docs.select(F.filter(words, lambda w: w != "").alias("words")).where(F.size("words") > 0)
    first = {r["t"]: r["n"] for r in listed.groupBy(F.when(F.char_length(F.col("words")[0]) == 1, "S").otherwise("B").alias("t")).agg(F.count("*").alias("n")).collect()}
    trans, emit = ({s: dict.fromkeys(STATES, 0) for s in STATES}, {s: {} for s in STATES})
    for r in windows.transitions(listed, F.col("words")).collect():
        trans[r["tag"]][r["next_tag"]] = r["n"]
    for r in windows.emissions(listed, F.col("words"), smooth=0).collect():
        emit[r["tag"]][r["ch"]] = r["n"]
    return _as_logs({s: first.get(s, 0) for s in STATES}, trans, emit)


def _as_logs(start: dict, trans: dict, emit: dict) -> Hmm:
    log = lambda n, total: math.log(n / total) if n else MIN_LOG
    return Hmm({s: log(start[s], sum(start.values()) or 1) for s in STATES}, {a: {b: log(n, sum(row.values()) or 1) for b, n in row.items()} for a, row in trans.items()}, {s: {c: log(n, sum(row.values())) for c, n in row.items()} for s, row in emit.items()})


def parse_hmm(text: str) -> Hmm:
    """The text model format: '#' comments, a line of 4 start values, 4 of transitions, 4 lines of c:logp
    (states B, E, M, S)."""
    lines = [x.strip() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    number = lambda x: [float(v) for v in x.split()]
    emit = [dict((p[0], float(p[2:])) for p in line.split(",") if len(p) > 2) for line in lines[5:9]]
    return Hmm(dict(zip(STATES, number(lines[0]), strict=True)), {s: dict(zip(STATES, number(x), strict=True)) for s, x in zip(STATES, lines[1:5], strict=True)}, dict(zip(STATES, emit, strict=True)))


def edges(text: str, lexicon: Lexicon, cap: int) -> list[list[tuple[int, float | None]]]:
    """For each start: (end, weight) of the words that begin there; a single character always (maybe without weight)."""
    out = []
    for i in range(len(text)):
        here = [(i + 1, lexicon.weight.get(text[i]))]
        here += [(j, lexicon.weight[text[i:j]]) for j in range(i + 2, min(len(text), i + min(cap, lexicon.longest)) + 1) if text[i:j] in lexicon.weight]
        out.append(here)
    return out


def mp(text: str, lexicon: Lexicon, cap: int = 512) -> list[str]:
    """The path of the greatest weight; of equal ones the shortest first word."""
    n = len(text)
    value, to = [0.0] * (n + 1), [0] * n
    for i in range(n - 1, -1, -1):
        best = None
        for j, w in edges_at(text, i, lexicon, cap):
            v = value[j] + (lexicon.least if w is None else w)
            if best is None or v > best:
                best, to[i] = v, j
        value[i] = best
    out, i = [], 0
    while i < n:
        out.append(text[i : to[i]])
        i = to[i]
    return out


def edges_at(text: str, i: int, lexicon: Lexicon, cap: int) -> Iterator[tuple[int, float | None]]:
    yield i + 1, lexicon.weight.get(text[i])
    for j in range(i + 2, min(len(text), i + min(cap, lexicon.longest)) + 1):
        w = lexicon.weight.get(text[i:j])
        if w is not None:
            yield j, w


def viterbi(text: str, hmm: Hmm) -> str:
    """The likeliest BEMS tags that end in E or S."""
    if not text:
        return ""
    emit = lambda s, c: hmm.emit[s].get(c, MIN_LOG)
    score = {s: hmm.start[s] + emit(s, text[0]) for s in STATES}
    back: list[dict[str, str]] = []
    steps = {s: [(p, hmm.trans[p][s]) for p in "EBMS"] for s in STATES}  # of equal ones the first in this order
    for ch in text[1:]:
        came, new = {}, {}
        for s in STATES:
            best, value = "", -math.inf
            for p, t in steps[s]:
                if not best or score[p] + t > value:
                    best, value = p, score[p] + t
            came[s], new[s] = best, value + emit(s, ch)
        back.append(came)
        score = new
    state = "E" if score["E"] >= score["S"] else "S"
    tags = [state]
    for came in reversed(back):
        state = came[state]
        tags.append(state)
    return "".join(reversed(tags))


def by_tags(text: str, tags: str) -> list[str]:
    out, start = [], 0
    for i, t in enumerate(tags):
        if t in "ES":
            out.append(text[start : i + 1])
            start = i + 1
    return out + ([text[start:]] if start < len(text) else [])


def hmm_cut(text: str, hmm: Hmm) -> list[str]:
    """HMM words; ASCII identifiers and numbers are kept whole, other ASCII is cut to characters."""
    out, i, run = [], 0, 0

    def flush(stop: int) -> None:
        if run < stop:
            out.extend(by_tags(text[run:stop], viterbi(text[run:stop], hmm)))

    while i < len(text):
        if ord(text[i]) < 128:
            flush(i)
            m = _ASCII.match(text, i)
            out.append(m[0] if m else text[i])
            i = run = i + len(out[-1])
        else:
            i += 1
    flush(len(text))
    return out


def mix(text: str, lexicon: Lexicon, hmm: Hmm, cap: int = 512) -> list[str]:
    """MP, then runs of single characters that are no user words are cut again by the HMM."""
    out, run = [], ""
    for w in mp(text, lexicon, cap):
        if len(w) == 1 and w not in lexicon.user:
            run += w
            continue
        out += hmm_cut(run, hmm) if run else []
        run = ""
        out.append(w)
    return out + (hmm_cut(run, hmm) if run else [])


def full(text: str, lexicon: Lexicon) -> list[str]:
    """Every dictionary word of two or more characters; a single one only where no word reaches it."""
    out, covered = [], 0
    for i in range(len(text)):
        longer = [j for j, _ in edges_at(text, i, lexicon, 512) if j > i + 1]
        if longer:
            out += [text[i:j] for j in longer]
        elif covered <= i:
            out.append(text[i])
        covered = max([covered, *longer])
    return out


def query(text: str, lexicon: Lexicon, hmm: Hmm, longest: int = 4) -> list[str]:
    return [x for w in mix(text, lexicon, hmm) for x in (full(w, lexicon) if len(w) > longest else [w])]


def level(text: str, lexicon: Lexicon) -> list[tuple[str, int]]:
    """(word, level): MP, and each word of three or more characters cut again with one less allowed."""
    out: list[tuple[str, int]] = []

    def cut(part: str, cap: int, depth: int) -> None:
        for w in mp(part, lexicon, cap):
            if len(w) > 1:
                out.append((w, depth))
            if len(w) > 2:
                cut(w, len(w) - 1, depth + 1)

    cut(text, 512, 0)
    return out


def all_segmentations(text: str, lexicon: Lexicon) -> Iterator[list[str]]:
    """Every way to cut a text into dictionary words and single characters, one after the other: memory is that of one path,
    the number of ways has no bound (a caller may stop, or LIMIT the table function's rows)."""
    stack = [(0, [])]
    while stack:
        at, words = stack.pop()
        if at == len(text):
            yield words
            continue
        stack.extend((j, [*words, text[at:j]]) for j, _ in edges_at(text, at, lexicon, 512))


def least_surprise(candidates, hmm: Hmm) -> list[str]:
    """The candidate whose characters' emissions have the least sum of -ln p (transitions left out)."""
    def cost(words: list[str]) -> float:
        tags = "".join("S" if len(w) == 1 else "B" + "M" * (len(w) - 2) + "E" for w in words)
        return sum(-hmm.emit[t].get(c, MIN_LOG) for t, c in zip(tags, "".join(words), strict=True))

    return min(candidates, key=cost)


METHODS = ("mp", "hmm", "mix", "full", "query", "level")


def segment_text(text: str, method: str, lexicon: Lexicon, hmm: Hmm | None) -> list[str]:
    call = {"mp": lambda t: mp(t, lexicon), "hmm": lambda t: hmm_cut(t, hmm), "mix": lambda t: mix(t, lexicon, hmm), "full": lambda t: full(t, lexicon), "query": lambda t: query(t, lexicon, hmm), "level": lambda t: [w for w, _ in level(t, lexicon)]}[method]
    return [w for part in _CUT.findall(text) for w in ([part] if part in SPECIAL else call(part))]


def segment(spark: SparkSession, method: str, lexicon: Lexicon, hmm: Hmm | None = None):
    """A function of a text column: its words (array<string>; null text: empty)."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    model = spark.sparkContext.broadcast((lexicon, hmm))

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        words, states = model.value
        known: dict[str, list[str]] = {}  # parts, each cut once while it is known
        held, made = 0, []
        flat, sizes = [], []

        def pack() -> None:
            made.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32)), pa.array(flat, pa.string())))
            flat.clear(), sizes.clear()

        for scalar in texts:  # words are objects for some rows only, then packed
            before = len(flat)
            for part in _CUT.findall(scalar.as_py() or ""):
                if part not in known:
                    if held > KNOWN:
                        known.clear()
                        held = 0
                    known[part] = segment_text(part, method, words, states)
                    held += len(known[part])
                flat += known[part]
            sizes.append(len(flat) - before)
            if len(flat) > PACK:
                pack()
        pack()
        return pa.concat_arrays(made)

    return cut


def levels(spark: SparkSession, lexicon: Lexicon):
    model = spark.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<struct<word:string,level:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"word": w, "level": n} for part in _CUT.findall(t or "") if part not in SPECIAL for w, n in level(part, model.value)])

    return cut


def pos_tag(tokens: DataFrame, lexicon: DataFrame, compat: bool = False) -> DataFrame:
    """Adds tag: the lexicon's, else m for numbers, eng for ASCII words, x. compat looks at the first
    half of the word only, so that one ASCII character is x."""
    word = F.col("word")
    seen = F.substring(word, F.lit(1), F.floor(F.char_length(word) / 2).cast("int")) if compat else word
    rule = F.when(F.char_length(seen) == 0, "x").when(seen.rlike(r"^[0-9.]+$"), "m").when(seen.rlike(r"^[\x00-\x7F]+$"), "eng").otherwise("x")
    known = lexicon.select("word", F.col("tag").alias("__tag")).dropDuplicates(["word"])
    return tokens.join(known, "word", "left").withColumn("tag", F.coalesce(F.nullif(F.col("__tag"), F.lit("")), rule)).drop("__tag")


def register_all_segmentations(spark: SparkSession, lexicon: Lexicon, name: str = "all_segmentations") -> None:
    """A table function name(text): a row (words array<string>) for each way to cut a text."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="words: array<string>")
    class Cut:
        def eval(self, text: str):
            for words in all_segmentations(text or "", lexicon):
                yield (words,)

    spark.udtf.register(name, Cut)
