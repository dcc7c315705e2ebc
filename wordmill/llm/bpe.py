"""1. BPE encoding and decoding by a prefix-sharing trie.

A sequence of tokens is the byte-pair encoding of a word if and only if each two neighbours stay
apart when their bytes are encoded together. So the encoding of a prefix is known by its last
token and the encoding of a shorter prefix. The distinct words of a slice are put into a trie
(held in sorted order, so that the walk over the words is the depth-first walk over its nodes);
each node gets its last token once, for all words that share the prefix.

Edge cases: a null text is encoded as the empty text (no ids, decoded text empty); special token
strings in a text become their ids, as the tokenizers library does; rows are kept one to one, so
repeated rows, null ids and further columns are carried through unchanged.
"""

from __future__ import annotations

import gc
import json
import os
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from wordmill.llm.common import slices, small_batches

NEVER = 1 << 30
#: Words that a worker remembers, bytes of text that it cuts at a time, and pairs of tokens that it remembers.
KNOWN, WINDOW = 500_000, 1 << 20
PAIR_ENTRIES = 400_000

#: The split pattern of the word-level vocabulary, for code points below U+0300.
ASCII_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
LATIN_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: ASCII signs that are a word of their own at the end of a chunk of letters.
ENDS = frozenset(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())
#: Chunks of these need no composition and have no white space of Unicode in them.
ASCII_SAFE = re.compile(rb"[!-~]+")
LATIN_SAFE = re.compile("[!-~¡-˿]+")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def ship(spark: SparkSession, path: str) -> None:
    """Send the tokenizer's file along, for executors that do not have it at its path."""
    if path not in _shipped:
        spark.sparkContext.addFile(path)
        _shipped.add(path)


_shipped: set[str] = set()


def local(path: str) -> str:
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


class Vocabulary:
    """Merges of a byte-level BPE file with word ends, and which tokens can stand side by side."""

    def __init__(self, path: str):
        self.path, self.library = path, None
        spec = self._read()
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.content: list[str] = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for text, i in [*ids.items(), *self.special.items()]:
            self.content[i] = text
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.to_bytes = {c: b for b, c in enumerate(byte_symbols())}.__getitem__
        self.inner: dict[bytes, int] = {}

    def _read(self) -> dict:
        with open(local(self.path), encoding="utf-8") as file:
            return json.load(file)

    def _prepare(self) -> None:
        """The tables that encode_words() needs."""
        model, size = self._read()["model"], len(self.content)
        ids, end = model["vocab"], model["end_of_word_suffix"]
        as_byte = {c: b for b, c in enumerate(byte_symbols())}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank: dict[int, int] = {}
        parts: dict[int, tuple[int, int]] = {}
        born = [-1] * size
        for r, (a, b) in enumerate(merges):
            left, right, whole = ids[a], ids[b], ids[a + b]
            self.rank[left << 20 | right] = r
            if whole not in parts:
                parts[whole], born[whole] = (left, right), r
        # the tokens that a neighbour may meet while this one is still in pieces, and until when
        self.right_edge: list[list[tuple[int, int]]] = [[(t, NEVER)] for t in range(size)]
        self.left_edge: list[list[tuple[int, int]]] = [[(t, NEVER)] for t in range(size)]
        for whole in sorted(parts, key=born.__getitem__):
            left, right = parts[whole]
            self.right_edge[whole] += [(t, min(until, born[whole])) for t, until in self.right_edge[right]]
            self.left_edge[whole] += [(t, min(until, born[whole])) for t, until in self.left_edge[left]]
        self.apart: dict[int, bool] = {}
        reached = [t not in parts for t in range(size)]
        for whole in sorted(parts, key=born.__getitem__):
            left, right = parts[whole]
            reached[whole] = reached[left] and reached[right] and self._meet(left, right, born[whole]) is None
        self.final: dict[bytes, int] = {}
        for text, i in ids.items():
            body = text.removesuffix(end) if text != end and text.endswith(end) else text
            if reached[i] and all(c in as_byte for c in body):
                (self.inner if body is text else self.final)[bytes(map(as_byte.__getitem__, body))] = i
        self.inner_lengths, self.final_lengths = self._lengths(self.inner), self._lengths(self.final)

    @staticmethod
    def _lengths(table: dict[bytes, int]) -> dict[bytes, tuple[int, ...]]:
        """For the last three, two or one bytes of a prefix: lengths of the tokens that may end it, long ones first."""
        out: dict[bytes, set[int]] = {}
        for token in table:
            out.setdefault(token[-3:], set()).add(len(token))
        for tail in sorted(out, key=len):
            for short in (tail[1:], tail[2:]):
                if short and short in table:
                    out[tail].add(len(short))
        for token in table:  # tails that no long token ends, but a short one does
            if len(token) > 3:
                continue
            out[token].add(len(token))
        return {tail: tuple(sorted(x, reverse=True)) for tail, x in out.items()}

    def _meet(self, left: int, right: int, before: int = NEVER) -> int | None:
        """The rank of a merge across the border of two tokens that comes before their own merges."""
        for a, a_until in self.right_edge[left]:
            for b, b_until in self.left_edge[right]:
                r = self.rank.get(a << 20 | b)
                if r is not None and r < before and r < a_until and r <= b_until:
                    return r
        return None

    def stay_apart(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) >= PAIR_ENTRIES:
                self.apart.clear()
            known = self.apart[key] = self._meet(left, right) is None
        return known

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Ids of distinct words (not empty). Depth-first over their trie; last[n] is the last
        token of the path's first n bytes, kept for the next word as far as the prefix is shared."""
        if not self.inner:
            self._prepare()
        out: dict[bytes, tuple[int, ...]] = {}
        apart, stay_apart = self.apart, self.stay_apart
        inner, final, inner_lengths, final_lengths = self.inner, self.final, self.inner_lengths, self.final_lengths
        last, starts = [0], [0]
        before, t = b"", 0
        for word in sorted(words):
            n = len(word)
            depth = min(len(before), n) - 1
            if depth > 0 and before[:depth] != word[:depth]:
                depth = next(i for i in range(depth) if before[i] != word[i])
            del last[max(depth, 0) + 1 :], starts[max(depth, 0) + 1 :]
            for stop in range(len(last), n + 1):
                table, lengths = (final, final_lengths) if stop == n else (inner, inner_lengths)
                tail = word[max(0, stop - 3) : stop]
                for size in lengths.get(tail) or lengths.get(tail[-2:]) or lengths[tail[-1:]]:
                    start = stop - size
                    if start < 0:
                        continue
                    t = table.get(word[start:stop])
                    if t is None:
                        continue
                    if not start:
                        break
                    known = apart.get(last[start] << 20 | t)
                    if known or known is None and stay_apart(last[start], t):
                        break
                else:
                    raise ValueError(f"no token ends {word[:stop]!r}")
                if stop < n:
                    last.append(t)
                    starts.append(start)
            ids = [t]
            while start:
                ids.append(last[start])
                start = starts[start]
            ids.reverse()
            out[word] = tuple(ids)
            before = word
        return out

    def words(self, chunk: bytes) -> list[bytes]:
        """Normalise a chunk without ASCII white space or special tokens and split it into words."""
        if ASCII_SAFE.fullmatch(chunk):
            return ASCII_WORDS.findall(chunk.lower())
        text = chunk.decode()
        if LATIN_SAFE.fullmatch(text):
            text = text.lower()
            if text.isalpha():
                return [text.encode()]
            if chunk[-1:] in ENDS and text[:-1].isalpha():
                return [text[:-1].encode(), chunk[-1:]]
            return [w.encode() for w in LATIN_WORDS.findall(text)]
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(local(self.path))
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.to_bytes, piece)) for piece, _ in pieces if piece]

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings joined by spaces (the file names no decoder); unknown ids are left out."""
        content = self.content
        return " ".join([content[i] for i in ids if 0 <= i < len(content) and content[i]])


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


WHITE, LETTER, DIGIT, SIGN = range(4)
#: Class of each byte; bytes from 128 on count as letters, and chunks where that is wrong are odd.
CLASS = np.full(256, SIGN, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = WHITE
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
CLASS[48:58] = DIGIT
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that make a chunk odd wherever they stand: control signs, and leads other than that of U+00C0 to U+00FF.
ODD = np.zeros(256, bool)
ODD[[*range(9), *range(14, 32), 127, *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True
LEAD, APOSTROPHE = 0xC3, 0x27
#: Masks that keep the first n bytes of a little-endian 64-bit word.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
MIX_HIGH, MIX = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15)


def contractions(low: np.ndarray, starts: np.ndarray, stops: np.ndarray, kind: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join a lone apostrophe with the s, t, m, d, re, ve or ll that follows it; the rest of those letters is a word of its own."""
    at = np.flatnonzero((low[starts] == APOSTROPHE) & (stops - starts == 1))
    at = at[at + 1 < len(starts)]
    after = starts[at + 1]
    near = (after == stops[at]) & (kind[at + 1] == LETTER) & ~opens[after]
    at, after = at[near], after[near]
    if not len(at):
        return starts, stops, kind
    one, two = low[after], low[np.minimum(after + 1, len(low) - 1)]
    long = (stops[at + 1] - after >= 2) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 1, np.where(long, 2, 0))
    starts, stops = starts.copy(), stops.copy()
    stops[at] += size
    starts[at + 1] += size
    left = starts < stops
    return starts[left], stops[left], kind[left]


class Words:
    """Known words, in arrays: a word of up to 16 bytes is two 64-bit numbers (compared whole, so matches are exact) in an open
    hash table; others, and chunks that need the library's own splitting, are in a dictionary. Entry i has ids[off[i]:off[i + 1]]."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.slots = np.zeros(1 << 16, np.int32)
        self.low = np.zeros(1 << 12, np.uint64)
        self.high, self.off = self.low.copy(), np.zeros((1 << 12) + 1, np.int64)
        self.ids = np.zeros(1 << 13, np.uint32)
        self.count = self.held = 0
        self.others: dict[bytes, int] = {}

    def __len__(self) -> int:
        return self.count

    def add(self, found: list[tuple[int, ...]]) -> int:
        """Append entries; the first one's number."""
        first, need = self.count, sum(map(len, found))
        while self.count + len(found) > len(self.low):
            self.low, self.high = (np.concatenate([x, np.zeros_like(x)]) for x in (self.low, self.high))
            self.off = np.concatenate([self.off, np.zeros(len(self.off) - 1, np.int64)])
        while self.held + need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.held : self.held + need] = np.fromiter((i for x in found for i in x), np.uint32, need)
        self.off[first + 1 : first + len(found) + 1] = self.held + np.cumsum([len(x) for x in found])
        self.count, self.held = first + len(found), self.held + need
        return first

    def place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return ((low ^ high * MIX_HIGH) * MIX >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def enter(self, numbers: np.ndarray) -> None:
        """Give entries their slots."""
        if 2 * self.count > len(self.slots):
            self.slots = np.zeros(4 << (self.count - 1).bit_length(), np.int32)
            numbers = np.setdiff1d(np.arange(self.count), np.fromiter(self.others.values(), np.int64, len(self.others)))
        at, last = self.place(self.low[numbers], self.high[numbers]), len(self.slots) - 1
        while len(numbers):
            free = self.slots[at] == 0
            self.slots[at[free]] = numbers[free] + 1
            left = self.slots[at] != numbers + 1
            numbers, at = numbers[left], (at[left] + 1) & last

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Entry of each word, or -1."""
        out = np.full(len(low), -1, np.int64)
        todo, at, last = np.arange(len(low)), self.place(low, high), len(self.slots) - 1
        while len(todo):
            entry = self.slots[at].astype(np.int64) - 1
            same = (entry >= 0) & (self.low[entry] == low[todo]) & (self.high[entry] == high[todo])
            out[todo[same]] = entry[same]
            on = (entry >= 0) & ~same
            todo, at = todo[on], (at[on] + 1) & last
        return out


class Encoder:
    """Texts to ids. Words are cut and looked up by whole arrays; only words not met before are encoded one by one.

    The known words are forgotten when there are more than KNOWN of them, after a window of about WINDOW bytes."""

    def __init__(self, path: str, encode_words=None, known: int = KNOWN, window: int = WINDOW):
        self.vocabulary, self.table = vocabulary(path), Words()
        self.encode_words = encode_words or self.vocabulary.encode_words
        self.known, self.window = known, window

    def pieces(self, chunk: bytes) -> list:
        """Words of a chunk; special tokens in it as their ids."""
        special, split = self.vocabulary.special, self.vocabulary.special_split
        if split is None or b"<" not in chunk or len(parts := split.split(chunk.decode())) == 1:
            return self.vocabulary.words(chunk)
        return [p for part in parts if part for p in ([special[part]] if part in special else self.vocabulary.words(part.encode()))]

    def cut(self, data: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes in lower case, starts, stops, odd) of the words of data; an odd one is a whole chunk between white space,
        as it stands in data. opens: where texts begin."""
        n = len(data)
        kind, low = CLASS[data], LOWER[data]
        bad = ODD[data]
        after = np.zeros(n, bool)
        after[1:] = data[:-1] == LEAD
        rest = (data & 0xC0) == 0x80
        low[after & (data <= 0x9E)] |= 0x20
        bad |= rest & ~after
        bad |= after & ((data == 0x97) | (data == 0xB7))
        angle = np.flatnonzero(data[:-1] == ord("<"))
        bad[angle[data[angle + 1] == ord("|")]] = True
        edge = np.ones(n, bool)
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | opens[1:]
        starts = np.flatnonzero(edge)
        stops = np.append(starts[1:], n)
        some = kind[starts]
        leads = some != WHITE
        leads[1:] &= (some[:-1] == WHITE) | opens[starts[1:]]
        word = some != WHITE
        if not bad.any():
            starts, stops, some = contractions(low, starts[word], stops[word], some[word], opens)
            return low, starts, stops, np.zeros(len(starts), bool)
        odd = np.logical_or.reduceat(bad, starts)[word]
        chunk = np.cumsum(leads)[word] - 1
        starts, stops, some, leads = starts[word], stops[word], some[word], leads[word]
        wrong = np.zeros(chunk[-1] + 1 if len(chunk) else 0, bool)
        wrong[chunk[odd]] = True
        ends = stops[np.append(leads[1:], True)] if len(leads) else stops
        wrong_here = wrong[chunk]
        heads = wrong_here & leads
        plain = contractions(low, starts[~wrong_here], stops[~wrong_here], some[~wrong_here], opens)[:2]
        own = starts[heads], ends[chunk[heads]]
        starts, stops = np.concatenate([plain[0], own[0]]), np.concatenate([plain[1], own[1]])
        odd = np.arange(len(starts)) >= len(plain[0])
        by = np.argsort(starts, kind="stable")
        return low, starts[by], stops[by], odd[by]

    def learn(self, words: set[bytes], chunks: set[bytes]) -> None:
        """Encode new words (of up to 16 bytes, cut and in lower case; or longer), and chunks that are odd."""
        split = {c: self.pieces(c) for c in chunks}
        wanted = words.union(p for parts in split.values() for p in parts if p.__class__ is bytes)
        code, table = self.encode_words(wanted), self.table
        short = [w for w in words if len(w) <= 16]
        if short:
            first = table.add([code[w] for w in short])
            both = np.frombuffer(b"".join([w.ljust(16, b"\0") for w in short]), "<u8").reshape(-1, 2)
            table.low[first : table.count], table.high[first : table.count] = both[:, 0], both[:, 1]
            table.enter(np.arange(first, table.count))
        others = [(w, code[w]) for w in words if len(w) > 16]
        # a word in lower case and a chunk as it stands are told apart by a leading blank, which no chunk has
        others = [(b" " + w, ids) for w, ids in others] + [(c, tuple(i for p in parts for i in (code[p] if p.__class__ is bytes else (p,)))) for c, parts in split.items()]
        if others:
            first = table.add([ids for _, ids in others])
            table.others.update((w, first + i) for i, (w, _) in enumerate(others))

    def entries(self, data: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, start) of each word of a window."""
        low, starts, stops, odd = self.cut(data, opens)
        if not len(starts):
            return np.zeros(0, np.int64), starts
        padded = np.concatenate([low, np.zeros(16, np.uint8)])
        words = np.ndarray((len(low) + 8,), "<u8", padded, strides=(1,)).copy()
        size = stops - starts
        short = (size <= 16) & ~odd
        whole = bool(short.all())
        at, n = (starts, size) if whole else (starts[short], size[short])
        first, second = words[at] & FIRST[np.minimum(n, 8)], words[at + np.minimum(n, 8)] & FIRST[np.maximum(n, 8) - 8]
        found = self.table.find(first, second)
        lower, raw = low.tobytes(), data.tobytes()
        others: list[bytes] = []
        rest = np.zeros(0, np.int64)
        if not whole:
            rest = np.flatnonzero(~short)
            others = [raw[a:b] if o else b" " + lower[a:b] for a, b, o in zip(starts[rest].tolist(), stops[rest].tolist(), odd[rest].tolist(), strict=True)]
        new = found < 0
        missing = {lower[a : a + k] for a, k in zip(at[new].tolist(), n[new].tolist(), strict=True)}
        unknown = {w for w in others if w not in self.table.others}
        if missing or unknown:
            self.learn(missing | {w[1:] for w in unknown if w[0] == 32}, {w for w in unknown if w[0] != 32})
            found[new] = self.table.find(first[new], second[new])
        out = found
        if not whole:
            out = np.empty(len(starts), np.int64)
            out[short] = found
            out[rest] = [self.table.others[w] for w in others]
        return out, starts

    def windows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pieces of about self.window bytes that begin and end at white space or at texts' borders."""
        at, n = 0, len(data)
        while at < n:
            stop = min(n, at + self.window)
            if stop < n:
                border = offsets[np.searchsorted(offsets, stop, side="right") - 1]
                white = np.flatnonzero(CLASS[data[max(at, stop - 4096) : stop]] == WHITE)
                cut = max(int(border), max(at, stop - 4096) + int(white[-1]) + 1 if len(white) else 0)
                while cut <= at and stop < n:  # no white space so far
                    white = np.flatnonzero(CLASS[data[stop : stop + self.window]] == WHITE)
                    nearest = int(offsets[np.searchsorted(offsets, stop, side="left")])
                    cut = min(nearest, stop + int(white[0])) if len(white) else nearest if nearest <= stop + self.window else 0
                    stop = min(n, stop + self.window)
                stop = cut if cut > at else n
            yield at, stop
            at = stop

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts and the place in them where each text begins; text i is data[offsets[i]:offsets[i + 1]]."""
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic
        try:
            ids: list[np.ndarray] = []
            sizes = np.zeros(len(offsets) - 1, np.int64)
            table = self.table
            for a, b in self.windows(data, offsets):
                opens = np.zeros(b - a, bool)
                low, high = np.searchsorted(offsets, [a, b], side="left")
                opens[offsets[low:high] - a] = True
                entry, starts = self.entries(data[a:b], opens)
                begin = table.off[entry]
                n = table.off[entry + 1] - begin
                upto = np.concatenate([[0], np.cumsum(n)])
                ids.append(table.ids[np.repeat(begin - upto[:-1], n) + np.arange(upto[-1])])
                first = np.searchsorted(offsets, a, side="right") - 1
                last = np.searchsorted(offsets, b, side="left")
                inside = np.searchsorted(starts, np.clip(offsets[first : last + 1] - a, 0, b - a))
                sizes[first:last] += np.diff(upto[inside])
                if len(table) > self.known:
                    table.clear()
            return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum(sizes)])
        finally:
            if collects:
                gc.enable()

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode() of an Arrow column of strings, null as empty."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if offsets else np.zeros(1, np.int64)
        whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        return self.encode(whole[offsets[0] : offsets[-1]], offsets - offsets[0])

    def batch(self, texts: list[bytes]) -> list[bytes]:
        """Packed little-endian 32-bit ids of each text."""
        ids, at = self.column(pa.array(texts, pa.large_binary()))
        packed = ids.astype("<u4").tobytes()
        return [packed[4 * a : 4 * b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)]


def packed(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary column of the ids of each text; at: where texts begin, and the end."""
    data = pa.py_buffer(np.ascontiguousarray(ids))
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * ids.itemsize).astype(np.int32)), data])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per Python worker, used again by its later tasks."""
    return Encoder(path)


def unpack(ids: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(ids) // 4}I", ids)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", keep: list[str] | None = None, decode: bool = True) -> DataFrame:
    """Rows of docs with the columns keep (default: all but text), n_tokens long, ids binary (packed
    little-endian unsigned 32-bit) and, if decode, decoded string (made from the ids).

    One scan, no shuffle: distinct words are found per slice of a task, never globally.
    A kept column of a clashing name must be renamed by the caller first (ValueError)."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    if clash := {"n_tokens", "ids", "decoded"} & {*keep}:
        raise ValueError(f"columns {sorted(clash)} would clash")
    small_batches(docs.sparkSession)
    ship(docs.sparkSession, tokenizer)
    kept = T.StructType([docs.schema[c] for c in keep])
    schema = T.StructType([*kept, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), *([T.StructField("decoded", T.StringType())] if decode else [])])
    inner = "__text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        show = coder.vocabulary.decode
        for piece in slices(batches, inner):
            ids, at = coder.column(piece.column(piece.schema.get_field_index(inner)))
            made = [pa.array(np.diff(at), pa.int64()), packed(ids, at)]
            if decode:
                made.append(pa.array([show(ids[a:b].tolist()) for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)], pa.string()))
            names = [*keep, "n_tokens", "ids", "decoded"][: len(keep) + len(made)]
            yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(len(keep))), *made], names=names)

    return docs.select(*[docs[f"`{c}`"] for c in keep], docs[f"`{text}`"].alias(inner)).mapInArrow(run, schema)


def decode(rows: DataFrame, tokenizer: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Rows with a column out: the text of packed ids (null ids: null)."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def show(column):
        import pandas as pd

        of = vocabulary(tokenizer)
        return pd.Series([None if x is None else of.decode(unpack(x)) for x in column])

    return rows.withColumn(out, show(rows[ids]))
