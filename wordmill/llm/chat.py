"""4. Chat formatting in budgeted windows.

The prefix sums of a conversation's turn tokens say how many turns fit into a window: each window
holds the leading system turn, as many repeated turns before it as the history budget allows, and
then new turns up to the budget; a turn that is larger than the budget is a window's only new turn
and stays whole. Only the texts of new assistant turns are under the loss mask: a repeated target
is masked, so that each assistant text counts once.

Template: `<<SYS>>text<</SYS>>`, `[INST]text[/INST]`, `<s>text</s>` for system, user and assistant,
`<<ROLE:name>>text<</ROLE>>` for others. A control string inside a text gets a backslash after its
first character, and a backslash is doubled; unescaping takes single backslashes away again.

Rows of a conversation are dealt by its id and stream through a task in order: what is held is one
window and its history, so a conversation of any length is formatted in bounded memory.

Edge cases: a null text is empty; a null role is the role ``""``; turns are ordered by turn (null
first), then role and text, so repeated rows each stay a turn; a null conv_id is a conversation; a text of any length
is one turn; further columns are not read, whatever their names; an empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.llm import bpe

BUDGET, HISTORY = 512, 128
SYSTEM, USER, ASSISTANT = "system", "user", "assistant"
MARKS = {SYSTEM: ("<<SYS>>", "<</SYS>>"), USER: ("[INST]", "[/INST]"), ASSISTANT: ("<s>", "</s>")}
OTHER, OTHER_END = "<<ROLE:", "<</ROLE>>"
CONTROL = re.compile("|".join(map(re.escape, [OTHER, OTHER_END, *(m for pair in MARKS.values() for m in pair)])))
OPEN = re.compile(r"<<SYS>>|\[INST\]|<s>|<<ROLE:([^>]*)>>")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WINDOWS = "conv_id long, window long, first_turn long, repeated int, tokens long, text string, loss array<struct<start:int,stop:int>>"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def marks(role: str) -> tuple[str, str]:
    return MARKS.get(role) or (f"{OTHER}{quote(role, safe='')}>>", OTHER_END)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, unescaped text) of each turn of a formatted window."""
    out, at = [], 0
    while at < len(text):
        m = OPEN.match(text, at)
        if not m:
            raise ValueError(f"no turn starts at {at}")
        role = next((r for r, (o, _) in MARKS.items() if o == m[0]), None)
        close = MARKS[role][1] if role else OTHER_END
        end = text.index(close, m.end())
        out.append((role or unquote(m[1]), unescape(text[m.end() : end])))
        at = end + len(close)
    return out


def count_words(texts: list[str]) -> list[int]:
    """Tokens of turns where no tokenizer is given: words, and two for the marks."""
    return [sum(1 for _ in WORD.finditer(t)) + 2 for t in texts]


def count_ids(tokenizer: str):
    """Tokens of turns as operator 1 encodes them, and two for the marks."""

    def count(texts: list[str]) -> list[int]:
        ends = bpe.encoder(tokenizer).column(pa.array(texts, pa.large_string()))[1]
        return [b - a + 2 for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]

    return count


class Conversation:
    """Turns in, windows out. Sums of tokens run over the whole conversation."""

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system: tuple[str, str, int] | None = None
        self.past: deque[tuple[str, str, int]] = deque()  # turns before the window, with the sum before each
        self.new: list[tuple[str, str, int]] = []
        self.sum = self.turns = self.windows = 0
        self.start = 0  # the sum before the window's first new turn

    def room(self) -> int:
        """Tokens for new turns: the budget less the system turn and the history."""
        repeated = self.start - self.past[0][2] if self.past else 0
        return self.budget - (self.system[2] if self.system and self.windows else 0) - repeated

    def add(self, role: str, text: str, n: int) -> Iterator[tuple]:
        """n: the turn's tokens."""
        if self.new and self.sum + n - self.start > self.room():
            yield self.close()
        self.new.append((role, text, self.sum))
        if not self.turns and role == SYSTEM:
            self.system = (role, text, n)
        self.sum += n
        self.turns += 1

    def close(self) -> tuple:
        led = [self.system[:2]] if self.system and self.windows else []
        repeated = [*led, *((r, t) for r, t, _ in self.past)]
        parts, loss, at = [], [], 0
        for i, (role, text) in enumerate([*repeated, *((r, t) for r, t, _ in self.new)]):
            begin, end = marks(role)
            body = escape(text)
            if role == ASSISTANT and i >= len(repeated):
                loss.append({"start": at + len(begin), "stop": at + len(begin) + len(body)})
            parts += [begin, body, end]
            at += len(begin) + len(body) + len(end)
        first = self.turns - len(self.new)
        tokens = self.sum - self.start + (self.start - self.past[0][2] if self.past else 0) + (self.system[2] if led else 0)
        row = (self.conv, self.windows, first, len(repeated), tokens, "".join(parts), loss)
        # the history of the next window: the last turns whose tokens fit, the system turn aside
        for turn in self.new[1 if self.system and not self.windows else 0 :]:
            self.past.append(turn)
        while self.past and self.sum - self.past[0][2] > self.history:
            self.past.popleft()
        self.new, self.start = [], self.sum
        self.windows += 1
        return row


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, window, first_turn (number of the first new turn), repeated (leading turns that an
    earlier window had), tokens, text and loss (spans of code points in text). Windows of a conversation follow one
    another in one partition. tokenizer: the file by which operator 1 counts a turn's tokens (None: words are counted)."""
    count = count_ids(tokenizer) if tokenizer else count_words
    if tokenizer:
        bpe.ship(turns.sparkSession, tokenizer)
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
    names = ["conv_id", "window", "first_turn", "repeated", "tokens", "text", "loss"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def packed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
            out.clear()
            return batch

        for batch in batches:
            cids, roles, texts = (c.to_pylist() for c in batch.columns)
            for cid, who, body, n in zip(cids, roles, texts, count(texts), strict=True):
                if now is None or now.conv != cid:
                    if now:
                        out.append(now.close())
                    now = Conversation(cid, budget, history)
                out.extend(now.add(who, body, n))
                if len(out) >= 512:
                    yield packed()
        if now:
            out.append(now.close())
        if out:
            yield packed()

    return dealt.mapInArrow(run, WINDOWS)


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """What windows() wrote, read from text, repeated and loss alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. Streams windows in order; holds one at a time.

    in_order: formatted is just what windows() returns, so its rows need not be dealt and sorted again."""
    dealt = formatted.select("conv_id", "window", "repeated", "text", "loss")
    dealt = dealt if in_order else dealt.repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, state, now = [], None, None

        def ended() -> None:
            out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def packed() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out.clear()
            return batch

        for batch in batches:
            for cid, _, repeated, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or cid != now:
                    if state:
                        ended()
                    now, state = cid, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                for span in loss:
                    body = unescape(text[span["start"] : span["stop"]])
                    state[2] += len(body)
                    state[3].update(body.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if len(out) >= 4096:
                yield packed()
        if state:
            ended()
        if out:
            yield packed()

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
