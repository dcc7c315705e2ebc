"""Character predicates as native column expressions (no Python on rows)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ranges and characters below must equal the original's for equal results.
ZH_RANGES = r"\x{2E80}-\x{2FEF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FBB}\x{F900}-\x{FAD9}\x{20000}-\x{2A6DF}"
PUNCT_RANGES = r"!-/:-@\[-`{-~\x{2000}-\x{206F}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}\x{FE30}-\x{FE4F}"
TERMINATORS = "!?,;.！？，。…"
ZH_NUMBERS = "十百千万亿一二三四五六七八九零几"
SPECIAL_SYMBOLS = " \t\n。，"


def is_zh(ch) -> Column:
    """One CJK character."""
    return F.col(ch).rlike(f"^[{ZH_RANGES}]$") if isinstance(ch, str) else ch.rlike(f"^[{ZH_RANGES}]$")


def is_zhs(text: Column, no_numbers: bool = False) -> Column:
    """All characters are CJK (true for the empty text); no_numbers also rejects numerals."""
    every = text.rlike(f"^[{ZH_RANGES}]*$")
    return every & ~text.rlike(f"[{ZH_NUMBERS}]") if no_numbers else every


def is_punct(ch: Column) -> Column:
    return ch.rlike(f"^[{PUNCT_RANGES}]$")


def is_terminator(ch: Column) -> Column:
    return ch.isin(*TERMINATORS)


def is_zh_number(ch: Column) -> Column:
    return ch.isin(*ZH_NUMBERS)


def is_multibyte_word(word: Column) -> Column:
    """Starts with a non-ASCII character and has more than one character."""
    return (F.char_length(word) > 1) & word.rlike(r"^[^\x00-\x7F]")


def count_class(text: Column, ranges: str) -> Column:
    """Number of characters in a class; null text has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[{ranges}]")), F.lit(0))
