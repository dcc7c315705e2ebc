"""Tokenizers, sentence splitting and token filters in native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordmill.functions import chars


def unicode_words(text: Column) -> Column:
    """Lower-cased runs of letters, in order."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1)), F.array().cast("array<string>"))


def whitespace_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def ascii_tokens(text: Column) -> Column:
    """Letters then letters or digits, numbers with points, or one other character."""
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z0-9]*|[0-9][0-9.]*|[\s\S])"), F.lit(1))


def presplit(text: Column) -> Column:
    """Special symbols are tokens of their own and end what is before them."""
    special = "[" + chars.SPECIAL_SYMBOLS + "]"
    return F.regexp_extract_all(text, F.lit(f"({special}|[^{chars.SPECIAL_SYMBOLS}]+)"), F.lit(1))


def longest_match(text: Column, words: list[str]) -> Column:
    """Forward maximum matching after white space is removed: the longest word, else one character."""
    escaped = "|".join("".join("\\" + c if not c.isalnum() else c for c in w) for w in sorted(words, key=lambda w: (-len(w), w)))
    return F.regexp_extract_all(F.regexp_replace(text, r"\s+", ""), F.lit(f"({escaped}|[\\s\\S])"), F.lit(1))


def explode_tokens(rows: DataFrame, words: Column, *keep: str) -> DataFrame:
    """keep columns, pos (from 1) and word; rows without words vanish."""
    return rows.select(*keep, F.posexplode(words).alias("pos", "word")).withColumn("pos", F.col("pos") + 1)


def drop_words(tokens: DataFrame, stop: DataFrame, column: str = "word") -> DataFrame:
    """Anti-join against a word list (Spark broadcasts it if it is small enough)."""
    return tokens.join(stop.select(F.col(stop.columns[0]).alias(column)).distinct(), column, "left_anti")


def keep_words(tokens: DataFrame, known: DataFrame, column: str = "word") -> DataFrame:
    return tokens.join(known.select(F.col(known.columns[0]).alias(column)).distinct(), column, "left_semi")


def drop_single(tokens: DataFrame, white: list[str] = (), column: str = "word") -> DataFrame:
    """Words of one character go unless they are on the white list."""
    return tokens.where((F.char_length(column) > 1) | F.col(column).isin(*white)) if white else tokens.where(F.char_length(column) > 1)


def sentences(tokens: DataFrame, key: str, closed_only: bool = True) -> DataFrame:
    """Adds sent (from 0): a terminator ends its sentence. Words after the last terminator go if closed_only."""
    ends = chars.is_terminator(F.col("word")).cast("int")
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    out = tokens.withColumn("sent", F.coalesce(F.sum(ends).over(before), F.lit(0)))
    if closed_only:
        out = out.withColumn("__all", F.sum(ends).over(Window.partitionBy(key))).where(F.col("sent") < F.col("__all")).drop("__all")
    return out


def length_ok(text: Column, least: int | None = None, most: int | None = None, in_bytes: bool = False) -> Column:
    size = F.octet_length(text) if in_bytes else F.char_length(text)
    ok = F.lit(True)
    if least is not None:
        ok = ok & (size >= least)
    if most is not None:
        ok = ok & (size <= most)
    return F.coalesce(ok, F.lit(False))


def size_ok(words: Column, least: int, most: int) -> Column:
    """The number of words is in these bounds."""
    return F.coalesce(F.size(words).between(least, most), F.lit(False))


def stop_list(stop: DataFrame, targets: DataFrame, extra: list[str] = ()) -> DataFrame:
    """(word): stop words that are no targets, and some more."""
    more = stop.sparkSession.createDataFrame([(w,) for w in extra], "word string")
    return stop.select("word").join(targets.select("word"), "word", "left_anti").unionByName(more).distinct()
