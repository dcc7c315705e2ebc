"""String, array and math helpers that differ from Spark's built-ins in detail."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_any(text: Column, delimiters: str, limit: int = -1) -> Column:
    """Split at any of the characters, trim each piece, drop a trailing empty piece."""
    parts = F.transform(F.split(text, "[" + re.escape(delimiters) + "]", limit), lambda p: F.trim(p))
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def split_line(text: Column, delimiter: str) -> Column:
    """Split at one character; one trailing empty piece is dropped (as reading by lines does)."""
    parts = F.split(text, re.escape(delimiter), -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def trim_char(text: Column, ch: str) -> Column:
    return F.btrim(text, F.lit(ch))


def path_join(left: Column, right: Column) -> Column:
    return F.when(left.endswith("/"), F.concat(left, right)).otherwise(F.concat(left, F.lit("/"), right))


def join_slice(words: Column, start: int = 0, stop: int = 0, sep: str = " ") -> Column:
    """Words start to stop (both from 0, inclusive; stop 0 means the last) joined."""
    length = F.size(words) - start if stop == 0 else F.lit(stop - start + 1)
    return F.array_join(F.slice(words, start + 1, F.greatest(length, F.lit(0))), sep)


def occurrences(text: Column, part: Column) -> Column:
    """How often a substring occurs, without overlaps."""
    return F.when(F.char_length(part) == 0, F.lit(0)).otherwise(((F.char_length(text) - F.char_length(F.replace(text, part, F.lit("")))) / F.char_length(part)).cast("int"))


def log_sum_exp(values: Column) -> Column:
    """Stable natural log of the sum of exponentials of an array."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))


def softmax(values: Column) -> Column:
    norm = log_sum_exp(values)
    return F.transform(values, lambda x: F.exp(x - norm))


def argmax(values: Column) -> Column:
    """Position (from 1) of the first maximum of an array."""
    return F.array_position(values, F.array_max(values))


def argsort(values: Column, descending: bool = False) -> Column:
    """Places (from 1) of an array's elements in order; of equal ones the first place first."""
    sign = -1 if descending else 1
    placed = F.transform(values, lambda x, i: F.struct((x * sign).alias("x"), (i + 1).alias("i")))
    return F.transform(F.array_sort(placed), lambda p: p["i"])


def shown(value: Column) -> Column:
    """An array, map or struct as text (JSON)."""
    return F.to_json(value)


def file_digests(spark, path: str):
    """(path, md5): the MD5 of whole files (each as large as a row may be)."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def pack(high: Column, low: Column, bits: int) -> Column:
    """One long key of two ids; unpack with unpack_high and unpack_low."""
    return F.shiftleft(high.cast("long"), bits).bitwiseOR(low.cast("long"))


def unpack_high(key: Column, bits: int) -> Column:
    return F.shiftright(key, bits)


def unpack_low(key: Column, bits: int) -> Column:
    return key.bitwiseAND(F.lit((1 << bits) - 1))


def md5_text(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def formatted_now(pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(F.current_timestamp(), pattern)
