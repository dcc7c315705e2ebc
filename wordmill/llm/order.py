"""Rows in one total order over many partitions, by bounds from a sketch of the key alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank of a null key: before all others.
LOWEST = -(2**63)


def partitions_of(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts - 1 ascending key values that cut df evenly. Reads the key column only."""
    if parts < 2:
        return []
    row = df.select(F.percentile_approx(F.coalesce(F.col(key), F.lit(LOWEST)), [i / parts for i in range(1, parts)], max(10_000, 20 * parts)).alias("b")).first()
    return sorted({x for x in row["b"] or []})


def part_of(key, cuts: list[int]):
    """Column: number of cuts that are at most the key (int, from 0)."""
    if not cuts:
        return F.lit(0)
    known = F.lit(cuts) if len(cuts) > 1 else F.array(F.lit(cuts[0]))
    return F.size(F.filter(known.cast("array<bigint>"), lambda b: b <= F.coalesce(key, F.lit(LOWEST)))).cast("int")


def spread(df: DataFrame, part: str, parts: int) -> DataFrame:
    """Deal rows by their partition number, one number to one partition."""
    if hasattr(df, "repartitionById"):
        return df.repartitionById(parts, F.col(part))
    return df.repartition(parts, part)
