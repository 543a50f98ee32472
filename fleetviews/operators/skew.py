"""Finding groups that are too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PARTS, ROWS = "_parts", "_rows"


def oversized(df: DataFrame, on: list[str], max_rows: int, most: Column | None = None) -> DataFrame:
    """Groups of ``on`` with more than ``max_rows`` rows, and into how many parts to cut each.

    ``most`` bounds the parts, and may speak of the group's number of ``ROWS``.
    The counting reads only the group columns and combines on the map side. Nothing runs
    here: how the list is joined is decided when its size has been measured.
    """
    parts = F.ceil(F.col(ROWS) / F.lit(max_rows)).cast("int")
    if most is not None:
        parts = F.least(parts, most)
    return (
        df.groupBy(*on)
        .agg(F.count(F.lit(1)).alias(ROWS))
        .where(F.col(ROWS) > max_rows)
        .select(*on, parts.alias(PARTS))
    )


def with_parts(df: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """Adds the number of parts of each row's group, one where it is not oversized."""
    return df.join(groups, on, "left").withColumn(PARTS, F.coalesce(PARTS, F.lit(1)))
