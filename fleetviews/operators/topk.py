"""Orderings and top-k. A limit here is always what the caller asked for.

``orderBy`` followed by ``limit`` runs as a per-task heap, so only k rows of each task
travel. Descending order puts NULLs first and ascending last, stated explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import severity_rank


def descending(column: str) -> Column:
    return F.col(column).desc_nulls_first()


def ascending(column: str) -> Column:
    return F.col(column).asc_nulls_last()


def tie_breakers(df: DataFrame, used: list[str]) -> list[Column]:
    """Remaining sortable columns, so that equal times still give one answer."""
    first = [c for c in ("vehicle_id",) if c in df.columns and c not in used]
    rest = [
        f.name for f in df.schema.fields
        if f.name not in used + first and f.dataType.typeName() not in ("map", "variant")
    ]
    return [ascending(c) for c in first + rest]


def newest(df: DataFrame, time_column: str, k: int = 20) -> DataFrame:
    return df.orderBy(descending(time_column), *tie_breakers(df, [time_column])).limit(k)


def oldest_first(df: DataFrame, time_column: str, k: int | None = None) -> DataFrame:
    """Replay order; bounded only when asked."""
    ordered = df.orderBy(ascending(time_column), *tie_breakers(df, [time_column]))
    return ordered if k is None else ordered.limit(k)


def by_severity(summary: DataFrame) -> DataFrame:
    return summary.orderBy(severity_rank(F.col("severity")), ascending("severity"))


def most_active(counts: DataFrame, k: int) -> DataFrame:
    used = ["event_count", "vehicle_id"]
    return counts.orderBy(
        descending("event_count"), ascending("vehicle_id"), *tie_breakers(counts, used)
    ).limit(k)


def latest_windows(windows: DataFrame, k: int) -> DataFrame:
    used = ["window_end", "vehicle_id"]
    return windows.orderBy(
        descending("window_end"), ascending("vehicle_id"), *tie_breakers(windows, used)
    ).limit(k)
