"""Aggregates over the rolling hour, whole views and columns.

``as_of`` is the explicit "now"; left out, it is the current time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.timing import moment, newer_than
from ..schemas import SEVERITIES

HOUR = "1h"


def vehicle_event_counts(
    events: DataFrame, as_of=None, span=HOUR, time_column: str = "occurred_at"
) -> DataFrame:
    """Alerts per vehicle and severity over the rolling span."""
    return (
        events.where(newer_than(time_column, span, as_of))
        .groupBy("vehicle_id", "severity")
        .agg(F.count(F.lit(1)).alias("event_count"))
    )


def fleet_alert_summary(
    events: DataFrame, as_of=None, span=HOUR, time_column: str = "occurred_at"
) -> DataFrame:
    """Alerts and exact number of affected vehicles per severity over the rolling span.

    Folded from the per-vehicle counts: the distinct count then needs no second pass
    over alerts, and three severities never mean three busy tasks.
    """
    return (
        vehicle_event_counts(events, as_of, span, time_column)
        .groupBy("severity")
        .agg(
            F.sum("event_count").alias("alert_count"),
            F.count("vehicle_id").alias("affected_vehicles"),
        )
    )


def unified_alert_summary(unified: DataFrame, as_of=None, span=HOUR) -> DataFrame:
    return fleet_alert_summary(unified.where(F.col("severity").isNotNull()), as_of, span, "ts")


def row_count(view: DataFrame) -> DataFrame:
    return view.agg(F.count(F.lit(1)).alias("row_count"))


def freshness(view: DataFrame, time_column: str, as_of=None) -> DataFrame:
    """Newest time of a view and its age; both NULL for an empty view."""
    latest = F.max(time_column)
    return (
        view.agg(latest.alias("latest"))
        .withColumn("lag", moment(as_of) - F.col("latest"))
        .withColumn(
            "lag_seconds",
            F.expr("CAST(CAST(CAST(lag AS INTERVAL SECOND) AS DECIMAL(24,6)) AS BIGINT)"),
        )
        .select("latest", "lag", "lag_seconds")
    )


def severity_columns(summary: DataFrame) -> DataFrame:
    """One row with a count per severity; a severity without alerts counts zero."""
    return summary.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("alert_count"))), F.lit(0)).alias(s)
            for s in SEVERITIES
        ]
    )


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values of each named column with their number of rows, in one pass.

    Each row offers its (column, value) pairs; they are counted before they travel.
    """
    pairs = F.explode(
        F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
            for c in columns
        ])
    )
    return (
        df.select(pairs.alias("_pair"))
        .groupBy(F.col("_pair.column_name").alias("column_name"), F.col("_pair.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def null_counts(df: DataFrame) -> DataFrame:
    """Number of NULLs of every column, one row: a non-zero count hints at a payload mismatch."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def all_ready(status: DataFrame) -> DataFrame:
    """One row: true when there is a connector and every connector is ready."""
    return status.agg(
        F.count(F.lit(1)).alias("connectors"),
        F.coalesce(F.bool_and(F.coalesce("is_ready", F.lit(False))), F.lit(False)).alias("ready"),
    )
