"""Drain progress of a backlog and of running queries."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F


def drain_progress(samples: DataFrame) -> DataFrame:
    """Consumed rows, percent and rate for each (``sample_time``, ``depth``) observation.

    The first observation sets the initial depth. An empty start means there is nothing
    to drain: 100 percent at rate zero.
    """
    first = samples.agg(
        F.min_by("depth", "sample_time").alias("initial"), F.min("sample_time").alias("started")
    )
    initial, started = first.select("initial").scalar(), first.select("started").scalar()
    elapsed = (F.unix_micros("sample_time") - F.unix_micros(F.col("_started"))) / F.lit(1e6)
    return (
        samples.withColumn("_initial", initial)
        .withColumn("_started", started)
        .withColumn("consumed", F.col("_initial") - F.col("depth"))
        .withColumn(
            "percent",
            F.when(F.col("_initial") > 0, F.col("consumed") / F.col("_initial") * 100).otherwise(F.lit(100.0)),
        )
        .withColumn("elapsed_seconds", elapsed)
        .withColumn(
            "rate",
            F.when(F.col("elapsed_seconds") > 0, F.col("consumed") / F.col("elapsed_seconds")).otherwise(F.lit(0.0)),
        )
        .select("sample_time", "depth", "consumed", "percent", "elapsed_seconds", "rate")
    )


def query_samples(spark: SparkSession, progress: list, total_rows: int) -> DataFrame:
    """Depth observations of a running query out of its recent progress reports."""
    rows, left = [], total_rows
    for report in progress:
        left -= report["numInputRows"]
        rows.append((report["timestamp"], left))
    samples = spark.createDataFrame(rows, "sample_time string, depth bigint")
    return samples.withColumn("sample_time", F.to_timestamp("sample_time"))


def drained(spark: SparkSession, progress: list, total_rows: int) -> DataFrame:
    """Drain progress of a running query over a backlog of ``total_rows``, from its own progress reports: a
    row for the backlog before the first batch and one after each batch that read rows."""
    reports = [r for r in progress if r["numInputRows"]]
    if not reports:
        return drain_progress(spark.createDataFrame([], "sample_time timestamp, depth long"))
    after = query_samples(spark, reports, total_rows).withColumn(
        "sample_time", F.col("sample_time") + F.make_dt_interval(secs=F.lit(1e-6)))
    start = spark.createDataFrame([(reports[0]["timestamp"], total_rows)], "sample_time string, depth bigint")
    return drain_progress(start.withColumn("sample_time", F.to_timestamp("sample_time")).unionByName(after))


def state_rows(progress: list) -> int:
    """Largest number of state rows any report of a query mentions."""
    return max(
        (sum(s["numRowsTotal"] for s in report["stateOperators"]) for report in progress), default=0
    )


def event_time_lag(progress: list, now: datetime) -> timedelta | None:
    """Age of the newest event time a running query has seen; None before the first."""
    times = [r["eventTime"]["max"] for r in progress if "max" in r.get("eventTime", {})]
    return now - datetime.fromisoformat(max(times)) if times else None
