"""Saved views with a zone map: the newest rows without reading what is older.

A view is saved by day, and beside it a row for each hour that has any: how many rows, and the time bounds.
The map is written from what was saved, once. A top-k by time reads it newest first, adds up rows until they
suffice, and bounds the scan there: by day, whose folders are then not listed at all, and by time, by which
row groups are skipped. A condition makes fewer rows count, so the stretch grows eightfold until it holds
k that pass; each step counts within the stretch only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.topk import newest
from .sinks import DAY, save_view, stored

GROWTH = 8


class ZonedView:
    """A view saved below ``path``, by the day of its time. Its schema need be given only for one without rows."""

    def __init__(self, spark: SparkSession, path: str, time_column: str, schema: T.StructType | None = None):
        self.spark, self.path, self.time_column = spark, path, time_column
        self.schema = T.StructType([*schema.fields, T.StructField(DAY, T.DateType())]) if schema else None

    @classmethod
    def save(cls, view: DataFrame, path: str, time_column: str) -> "ZonedView":
        save_view(view, f"{path}/rows", time_column)
        saved = cls(view.sparkSession, path, time_column, view.schema)
        time = F.col(time_column)
        hours = saved._rows().groupBy(F.date_trunc("hour", time).alias("hour")).agg(
            F.count(F.lit(1)).alias("rows"), F.min(time).alias("first"), F.max(time).alias("last"))
        hours.coalesce(1).write.mode("overwrite").parquet(f"{path}/zones")
        return saved

    def _rows(self) -> DataFrame:
        return stored(self.spark, f"{self.path}/rows", self.schema)

    def read(self) -> DataFrame:
        return self._rows().drop(DAY)

    def zones(self) -> DataFrame:
        """hour, rows, first, last; rows without a time are an hour of their own."""
        return self.spark.read.parquet(f"{self.path}/zones")

    def _since(self, bound) -> DataFrame:
        """Rows from a zone's first time on, and those without a time, which are the newest of all."""
        recent = (F.col(DAY) >= F.to_date(F.lit(bound))) & (F.col(self.time_column) >= F.lit(bound))
        return self._rows().where(F.col(DAY).isNull() | recent).drop(DAY)

    def newest_rows(self, k: int, kept: Column | None = None) -> DataFrame:
        """Rows that pass, among which are the k newest of those."""
        certain, passing = kept is None, F.lit(True) if kept is None else kept
        needed, seen = k, 0
        # Hours that no one asks for stay in the table; those read are as many as k spreads over.
        for zone in self.zones().orderBy(F.col("hour").desc_nulls_first()).toLocalIterator():
            seen += zone["rows"]
            if zone["hour"] is None or seen < needed:
                continue
            stretch = self._since(zone["first"]).where(passing)
            if certain or stretch.limit(k).count() >= k:
                return stretch
            needed = GROWTH * seen
        return self.read().where(passing)

    def newest(self, k: int, kept: Column | None = None) -> DataFrame:
        return newest(self.newest_rows(k, kept), self.time_column, k)
