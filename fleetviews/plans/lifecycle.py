"""Creating, persisting, stopping and re-creating views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import work_dir
from ..sources.keyed import EVERY, KeyedTable, keyed_stream
from ..sources.sinks import append_stream, save_view, stored
from .viewset import ROUTING, ViewSet


def ensure_views(spark: SparkSession, views: ViewSet) -> list[str]:
    """Register the temp views that are missing; returns their names. Safe to repeat."""
    missing = [name for name in views.names() if not spark.catalog.tableExists(name)]
    return views.register(spark, missing) if missing else []


def drop_registered(spark: SparkSession, views: ViewSet) -> list[str]:
    """Drop all temp views, dependents before what they read. Missing ones are fine."""
    order = [n for n in views.names() if n not in ROUTING][::-1] + [
        n for n in ROUTING if n in views
    ]
    return [name for name in order if spark.catalog.dropTempView(name)]


def persist_view(spark: SparkSession, view: DataFrame, name: str, root: str | None = None,
                 time_column: str | None = None) -> DataFrame:
    """Write a view once into the shared folder and read it from there.

    Worth it for a view many queries share; otherwise leave it inlined.
    """
    path = f"{root or work_dir(spark, 'views')}/{name}"
    save_view(view, path, time_column)
    return spark.read.parquet(path)


DROPS = StructType([StructField("generation", IntegerType())])


class LiveViews:
    """Streaming views as running queries, each with its own table and checkpoint.

    Dropping a view begins a new generation of both. Drops are written below the root, so
    a new session over the same root does not find dropped rows again.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or work_dir(spark, "live")
        self._queries: dict[str, StreamingQuery] = {}
        self._tables: dict[str, KeyedTable | None] = {}
        self._schemas: dict[str, StructType] = {}
        self._generation: dict[str, int] = {}

    def _folder(self, name: str) -> str:
        if name not in self._generation:
            drops = stored(self.spark, f"{self.root}/{name}/drops", DROPS)
            self._generation[name] = drops.agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0]
        return f"{self.root}/{name}/gen-{self._generation[name]}"

    def start(self, name: str, view: DataFrame, keys: list[str] | None = None,
              available_now: bool = False, day_of: str | None = None,
              state_partitions: int | None = None, compact_every: int = EVERY, feed: bool = False) -> StreamingQuery:
        """Start maintaining a view; returns at once. A running view is left alone.

        With ``keys`` the view changes rows in place (update mode) in a :class:`KeyedTable`, whose
        deltas are folded after ``compact_every`` batches; without it only appends. ``day_of`` names a time among the keys by whose day an update table is
        partitioned. ``state_partitions`` is the width of the view's state, fixed by its
        first start: give it where the cluster may still be small then. ``feed`` keeps the changes
        of a keyed view, see :meth:`changes`.
        """
        running = self._queries.get(name)
        if running is not None and running.isActive:
            return running
        folder = self._folder(name)
        path, checkpoint = f"{folder}/table", f"{folder}/checkpoint"
        table = KeyedTable(self.spark, path, keys, view.schema, day_of, compact_every, feed=feed) if keys else None
        if table and feed:
            table.open_feed()
        if table:
            query = keyed_stream(view, table, checkpoint, available_now, state_partitions)
        else:
            query = append_stream(view, path, checkpoint, available_now, state_partitions)
        self._queries[name], self._tables[name], self._schemas[name] = query, table, view.schema
        return query

    def read(self, name: str, first_day: Column | None = None) -> DataFrame:
        """Rows so far; none before the first batch."""
        table = self._tables[name]
        if table:
            return table.read(first_day)
        return stored(self.spark, self.table_path(name), self._schemas[name])

    def table_path(self, name: str) -> str:
        """Where the rows of a view lie."""
        return f"{self._folder(name)}/table"

    def changes(self, name: str, max_files: int | None = None) -> DataFrame:
        """The change feed of a keyed view that was started with one, as a stream."""
        return self._tables[name].change_feed(max_files)

    def running(self) -> list[str]:
        return [name for name, query in self._queries.items() if query.isActive]

    def wait(self, timeout: float | None = None) -> bool:
        """Wait for bounded queries to finish; true when all did."""
        done = [q.awaitTermination(int(timeout)) if timeout else q.awaitTermination() or True
                for q in self._queries.values()]
        return all(done)

    def stop(self, name: str) -> None:
        """Stop maintaining a view; its rows and its checkpoint stay, a start resumes."""
        if name in self._queries:
            self._queries[name].stop()

    def drop(self, name: str) -> None:
        """Stop a view and forget its rows: the next start begins with an empty table."""
        self.stop(name)
        self._queries.pop(name, None)
        self._tables.pop(name, None)
        self._schemas.pop(name, None)
        self._folder(name)
        self._generation[name] += 1
        dropped = self.spark.createDataFrame([(self._generation[name],)], DROPS)
        dropped.write.mode("append").parquet(f"{self.root}/{name}/drops")

    def ensure(self, wanted: dict[str, tuple[DataFrame, list[str] | None]]) -> list[str]:
        """Start what is not running; returns the started names."""
        started = [name for name in wanted if name not in self.running()]
        for name in started:
            self.start(name, *wanted[name])
        return started
