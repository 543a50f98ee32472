"""Keyed tables that live long: small batches of changed rows, folded into a base from time to time.

A batch writes its changed rows as a delta under its number. Every so many batches the deltas of
finished batches are folded into the base: only the days they touch are written again, each into
another slot than the one it is read from. Then one row, the manifest, names the base's slots and the
last batch they hold, and that row is what readers start from: base plus the deltas behind it. A
reader therefore sees one state, whatever is being written. Deltas, base days and manifests lie in
rings of folders, whose oldest content is overwritten when no manifest of the last two needs it; so
the number of files depends on the days and on ``every``, not on how long the table has been written.

One stream writes a table. A batch that is run again replaces its delta; one that the base already
holds changes nothing.

A row can also be taken back: a batch writes its key with ``gone`` set. Readers do not see it, and the next
fold forgets it. With a feed, every batch also writes what it changed, as images before and after, in a
folder that only grows: a stream over it is a change feed, and that stream's checkpoint the position in it.
"""

from __future__ import annotations

from datetime import date
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from .sinks import BATCH, DAY, batch_schema, started

#: Batches between two folds.
EVERY = 32
#: Generations of a manifest or of a base day.
RING = 3
MANIFEST = "version long, through long, parts array<struct<day: date, slot: int>>"


class Manifest(NamedTuple):
    version: int = -1
    through: int = -1
    parts: tuple[tuple[date | None, int], ...] = ()


class KeyedTable:
    """Rows by key, each as the last batch that changed it wrote it.

    ``rows`` is their schema. With ``day_of``, a time among the keys, the table is partitioned by its day.
    ``gone`` names a boolean among the rows that takes a key back.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], rows: T.StructType,
                 day_of: str | None = None, every: int = EVERY, gone: str | None = None, feed: bool = False):
        self.spark, self.path, self.keys, self.rows = spark, path, keys, rows
        self.day_of, self.every, self.gone, self.feed = day_of, every, gone, feed
        self._last: Manifest | None = None

    def _stored(self, folder: str, schema: T.StructType | str) -> DataFrame | None:
        # What vanishes while it is read was overwritten, and is too old to matter.
        reader = self.spark.read.schema(schema).option("ignoreMissingFiles", "true")
        try:
            return reader.parquet(f"{self.path}/{folder}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def manifest(self) -> Manifest:
        """The newest one; an empty one before the first fold."""
        rows = self._stored("manifest", MANIFEST)
        newest = rows.orderBy(F.col("version").desc()).first() if rows is not None else None
        if newest is None:
            return Manifest()
        return Manifest(newest["version"], newest["through"], tuple(map(tuple, newest["parts"])))

    def exists(self) -> bool:
        return any(self._stored(folder, "version long") is not None for folder in ("manifest", "delta"))

    def create(self) -> None:
        """The table without rows, unless it exists."""
        if not self.exists():
            self._publish(Manifest(0, -1, ()))

    # --- writing ---

    def write(self, changed: DataFrame, batch_id: int) -> None:
        """The changed rows of a batch."""
        if self._last is None:
            self._last = self.manifest()
        if batch_id <= self._last.through:
            return
        rows = changed.withColumn(BATCH, F.lit(batch_id).cast("long"))
        if self.day_of:
            rows = rows.withColumn(DAY, F.to_date(self.day_of))
        slot = batch_id % (RING * (self.every + 2))
        if self.feed:
            rows = rows.persist()
            self._changes(changed if not self.day_of else rows, batch_id).write.mode("overwrite").parquet(
                f"{self.path}/changes/{BATCH}={batch_id}")
        rows.write.mode("overwrite").partitionBy(*[DAY] * bool(self.day_of)).parquet(f"{self.path}/delta/slot={slot}")
        if self.feed:
            rows.unpersist()
        # The batch itself may be run again, those before it never are.
        if batch_id - 1 - self._last.through >= self.every:
            self.fold(batch_id - 1)

    def fold(self, through: int) -> None:
        """Deltas up to a batch go into the base, by a new manifest at the end."""
        old = self.manifest()
        behind = self._deltas(old).where(F.col(BATCH) <= through)
        days = [r[0] for r in behind.select(DAY).distinct().collect()] if self.day_of else [None]
        slots = dict(old.parts)
        for slot in range(RING):
            # A day moves to the slot after the one it is read from.
            moved = [d for d in days if (slots.get(d, -1) + 1) % RING == slot]
            if not moved:
                continue
            parts = tuple((d, slots[d]) for d in moved if d in slots)
            rows = behind.where(self._on(moved)) if self.day_of else behind
            whole = self._standing(self._folded(self._base(parts).unionByName(rows))).withColumn("slot", F.lit(slot))
            names = [DAY, "slot"] if self.day_of else ["slot"]
            (
                whole.hint("rebalance", *names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy(*names).parquet(f"{self.path}/base")
            )
        slots |= {d: (slots.get(d, -1) + 1) % RING for d in days}
        self._publish(Manifest(old.version + 1, through, tuple(slots.items())))

    @staticmethod
    def _on(days: list[date | None]) -> Column:
        """Whether a row is of one of the days; rows without a time are a day of their own."""
        found = F.coalesce(F.col(DAY).isin([d for d in days if d is not None]), F.lit(False))
        return found | F.col(DAY).isNull() if None in days else found

    def _publish(self, new: Manifest) -> None:
        row = self.spark.createDataFrame([(new.version, new.through, list(new.parts))], MANIFEST)
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/slot={new.version % RING}")
        self._last = new

    # --- reading ---

    def _schema(self) -> T.StructType:
        return batch_schema(self.rows, self.day_of)

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], self._schema())

    def _deltas(self, state: Manifest) -> DataFrame:
        rows = self._stored("delta", self._schema())
        if rows is None:
            return self._none()
        return rows.select(*self._schema().fieldNames()).where(F.col(BATCH) > state.through)

    def _base(self, parts: tuple) -> DataFrame:
        if not parts:
            return self._none()
        base = f"{self.path}/base"
        day = {d: f"/{DAY}={d if d is not None else '__HIVE_DEFAULT_PARTITION__'}" if self.day_of else "" for d, _ in parts}
        paths = [f"{base}{day[d]}/slot={slot}" for d, slot in parts]
        rows = self.spark.read.schema(self._schema()).option("basePath", base).parquet(*paths)
        return rows.select(*self._schema().fieldNames())

    def _folded(self, rows: DataFrame) -> DataFrame:
        """Each key's row from the last batch that changed it, with that batch."""
        days = [DAY] if self.day_of else []
        rest = [c for c in self.rows.names if c not in self.keys]
        last = rows.groupBy(*self.keys, *days).agg(F.max(F.struct(BATCH, *rest)).alias("_last"))
        return last.select(*self.keys, *[F.col(f"_last.{c}").alias(c) for c in rest], *days, F.col(f"_last.{BATCH}").alias(BATCH))

    def _standing(self, rows: DataFrame) -> DataFrame:
        return rows.where(~F.coalesce(F.col(self.gone), F.lit(False))) if self.gone else rows

    def read(self, first_day: Column | None = None, before: int | None = None) -> DataFrame:
        """The state now; ``first_day`` bounds which days are read at all. ``before`` leaves out what a batch
        and later ones wrote; for the writer, whose base never holds the batch it is at."""
        state = self.manifest()
        deltas = self._deltas(state)
        if before is not None:
            deltas = deltas.where(F.col(BATCH) < before)
        rows = self._base(state.parts).unionByName(deltas)
        if first_day is not None:
            rows = rows.where(F.col(DAY) >= first_day)
        return self._standing(self._folded(rows)).select(*self.rows.names)

    # --- change feed ---

    def _images(self) -> list[str]:
        return [c for c in self.rows.names if c not in self.keys and c != self.gone]

    def _changes(self, changed: DataFrame, batch_id: int) -> DataFrame:
        """What a batch changes: keys, ``kind`` (insert, update, retract) and the images on both sides."""
        image = F.struct(*self._images())
        first = changed.agg(F.min(DAY)).scalar() if self.day_of else None
        old = self.read(first, batch_id).select(
            *[F.col(k).alias(f"_{k}") for k in self.keys], image.alias("before"), F.lit(True).alias("_known"))
        gone = F.coalesce(F.col(self.gone), F.lit(False)) if self.gone else F.lit(False)
        new = changed.select(*self.keys, F.when(~gone, image).alias("after"))
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys])
        both = new.join(old, same, "left")
        kind = (
            F.when(F.col("after").isNull(), F.when(F.col("_known"), "retract"))
            .when(F.col("_known").isNull(), "insert")
            .when(~F.col("after").eqNullSafe(F.col("before")), "update")
        )
        return both.select(*self.keys, kind.alias("kind"), "before", "after").where("kind IS NOT NULL")

    def changes_schema(self) -> T.StructType:
        image = T.StructType([self.rows[c] for c in self._images()])
        return T.StructType([
            *[self.rows[k] for k in self.keys], T.StructField("kind", T.StringType()),
            T.StructField("before", image), T.StructField("after", image), T.StructField(BATCH, T.LongType()),
        ])

    def change_feed(self, max_files: int | None = None) -> DataFrame:
        """The changes as a stream, each once; a consumer's checkpoint remembers how far it got.

        The feed's folder must be there: :meth:`open_feed` makes it before the first batch.
        """
        reader = self.spark.readStream.schema(self.changes_schema())
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return reader.parquet(f"{self.path}/changes")

    def open_feed(self) -> None:
        fields = [f for f in self.changes_schema().fields if f.name != BATCH]
        self.spark.createDataFrame([], T.StructType(fields)).write.mode("ignore").parquet(f"{self.path}/changes/{BATCH}=-1")


def keyed_stream(view: DataFrame, table: KeyedTable, checkpoint: str, available_now: bool = False,
                 state_partitions: int | None = None) -> StreamingQuery:
    """Changed rows of an aggregate view after each batch, into its table."""
    writer = view.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(table.write)
    return started(view, writer, available_now, state_partitions)
