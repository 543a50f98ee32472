"""A catalog of running views that outlives the driver which started them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import work_dir
from ..sources import messages
from ..sources.sinks import stored
from ..streaming.live import change_feed
from .lifecycle import LiveViews
from .viewset import ViewSet

ENTRY = """revision long, name string, maker string, reads array<string>, keys array<string>, options string,
  settings string, wanted boolean"""

# Builds a view's stream: of the session, the streams of the views it reads, and the entry's options.
Maker = Callable[..., DataFrame]


def named_view(spark: SparkSession, path: str, view: str, **reading) -> DataFrame:
    """One of the named views over a folder of messages."""
    frame = messages.stream_messages(spark, path, **reading)
    return ViewSet(*[messages.typed_source(frame, s) for s in messages.STREAMS])[view]


class LiveCatalog:
    """Which views are to run, how each is made and what it reads, as a table below ``root``.

    An entry names its maker, one of ``makers``, so the table holds no code; a new driver passes the same
    makers and calls :meth:`ensure`. Every creation and drop is one write of new entries, and the newest
    entry of a name counts. Rows and checkpoint of a view lie in a folder of its entry's revision: a view
    that is dropped and created again starts empty, also if the driver was lost in between. One driver at a
    time may use a catalog.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, makers: dict[str, Maker] | None = None):
        self.spark = spark
        self.root = root or work_dir(spark, "catalog")
        self.makers: dict[str, Maker] = {"named_view": named_view, **(makers or {})}
        self.live = LiveViews(spark, f"{self.root}/views")

    # --- entries ---

    def _log(self) -> DataFrame:
        return stored(self.spark, f"{self.root}/entries", self.spark.createDataFrame([], ENTRY).schema)

    def entries(self) -> DataFrame:
        """The newest entry of every name there ever was."""
        log = self._log()
        rest = [c for c in log.columns if c != "name"]
        newest = log.groupBy("name").agg(F.max_by(F.struct(*rest), "revision").alias("_newest"))
        return newest.select("name", "_newest.*")

    def _wanted(self) -> dict[str, Row]:
        """Entries of the views that are to run, each after those it reads.

        A view is created after what it reads, which stays while it is read: revisions are an order.
        """
        return {r["name"]: r for r in self.entries().where("wanted").orderBy("revision").collect()}

    def _record(self, rows: Iterable[dict]) -> None:
        log = self._log()
        last = log.agg(F.coalesce(F.max("revision"), F.lit(0))).first()[0]
        numbered = [tuple({**row, "revision": last + i}[c] for c in log.columns) for i, row in enumerate(rows, 1)]
        self.spark.createDataFrame(numbered, ENTRY).coalesce(1).write.mode("append").parquet(f"{self.root}/entries")

    def create(self, name: str, maker: str, reads: Iterable[str] = (), keys: list[str] | None = None,
               options: dict | None = None, if_missing: bool = False, available_now: bool = False, **settings) -> bool:
        """Record a view and start it; returns whether it is new.

        ``maker`` is called with the session, the streams of the views in ``reads`` and ``options``, which
        must be plain values. ``keys`` and ``settings`` are those of :meth:`LiveViews.start`; all of it is
        recorded. A keyed view can be read by others if it keeps its changes (``feed=True``); they get those.
        A name in use is an error, or left as it is with ``if_missing``.
        """
        wanted, reads = self._wanted(), list(reads)
        if name in wanted:
            if if_missing:
                return False
            raise ValueError(f"view {name!r} exists; drop it first")
        if maker not in self.makers:
            raise KeyError(f"no maker named {maker!r}")
        for read in reads:
            if read not in wanted:
                raise KeyError(f"no view named {read!r}")
            if wanted[read]["keys"] and not json.loads(wanted[read]["settings"]).get("feed"):
                raise ValueError(f"{read!r} changes rows in place; create it with feed=True to read its changes")
        self._record([{
            "name": name, "maker": maker, "reads": reads, "keys": keys, "wanted": True,
            "options": json.dumps(options or {}), "settings": json.dumps(settings),
        }])
        self.ensure(available_now)
        return True

    @staticmethod
    def _dependents(name: str, wanted: dict[str, Row]) -> list[str]:
        found: list[str] = []
        for view, entry in wanted.items():
            if any(read == name or read in found for read in entry["reads"]):
                found.append(view)
        return found[::-1]

    def dependents(self, name: str) -> list[str]:
        """Views that read ``name`` directly or through others, deepest first."""
        return self._dependents(name, self._wanted())

    def drop(self, name: str, cascade: bool = False) -> list[str]:
        """Take a view back; returns what was dropped, dependents first. A missing one is fine.

        The drop of all of them is recorded by one write, before any is stopped.
        """
        wanted = self._wanted()
        if name not in wanted:
            return []
        dependents = self._dependents(name, wanted)
        if dependents and not cascade:
            raise ValueError(f"{name!r} is read by {', '.join(dependents)}")
        dropped = [*dependents, name]
        self._record([{**wanted[view].asDict(), "wanted": False} for view in dropped])
        for view in dropped:
            self.live.stop(self._folder(wanted[view]))
        return dropped

    # --- running ---

    @staticmethod
    def _folder(entry: Row) -> str:
        return f"{entry['name']}/rev-{entry['revision']}"

    def _stream(self, entry: Row) -> DataFrame:
        """What dependents of a running view read: its new rows, or its changes."""
        folder = self._folder(entry)
        if entry["keys"]:
            return self.live.changes(folder)
        return change_feed(self.spark, self.live.table_path(folder), self.live.read(folder).schema)

    def _start(self, entry: Row, wanted: dict[str, Row], available_now: bool) -> StreamingQuery:
        sources = [self._stream(wanted[read]) for read in entry["reads"]]
        view = self.makers[entry["maker"]](self.spark, *sources, **json.loads(entry["options"]))
        settings = json.loads(entry["settings"])
        return self.live.start(self._folder(entry), view, entry["keys"], available_now, **settings)

    def ensure(self, available_now: bool = False) -> list[str]:
        """Start what is recorded and not running, each view after those it reads; returns their names.

        All that is needed lies in the catalog, so this restores a lost driver's views, which go on from
        their checkpoints, as well as single ones that failed. With ``available_now`` each runs to
        the end of its input before the next starts.
        """
        wanted, running, begun = self._wanted(), set(self.live.running()), []
        for name, entry in wanted.items():
            if self._folder(entry) in running:
                continue
            query = self._start(entry, wanted, available_now)
            if available_now:
                query.awaitTermination()
            begun.append(name)
        return begun

    def read(self, name: str) -> DataFrame:
        """Rows so far of a view that :meth:`ensure` or :meth:`create` has started."""
        wanted = self._wanted()
        if name not in wanted:
            raise KeyError(f"no view named {name!r}")
        return self.live.read(self._folder(wanted[name]))

    def status(self) -> DataFrame:
        """name, revision, reads, wanted, running: one row for every name there ever was."""
        folder = F.concat("name", F.lit("/rev-"), F.col("revision").cast("string"))
        running = folder.isin(self.live.running())
        return self.entries().select("name", "revision", "reads", "wanted", running.alias("running"))

    def stop(self) -> None:
        """Stop all views, dependents first, without taking any back."""
        for entry in reversed(self._wanted().values()):
            self.live.stop(self._folder(entry))
