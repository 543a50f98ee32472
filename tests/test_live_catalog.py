"""The catalog of running views: order, refusals, and what a killed driver leaves behind."""

from __future__ import annotations

import json
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from fleetviews.plans.live_catalog import LiveCatalog
from fleetviews.session import work_dir

ROWS = "k string, v long"
MAKERS = {
    "rows": lambda spark, path: spark.readStream.schema(ROWS).json(path),
    "above": lambda spark, rows, least: rows.where(F.col("v") > least),
    "sums": lambda spark, rows: rows.groupBy("k").agg(F.sum("v").alias("total")),
    "kinds": lambda spark, changes: changes.select("k", "kind"),
}

# A driver that is killed while its views run.
DRIVER = """
    import os, sys
    sys.path[:0] = [{repo!r}]
    from fleetviews.plans.live_catalog import LiveCatalog
    from fleetviews.session import build_session
    from tests.test_live_catalog import MAKERS, views_on_views
    spark = build_session(master="local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false")
    catalog = LiveCatalog(spark, {root!r}, MAKERS)
    views_on_views(catalog, {path!r}, state_partitions=2)
    while catalog.read("sums").count() < 2:
        pass
    os._exit(9)
"""


def views_on_views(catalog, path, **settings):
    catalog.create("rows", "rows", options={"path": path})
    catalog.create("above", "above", ["rows"], options={"least": 1})
    catalog.create("sums", "sums", ["above"], ["k"], feed=True, **settings)
    catalog.create("kinds", "kinds", ["sums"])


def drained(catalog):
    """Everything that arrived has gone through all views, one after another."""
    for query in catalog.live._queries.values():
        if query.isActive:
            query.processAllAvailable()


def folder(spark, rows):
    path = work_dir(spark, "rows")
    arrive(spark, path, rows)
    return path


def arrive(spark, path, rows):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").json(path)


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_a_killed_driver_is_replaced_from_the_catalog_alone(spark):
    path, root = folder(spark, [("a", 1), ("a", 2), ("b", 3)]), work_dir(spark, "catalog")
    repo = __file__.rsplit("/tests/", 1)[0]
    script = textwrap.dedent(DRIVER.format(repo=repo, root=root, path=path))
    done = subprocess.run([sys.executable, "-c", script], timeout=240, capture_output=True, text=True)
    assert done.returncode == 9, done.stderr[-2000:]
    catalog = LiveCatalog(spark, root, MAKERS)
    assert pairs(catalog.status().select("name", "wanted", "running")) == [
        (name, True, False) for name in ("above", "kinds", "rows", "sums")]
    try:
        assert catalog.ensure() == ["rows", "above", "sums", "kinds"]
        assert catalog.ensure() == []
        arrive(spark, path, [("a", 5), ("c", 7), ("c", 0)])
        drained(catalog)
        assert pairs(catalog.read("sums")) == [("a", 7), ("b", 3), ("c", 7)]
        assert pairs(catalog.read("kinds")) == [("a", "insert"), ("a", "update"), ("b", "insert"), ("c", "insert")]
        # One that stopped on its own is started again, with what reads it left running.
        catalog.live.stop(catalog._folder(catalog._wanted()["above"]))
        assert catalog.ensure() == ["above"]
        arrive(spark, path, [("d", 9)])
        drained(catalog)
        assert pairs(catalog.read("sums"))[-1] == ("d", 9)
    finally:
        catalog.stop()
    assert catalog.live.running() == []


def test_creating_and_dropping(spark):
    path = folder(spark, [("a", 1), ("b", 2)])
    catalog = LiveCatalog(spark, makers=MAKERS)
    assert catalog.ensure() == [] and catalog.status().isEmpty() and catalog.drop("rows") == []
    run = {"available_now": True}
    assert catalog.create("rows", "rows", options={"path": path}, **run)
    assert not catalog.create("rows", "rows", options={"path": path}, if_missing=True, **run)
    assert catalog.create("sums", "sums", ["rows"], ["k"], **run)
    assert catalog.create("above", "above", ["rows"], options={"least": 1}, **run)
    assert catalog.create("high", "above", ["above"], options={"least": 5}, **run)
    before = pairs(catalog.entries().select("name", "revision", "wanted"))
    for error, arguments in [
        (ValueError, ("rows", "rows")), (KeyError, ("x", "nobody")), (KeyError, ("x", "above", ["nowhere"])),
        (ValueError, ("x", "kinds", ["sums"])),
    ]:
        with pytest.raises(error):
            catalog.create(*arguments)
    with pytest.raises(ValueError):
        catalog.drop("rows")
    with pytest.raises(KeyError):
        catalog.read("x")
    # Refused calls leave no entry.
    assert pairs(catalog.entries().select("name", "revision", "wanted")) == before
    assert catalog.dependents("rows") == ["high", "above", "sums"]
    assert catalog.drop("above", cascade=True) == ["high", "above"]
    assert catalog.ensure(**run) == ["rows", "sums"]
    # Created anew, a view starts with all that its source holds, and with other options.
    assert catalog.create("above", "above", ["rows"], options={"least": 0}, **run)
    assert pairs(catalog.read("above")) == [("a", 1), ("b", 2)]
    entry = catalog.entries().where("name = 'above'").first()
    assert (entry["revision"], json.loads(entry["options"]), entry["reads"]) == (7, {"least": 0}, ["rows"])
    assert pairs(catalog.status().where("wanted").select("name")) == [("above",), ("rows",), ("sums",)]
