"""Session helpers."""

from __future__ import annotations

from fleetviews import work_dir
from fleetviews.sources.sinks import started


def test_work_folders_are_new_and_shared(spark):
    one, two = work_dir(spark, "a"), work_dir(spark, "a")
    assert one != two
    parent = spark.conf.get("spark.checkpoint.dir", None)
    assert not parent or one.startswith(parent)


def test_state_width_follows_the_cores_and_is_restored(spark, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rate = spark.readStream.format("rate").load().groupBy("value").count()
    writer = rate.writeStream.format("memory").queryName("width").outputMode("complete")
    query = started(rate, writer, state_partitions=3)
    try:
        query.processAllAvailable()
        states = [s for p in query.recentProgress for s in p["stateOperators"]]
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
        assert states and {s["numShufflePartitions"] for s in states} == {3}
    finally:
        query.stop()
