"""Message streams whose batches are the parts that were given."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import streams
from suite.base import Fleet


def test_a_part_is_a_batch_however_many_files_it_has(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "BATCH_FILE_ROWS", 50)
    rows = spark.range(0, 600, numPartitions=6).selectExpr(
        "id AS event_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts",
        "id AS user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props",
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")
    fleet, seen = Fleet(spark, str(tmp_path)), {}
    parts = [fleet.table.messages().where(F.col("seq") % 3 == i) for i in range(3)]
    coming = streams._in_batches(fleet, "parts", parts)
    seconds = F.unix_micros("ts") * 60 / 1_000_000

    def on_batch(batch, number):
        seen[number] = sorted(r[0] for r in batch.select(F.round(seconds).cast("long") % 3).distinct().collect()), batch.count()

    writer = coming.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{tmp_path}/c")
    writer.trigger(availableNow=True).start().awaitTermination()
    assert seen == {i: ([i], 200) for i in range(3)}
