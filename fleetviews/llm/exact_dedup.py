"""Exact duplicates by composable polynomial fingerprints, confirmed chunk by chunk.

A text without white space is a polynomial in its bytes. Chunks are hashed by themselves and
combined by shifting: hash(xy) = hash(x) + base ** len(x) * hash(y). So a huge text needs one
chunk of memory. Texts with equal fingerprints are then compared chunk by chunk: over all
members of a group, the smallest and the largest content of each chunk must agree. That is an
aggregation with map-side combining, so a group may hold any share of the rows. A group that
disagrees (a collision) is divided by SHA-256.

Null and empty texts are equal to each other. Null ids come last among smallest ids. Rows that
repeat an id are rows of their own; of rows equal in everything one stays. An empty table gives
an empty result. Other columns are carried by ``deduplicated`` whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

#: Two primes below 2 ** 31 and a base for each.
FIELDS = ((2_147_483_647, 911_382_323), (2_147_483_629, 972_663_749))
CHUNK = 1 << 16
#: Bits of the membership bitmap that saves shipping texts without an equal.
BITS = 1 << 24
SPACE_BYTES = common.SPACES.encode()


def _powers(prime: int, base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n]


class Fingerprinter:
    """Fingerprints of byte strings in the given fields."""

    def __init__(self, fields=FIELDS, chunk: int = CHUNK):
        self.fields, self.chunk = fields, chunk
        self.powers = [_powers(p, b, chunk) for p, b in fields]

    def of_chunk(self, data: bytes) -> tuple[int, ...]:
        values = np.frombuffer(data, np.uint8).astype(np.uint64)
        return tuple(
            int(values @ power[: len(values)]) % prime for (prime, _), power in zip(self.fields, self.powers)
        )

    def combined(self, left: tuple[int, ...], length: int, right: tuple[int, ...]) -> tuple[int, ...]:
        """The fingerprint of a text of ``length`` bytes followed by another."""
        return tuple((x + pow(b, length, p) * y) % p for (p, b), x, y in zip(self.fields, left, right))

    def chunks(self, data: bytes) -> Iterator[bytes]:
        for at in range(0, max(len(data), 1), self.chunk):
            yield data[at : at + self.chunk]

    def of(self, data: bytes) -> int:
        """Both fields in one 62-bit number."""
        total, length = (0,) * len(self.fields), 0
        for piece in self.chunks(data):
            total, length = self.combined(total, length, self.of_chunk(piece)), length + len(piece)
        number = 0
        for value in total:
            number = number << 31 | value
        return number


def _bare(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield value.as_buffer().to_pybytes().translate(None, SPACE_BYTES)


def _prints(docs: DataFrame, key: str, fields, chunk: int) -> DataFrame:
    def run(batches):
        printer = Fingerprinter(fields, chunk)
        for batch in batches:
            texts = batch.column("text")
            bare = list(_bare(texts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    batch.column("doc_id"),
                    pa.array([printer.of(x) for x in bare], pa.int64()),
                    pa.array([len(x) for x in bare], pa.int64()),
                    pc.utf8_length(texts).cast(pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in bare], pa.string()),
                ],
                ["key", "doc_id", "print", "n_bytes", "n_points", "text_sha256"],
            )

    columns = docs.select(F.col(key).alias("key"), F.col("doc_id").cast("long"), common.text_of().alias("text"))
    return columns.mapInArrow(
        run, "key long, doc_id long, print long, n_bytes long, n_points long, text_sha256 string"
    )


def _collisions(docs: DataFrame, shared: DataFrame, fields, chunk: int) -> DataFrame:
    """Of the fingerprints that several texts share, those whose texts differ in some chunk."""
    maybe = common.bitmap(shared, "print", BITS)
    found = docs.sparkSession.sparkContext.broadcast(maybe)

    def run(batches):
        printer = Fingerprinter(fields, chunk)
        for batch in batches:
            for bare in _bare(batch.column("text")):
                number = printer.of(bare)
                if common.in_bitmap(found.value, BITS, np.array([number], np.uint64))[0]:
                    pieces = list(printer.chunks(bare))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([number] * len(pieces), pa.int64()),
                            pa.array([len(bare)] * len(pieces), pa.int64()),
                            pa.array(range(len(pieces)), pa.int64()),
                            pa.array(pieces, pa.binary()),
                        ],
                        ["print", "n_bytes", "place", "chunk"],
                    )

    chunks = docs.select(common.text_of().alias("text")).mapInArrow(
        run, "print long, n_bytes long, place long, chunk binary"
    )
    return (
        chunks.groupBy("print", "n_bytes", "place")
        .agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
        .filter(F.col("low") != F.col("high"))
        .select("print", "n_bytes")
        .distinct()
    )


def decisions(docs: DataFrame, key: str, fields=FIELDS, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: key, doc_id, group, size, the row that stays, fingerprint and digest."""
    prints = common.saved(_prints(docs, key, fields, chunk), "prints")
    group = ["print", "n_bytes"]
    shared = prints.groupBy(*group).count().filter("count > 1")
    mixed = common.saved(_collisions(docs, shared, fields, chunk), "collisions")
    mixed = mixed.withColumn("mixed", F.lit(True))
    parted = prints.join(mixed, group, "left").withColumn(
        "part", F.when(F.col("mixed"), F.col("text_sha256")).otherwise("")
    ).drop("mixed")
    # The most code points first, then the smallest id; the key sorts like the id.
    order = F.struct((-F.col("n_points")).alias("less"), F.col("key"), F.col("doc_id"))
    groups = parted.groupBy(*group, "part").agg(F.count("*").alias("group_size"), F.min(order).alias("best"))
    groups = groups.select(
        *group, "part", "group_size", F.col("best.key").alias("keep_key"), F.col("best.doc_id").alias("keep_id")
    )
    return parted.join(groups, [*group, "part"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows, key = common.keyed(docs)
    dropped = decisions(rows, key).filter("key != keep_key").select(F.col("key").alias(key))
    return rows.join(common.saved(dropped, "dropped"), key, "left_anti").select(*docs.columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, key = common.keyed(common.documents(spark, sf_dir))
    return decisions(docs, key).select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        (F.col("key") == F.col("keep_key")).alias("kept"), "text_sha256",
    )


OP1_SQL = r"""
WITH bare AS (
  SELECT doc_id, coalesce(text, '') AS full_text,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare_text FROM documents),
ranked AS (
  SELECT doc_id, bare_text,
    first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare_text) AS group_size
  FROM bare WINDOW w AS (PARTITION BY bare_text ORDER BY length(full_text) DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare_text) AS text_sha256 FROM ranked
"""
