"""SimHash near-duplicates by exact comparison of fingerprints, tile by tile.

Equal fingerprints are one node. Nodes are sorted by the bit counts of their four 16-bit quarters
and cut into tiles of at most ``TILE``; a tile knows the least and largest count of each quarter.
Two fingerprints at distance d have quarter counts that differ by d or less in sum, so pairs of
tiles further apart than the radius are skipped, and inside a pair of tiles the same test skips
blocks. The others are compared in full with exclusive-or and bit counts in numpy. Each pair of
tiles returns no list of links but a spanning forest of them: at most one link a node. Links join
by contraction (``components.roots``).

The work left is a share of all pairs of distinct fingerprints, so it grows with their square; that
is the method. Without a radius in the way no pair is left out.

Null and empty texts have fingerprint zero and are linked like any other. Texts of fewer words than
a shingle are one shingle. Ids may be null (last) or repeat: rows of their own. An empty table gives
an empty result. Long texts stream through in pieces. Other columns are carried by
``representatives`` unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, components

SHINGLE = 3
RADIUS = 3
SEED = 42
TILE = 4096
BLOCK = 256
PIECE = 1 << 19
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _pieces(data: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes, cut at white space."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + PIECE)
        end = cut.end() if cut else len(data)
        yield data[at:end]
        at = end


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text."""
    digest, total, ones = xxhash.xxh64_intdigest, 0, np.zeros(64, np.int64)
    carried: list[bytes] = []
    for piece in _pieces(data):
        words = carried + piece.lower().split()  # bytes: lower-cases A-Z, splits at the six spaces
        if len(words) >= shingle:
            runs = zip(*(words[i:] for i in range(shingle)))
            codes = np.array([digest(b" ".join(run), SEED) for run in runs], "<u8")
            ones += np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
            total += len(codes)
            carried = words[len(words) - shingle + 1 :]
        else:
            carried = words
    if not total:
        return digest(b" ".join(carried), SEED) if carried else 0
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def _signed(numbers: list[int]) -> pa.Array:
    return pa.array(np.array(numbers, np.uint64).view(np.int64), pa.int64())


def fingerprints(docs: DataFrame, key: str, shingle: int = SHINGLE) -> DataFrame:
    """key, doc_id, print (64 bits as a signed long)."""

    def run(batches):
        for batch in batches:
            prints = [fingerprint(x.as_buffer().to_pybytes(), shingle) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("doc_id"), _signed(prints)], ["key", "doc_id", "print"]
            )

    rows = docs.select(
        F.col(key).alias("key"), F.col("doc_id").cast("long"), common.text_of().cast("binary").alias("text")
    )
    return rows.mapInArrow(run, "key long, doc_id long, print long")


def _quarters(prints: np.ndarray) -> np.ndarray:
    """Bit counts of the four quarters, one row a fingerprint."""
    return np.bitwise_count(np.ascontiguousarray(prints, "<u8").view("<u2").reshape(-1, 4)).astype(np.int16)


def _gap(low_a, high_a, low_b, high_b) -> np.ndarray:
    """The least distance that fingerprints in two boxes of quarter counts can have."""
    return np.maximum(0, np.maximum(low_a - high_b, low_b - high_a)).sum(-1)


def _blocks(prints: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    out = []
    for at in range(0, len(prints), BLOCK):
        part = prints[at : at + BLOCK]
        counts = _quarters(part)
        out.append((at, part, counts.min(0), counts.max(0)))
    return out


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (place, place) that join all fingerprints within the radius, over ``left`` followed by
    ``right``; with ``right`` None, among ``left``."""
    shift = 0 if right is None else len(left)
    n = len(left) + (0 if right is None else len(right))
    label = np.arange(n)
    others = _blocks(left if right is None else right)
    lows, highs = np.array([b[2] for b in others]), np.array([b[3] for b in others])
    for at, part, low, high in _blocks(left):
        near = np.flatnonzero(_gap(low, high, lows, highs) <= radius)
        for place in near if right is not None else near[near * BLOCK >= at]:
            to, other = others[place][:2]
            x, y = np.nonzero(np.bitwise_count(part[:, None] ^ other[None, :]) <= radius)
            x, y = x + at, y + to + shift
            open_ = label[x] != label[y]
            if open_.any():
                _merge(label, label[x[open_]], label[y[open_]])
    nodes = np.flatnonzero(label != np.arange(n))
    return nodes, label[nodes]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Makes the given pairs of labels one, the smallest of each class."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    pairs = np.unique(np.minimum(a, b) * len(label) + np.maximum(a, b))
    for pair in pairs.tolist():
        x, y = top(pair // len(label)), top(pair % len(label))
        if x != y:
            parent[max(x, y)] = min(x, y)
    if parent:
        new = np.arange(len(label))
        for x in parent:
            new[x] = top(x)
        label[:] = new[label]


def _tiles(prints: DataFrame) -> DataFrame:
    """tile, low and high (quarter counts), prints (packed): distinct fingerprints sorted and cut."""

    def run(batches):
        number, rest = TaskContext.get().partitionId() << 32, np.zeros(0, np.uint64)

        def row(part):
            nonlocal number
            counts = _quarters(part)
            number += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([counts.min(0).tolist()], pa.list_(pa.int32())),
                    pa.array([counts.max(0).tolist()], pa.list_(pa.int32())),
                    pa.array([part.astype("<u8").tobytes()], pa.binary()),
                ],
                ["tile", "low", "high", "prints"],
            )

        for batch in batches:
            rest = np.concatenate([rest, batch.column("print").to_numpy().view(np.uint64)])
            while len(rest) >= TILE:
                yield row(rest[:TILE])
                rest = rest[TILE:]
        if len(rest):
            yield row(rest)

    quarter = [F.bit_count(F.shiftrightunsigned("print", 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
    places = [f"quarter_{i}" for i in range(4)]
    marked = prints.select("print", *[q.alias(p) for q, p in zip(quarter, places)])
    width = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = marked.repartitionByRange(width, *places, "print").sortWithinPartitions(*places, "print")
    return ordered.select("print").mapInArrow(run, "tile long, low array<int>, high array<int>, prints binary")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``print`` within the radius."""
    tiles = common.saved(_tiles(prints), "tiles")
    # Tiles meet over the counts of their first quarter; the rest of the box test follows.
    boxes = tiles.select("tile", "low", "high")
    first = boxes.select(
        "*", F.explode(F.sequence(F.col("low")[0], F.col("high")[0] + radius)).alias("count")
    )
    second = boxes.select(
        F.col("tile").alias("tile_2"), F.col("low").alias("low_2"), F.col("high").alias("high_2"),
        F.explode(F.sequence(F.col("low")[0], F.col("high")[0] + radius)).alias("count"),
    )
    gap = sum(
        (
            F.greatest(F.lit(0), F.col("low")[i] - F.col("high_2")[i], F.col("low_2")[i] - F.col("high")[i])
            for i in range(4)
        ),
        F.lit(0),
    )
    pairs = (
        first.join(second, "count").filter((F.col("tile") <= F.col("tile_2")) & (gap <= radius))
        .select("tile", "tile_2").distinct()
    )
    left = tiles.select("tile", F.col("prints").alias("left"))
    right = tiles.select(F.col("tile").alias("tile_2"), F.col("prints").alias("right"))
    width = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    matched = pairs.join(left, "tile").join(right, "tile_2").repartition(width, "tile", "tile_2")

    def run(batches):
        for batch in batches:
            for tile, tile_2, a, b in zip(*(batch.column(c) for c in ("tile", "tile_2", "left", "right"))):
                a = np.frombuffer(a.as_buffer(), "<u8")
                b = None if tile == tile_2 else np.frombuffer(b.as_buffer(), "<u8")
                x, y = forest(a, b, radius)
                both = a if b is None else np.concatenate([a, b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[x].view(np.int64)), pa.array(both[y].view(np.int64))], ["a", "b"]
                )

    return matched.select("tile", "tile_2", "left", "right").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, key: str, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: key, doc_id, print, and key and id of its component's first row."""
    rows = common.saved(fingerprints(docs, key, shingle), "fingerprints")
    first = F.min(F.struct("key", "doc_id"))
    nodes = common.saved(rows.groupBy("print").agg(first.alias("first")), "nodes")
    root = components.roots(links(nodes.select("print"), radius)).withColumnRenamed("node", "print")
    placed = nodes.join(root, "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = placed.groupBy("root").agg(F.min("first").alias("least"))
    named = placed.join(least, "root").select(
        "print", F.col("least.key").alias("component_key"), F.col("least.doc_id").alias("component_id")
    )
    return rows.join(common.saved(named, "components"), "print")


def representatives(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The first row of every component, with all its columns."""
    rows, key = common.keyed(docs)
    dropped = classes(rows, key, shingle, radius).filter("key != component_key").select(F.col("key").alias(key))
    return rows.join(common.saved(dropped, "dropped"), key, "left_anti").select(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, key = common.keyed(common.documents(spark, sf_dir))
    return classes(docs, key).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
