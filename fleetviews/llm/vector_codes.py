"""Product codes of vectors in whole numbers, with pivots that spare most distances (LAESA).

A component x becomes floor(4096 x); vectors are cut into 8 equal consecutive parts, and each part
position has a codebook. The distances from every part to a few fixed pivots of its position are
computed once and written beside the vectors. In a round, the distances from pivots to entries give
each (part, entry) a lower bound, the largest difference of two distances to one pivot. Entries are
tried by rising bound, and a part is done when the next bound exceeds its best distance; distances
are exact, ties go to the lower index. A task sends the sums of its parts by entry, so that what is
shuffled and what reaches the driver (one codebook) depends on neither rows nor copies.

Vectors that are null or hold null or non-finite components are left out. The first codebook comes
from the 16 smallest ids; equal ids are told apart by vector and label, a null id comes last, and
of fewer vectors each is an entry. Shorter vectors are filled with zeros up to the longest one, its
length rounded up to a multiple of 8; an empty vector has parts without components. Rows that
repeat are rows of their own, an empty table gives an empty result and other columns do not matter.
Where scaled components are too large for 64-bit distances, Python integers take over, up to
components of 2^80 in size; larger ones are refused. An error beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

SCALE, PARTS, ENTRIES, ROUNDS, PIVOTS = 4096, 8, 16, 6, 4
#: Rows that are compared at a time.
BLOCK = 4096
#: Pieces that the rows of one label are dealt to when they meet their sum.
SALTS = 16
LARGEST = 2.0**80
LONG = 2**63
#: What rounding may add to a bound, as a share of the two distances.
SLACK = 1e-9


class Shape(NamedTuple):
    """Components of a part, and whether 64 bits hold every distance."""

    width: int
    small: bool

    @property
    def kind(self):
        return np.int64 if self.small else object


def usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    return F.coalesce(vector.isNotNull() & whole, F.lit(False))


def parts_of(vectors: pa.ListArray, shape: Shape) -> np.ndarray:
    """Scaled components as whole numbers: rows x parts x components."""
    length = shape.width * PARTS
    sizes = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.zeros((len(vectors), length))
    whole[np.arange(length) < sizes[:, None]] = values
    whole = np.floor(whole * SCALE)
    if shape.small:
        numbers = whole.astype(np.int64)
    else:
        numbers = np.array([int(x) for x in whole.ravel()], object)
    return numbers.reshape(len(vectors), PARTS, shape.width)


def squared(difference: np.ndarray) -> np.ndarray:
    return (difference * difference).sum(axis=-1)


def spread(entries: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Pivots of one part position: entries far from each other, the first one first."""
    chosen = [0]
    near = squared(entries - entries[0])
    while len(chosen) < min(count, len(entries)):
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, squared(entries - entries[chosen[-1]]))
    return entries[chosen]


def distances(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Rounded distances between rows of two arrays."""
    return np.sqrt(np.stack([squared(some - x) for x in others], axis=-1).astype(np.float64))


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, between: np.ndarray):
    """Of every part the nearest entry, its exact squared distance, and the distances computed.

    ``to_pivots`` are distances from parts to pivots, ``between`` those from entries to pivots.
    """
    a, b = to_pivots[:, None, :], between[None, :, :]
    bound = (np.abs(a - b) - SLACK * (a + b)).max(axis=-1).clip(0)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, 1) ** 2
    index = order[:, 0].copy()
    best = squared(parts - entries[index])
    evaluated = np.ones(len(parts), np.int64)
    open_ = np.arange(len(parts))
    for rank in range(1, len(entries)):
        open_ = open_[bound[open_, rank] <= best[open_].astype(np.float64)]
        if not len(open_):
            break
        entry = order[open_, rank]
        found = squared(parts[open_] - entries[entry])
        evaluated[open_] += 1
        better = (found < best[open_]) | ((found == best[open_]) & (entry < index[open_]))
        best[open_[better]], index[open_[better]] = found[better], entry[better]
    return index, best, evaluated


def _blocks(batches: Iterator[pa.RecordBatch], shape: Shape):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, parts_of(part.column("vector"), shape)


def with_pivots(kept: DataFrame, shape: Shape, pivots: list[np.ndarray]) -> DataFrame:
    """``kept`` (vec_id, label, vector) with ``to_pivots``: distances by part, then pivot."""

    def run(batches):
        for batch, numbers in _blocks(batches, shape):
            found = np.concatenate([distances(numbers[:, p], x) for p, x in enumerate(pivots)], axis=1)
            ends = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
            lists = pa.ListArray.from_arrays(ends, pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "to_pivots"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{kinds}, to_pivots array<double>")


def _assigned(batches, shape: Shape, pivots, codebooks):
    """Blocks of rows with index, distance and evaluations, each rows x parts."""
    between = [distances(c, p) for c, p in zip(codebooks, pivots)]
    for batch, numbers in _blocks(batches, shape):
        flat = batch.column("to_pivots").flatten().to_numpy()
        far = flat.reshape(batch.num_rows, PARTS, -1)
        each = [nearest(numbers[:, p], far[:, p], codebooks[p], between[p]) for p in range(PARTS)]
        yield batch, numbers, *(np.stack(x, axis=1) for x in zip(*each))


def sums(table: DataFrame, shape: Shape, pivots, codebooks) -> DataFrame:
    """part, entry, place, n and total: the parts that each entry is nearest to, summed."""
    count = len(codebooks[0])

    def run(batches):
        n = np.zeros((PARTS, count), np.int64)
        total = np.zeros((PARTS, count, shape.width), object)
        for _, numbers, index, _, _ in _assigned(batches, shape, pivots, codebooks):
            block = np.zeros_like(total, dtype=shape.kind)
            for p in range(PARTS):
                np.add.at(block[p], index[:, p], numbers[:, p])
                n[p] += np.bincount(index[:, p], minlength=count)
            total += block
        part, entry, place = (x.ravel() for x in np.indices(total.shape))
        seen = n[part, entry] > 0
        part, entry, place = part[seen], entry[seen], place[seen]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()),
                pa.array(n[part, entry]),
                pa.array([Decimal(int(x)) for x in total[part, entry, place]], pa.decimal128(38, 0)),
            ],
            ["part", "entry", "place", "n", "total"],
        )

    rows = table.select("vector", "to_pivots").mapInArrow(
        run, "part int, entry int, place int, n long, total decimal(38, 0)"
    )
    return rows.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def coded(table: DataFrame, shape: Shape, pivots, codebooks) -> DataFrame:
    """vec_id, label, code, error (exact; null beyond 64 bits) and evaluations of every vector."""

    def run(batches):
        for batch, _, index, error, evaluated in _assigned(batches, shape, pivots, codebooks):
            totals = [t if t < LONG else None for t in map(int, error.astype(object).sum(axis=1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), batch.column("label"),
                    pa.array([bytes(row).hex() for row in index.astype(np.uint8)], pa.string()),
                    pa.array(totals, pa.int64()), pa.array(evaluated.sum(axis=1)),
                ],
                ["vec_id", "label", "code", "error", "evaluations"],
            )

    kinds = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    return table.mapInArrow(run, f"{kinds}, code string, error long, evaluations long")


def compressed(vectors: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of ``vectors`` (vec_id, embedding, label) and the codebook of each part."""
    kept = vectors.select("vec_id", "label", F.col("embedding").alias("vector")).where(usable(F.col("vector")))
    largest = F.max(F.array_max(F.transform("vector", lambda x: F.abs(x).cast("double"))))
    length, size = kept.agg(F.max(F.size("vector")), largest).first()
    if length is None:
        empty = kept.select(
            "vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
            F.lit(0).cast("long").alias("evaluations"),
        )
        return empty, []
    size = (size or 0.0) * SCALE
    if size > LARGEST:
        raise ValueError(f"a component of {size / SCALE} is beyond the range of codes")
    width = -(-length // PARTS)
    shape = Shape(width, (2 * size + 2) ** 2 * max(width, 1) * PARTS < LONG and size < 2**40)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector", "label").limit(ENTRIES).select("vector")
    start = parts_of(pa.array([r.vector for r in first.collect()], pa.list_(pa.float64())), shape)
    codebooks = [start[:, p].copy() for p in range(PARTS)]
    pivots = [spread(c) for c in codebooks]
    table = common.saved(with_pivots(kept, shape, pivots), "part-pivots")
    for _ in range(ROUNDS):
        for part, entry, place, n, total in sums(table, shape, pivots, codebooks).collect():
            codebooks[part][entry, place] = int(total) // n
    return coded(table, shape, pivots, codebooks), codebooks


def digest(codebooks: list[np.ndarray]) -> str:
    numbers = (int(x) for book in codebooks for x in book.ravel())
    return sha256(",".join(map(str, numbers)).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, codebooks = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    codes = common.saved(codes, "vector-codes")
    # The sum of a label is repeated for each piece that its rows are dealt to.
    every = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("piece")
    total = F.expr("try_cast(sum(CAST(error AS DECIMAL(20, 0))) AS BIGINT)").alias("label_error")
    of_label = codes.groupBy(F.col("label").alias("of_label")).agg(total).select("*", every)
    dealt = codes.withColumn("dealt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    same = F.col("label").eqNullSafe(F.col("of_label")) & (F.col("dealt") == F.col("piece"))
    return dealt.join(of_label, same).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256")
    )


def _oracle() -> str:
    """The rounds as a chain of tables. Part vectors are lists; a distance and its entry make one number."""
    term = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    tables = [
        f"""parts AS MATERIALIZED (
  SELECT vec_id, label, part, list_transform(embedding[part * len(embedding) // {PARTS} + 1 :
      (part + 1) * len(embedding) // {PARTS}], lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings, range({PARTS}) AS t(part)
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""book_0 AS MATERIALIZED (SELECT * FROM (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM parts) WHERE entry < {ENTRIES})""",
    ]
    for r in range(ROUNDS + 1):
        tables.append(
            f"""near_{r} AS MATERIALIZED (SELECT v.vec_id, v.part, min({term} * {ENTRIES} + c.entry) AS m
  FROM parts v JOIN book_{r} c ON v.part = c.part GROUP BY ALL)"""
        )
        if r == ROUNDS:
            break
        tables.append(
            f"""sums_{r} AS (SELECT part, entry, place, sum(y) AS s, count(*) AS n FROM (
    SELECT part, m % {ENTRIES} AS entry, unnest(x) AS y, unnest(range(len(x))) AS place
    FROM near_{r} JOIN parts USING (vec_id, part)) GROUP BY ALL),
book_{r + 1} AS MATERIALIZED (
  SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS x FROM sums_{r} GROUP BY ALL
  UNION ALL SELECT part, entry, x FROM book_{r} ANTI JOIN sums_{r} USING (part, entry))"""
        )
    chain = ",\n".join(tables)
    return f"""WITH {chain},
codes AS (
  SELECT vec_id, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY part) AS code,
    CAST(sum(m // {ENTRIES}) AS BIGINT) AS error FROM near_{ROUNDS} GROUP BY vec_id),
books AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book_{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes JOIN embeddings USING (vec_id), books
"""


OP12_SQL = _oracle()
