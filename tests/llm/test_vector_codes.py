"""Product codes against plain rounds over Python integers."""

from __future__ import annotations

import math
import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetviews.llm import vector_codes as codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def _rows(kind: str) -> list[tuple]:
    rng = random.Random(7)

    def vector(n=24, size=1.0):
        return [rng.uniform(-size, size) for _ in range(n)]

    rows = [(i, vector(), rng.choice([0, 1, 2, None])) for i in range(140)]
    same = vector()
    rows += [(500 + i, same, 1) for i in range(60)]
    dropped = [(3, None, 1), (1, [0.5, None] * 12, 1), (2, [math.nan] * 24, 2), (4, [math.inf] + [0.0] * 23, 2)]
    if kind == "plain":
        return rows + dropped
    if kind == "repeated":
        return rows + rows[:20] + rows[:3] + [(None, vector(), None), (None, same, 2), (2, same, 1), *dropped]
    if kind == "ragged":
        return rows + [(-1, [], 1), (-2, vector(3), None), (-3, vector(27), 3), (-4, [0.25] * 8, 1)]
    if kind == "few":
        return rows[:5]
    if kind == "large":
        return [(i, vector(16, 10.0 ** rng.randint(0, 18)), i % 3) for i in range(60)]
    if kind == "none":
        return [(1, [], 1), (2, [], None)]
    return dropped if kind == "unusable" else []


def _coded(rows: list[tuple]) -> tuple[Counter, str]:
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in kept), default=0) // 8)
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], (r[2] is not None, r[2] or 0)))
    whole = [[math.floor(4096 * x) for x in r[1]] + [0] * (8 * width - len(r[1])) for r in kept]
    parts = [[w[p * width : (p + 1) * width] for w in whole] for p in range(8)]
    books = [[list(x) for x in part[:16]] for part in parts]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, entry)), i) for i, entry in enumerate(book))

    for _ in range(6):
        for part, book in zip(parts, books):
            groups: dict[int, list] = {}
            for x in part:
                groups.setdefault(nearest(x, book)[1], []).append(x)
            for i, members in groups.items():
                book[i] = [sum(c) // len(members) for c in zip(*members)]
    final = [[nearest(part[i], book) for part, book in zip(parts, books)] for i in range(len(kept))]
    errors = [sum(d for d, _ in f) for f in final]
    of_label = Counter()
    for r, e in zip(kept, errors):
        of_label[r[2]] += e
    numbers = ",".join(str(x) for book in books for entry in book for x in entry)
    whole_digest = sha256(numbers.encode()).hexdigest()

    def long(x):
        return x if x < 2**63 else None

    got = Counter()
    for r, f, e in zip(kept, final, errors):
        got[r[0], "".join(f"{i:02x}" for _, i in f), long(e), long(of_label[r[2]]), whole_digest] += 1
    return got


@pytest.mark.parametrize("kind", ["plain", "repeated", "ragged", "few", "none", "unusable", "empty"])
def test_query_equals_plain_rounds(spark, tmp_path, kind):
    frame = spark.createDataFrame(_rows(kind), SCHEMA)
    clash = [F.lit(1).alias(c) for c in ("vector", "code", "ERROR", "to_pivots", "piece", "dealt", "of_label")]
    frame.select("*", *clash).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = Counter(tuple(r) for r in codes.op12_vector_codes(spark, str(tmp_path)).collect())
    assert got == _coded(_rows(kind))


def test_large_components_take_exact_integers(spark):
    rows = _rows("large")
    got, books = codes.compressed(spark.createDataFrame(rows, SCHEMA))
    want = {k[0]: k[1:3] for k in _coded(rows)}
    assert {r.vec_id: (r.code, r.error) for r in got.collect()} == want
    with pytest.raises(ValueError, match="beyond the range"):
        codes.compressed(spark.createDataFrame([(1, [1e30] * 8, 1)], SCHEMA))


def test_bounds_spare_distances_and_lose_nothing():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (16, 8))
    parts = centres[rng.integers(0, 16, 3000)] + rng.integers(-200, 200, (3000, 8))
    pivots = codes.spread(centres)
    index, best, evaluated = codes.nearest(
        parts, codes.distances(parts, pivots), centres, codes.distances(centres, pivots)
    )
    every = np.stack([codes.squared(parts - c) for c in centres], axis=1)
    assert (index == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert evaluated.mean() < 4


def test_ties_go_to_the_lower_index():
    entries = np.array([[2, 0], [0, 0], [0, 0], [-2, 0]])
    parts = np.array([[1, 0], [0, 0], [-1, 0]])
    pivots = codes.spread(entries)
    index, _, _ = codes.nearest(parts, codes.distances(parts, pivots), entries, codes.distances(entries, pivots))
    assert index.tolist() == [0, 1, 1]
