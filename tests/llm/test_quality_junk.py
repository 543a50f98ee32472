"""Quality fences that follow the data: much junk, sources of their own kind, sizes."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from fleetviews.llm import quality


def test_much_symbol_junk_is_rejected(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(500)]

    def text(mark: str) -> str:
        return " ".join(rng.choice(words) + mark for _ in range(40))

    n = 600
    junk = {i for i in range(n) if i % 100 < 7}
    rows = [(i, text("$$$" if i in junk else "$" if i % 50 == 30 else ""), "en", "s") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.key: r for r in quality.verdicts(docs, "doc_id").collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} >= junk
    assert all(got[i].kept for i in range(n) if "$" not in rows[i][1])


def _limits(spark, groups):
    """Thresholds by source; a group is (source, symbols of every document out of 100 characters)."""
    rows = [
        ("en", source, 20 + i % 5, 100, symbols, 10, 0)
        for source, marks in groups for i, symbols in enumerate(marks)
    ]
    counted = spark.createDataFrame(
        rows, "lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long"
    )
    return {r.source_: r for r in quality.thresholds(counted).collect()}


def test_a_shifted_source_moves_its_own_threshold(spark):
    prose = [30 if i % 20 == 0 else 0 for i in range(8000)]
    got = _limits(spark, [("prose", prose), ("code", [18 + i % 9 for i in range(999)])])
    assert got["code"].most_symbols > 0.26 and got["prose"].most_symbols < 0.05
    # The same prose with other junk has another threshold: no constant decides.
    alone = _limits(spark, [("prose", prose)])
    other = _limits(spark, [("prose", [x * 2 if x else 8 * (i % 7 == 0) for i, x in enumerate(prose)])])
    assert other["prose"].most_symbols > 0.07 > 0.05 > alone["prose"].most_symbols


def test_thresholds_move_smoothly_with_the_size_of_a_group(spark):
    prose = [30 if i % 20 == 0 else 0 for i in range(4000)]
    found = [_limits(spark, [("prose", prose), ("code", [18 + i % 9 for i in range(n)])])["code"].most_symbols
             for n in (9, 90, 495, 504, 900)]
    assert found == sorted(found) and found[0] < found[-1]
    assert abs(found[3] - found[2]) < 0.02


def test_first_fences_fade(spark):
    def limit(n):
        return _limits(spark, [("s", [30 if i % 20 == 0 else 0 for i in range(n)])])["s"].most_symbols

    assert 0.09 < limit(20) and limit(20) > limit(2000) and limit(20000) < 0.002


def test_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    found = quality.op6_quality_rules(spark, folder).filter("NOT base_failed").join(labels, "doc_id")
    symbols = F.col("n_symbols") / F.col("word_chars") > 0.2
    rows = found.select("quality", "kept", symbols.alias("symbols")).collect()
    junk, good = [r for r in rows if r.symbols], [r for r in rows if r.quality == 1]
    assert junk and not any(r.kept or r.quality == 1 for r in junk)
    assert sum(r.kept for r in good) >= 0.99 * len(good) > 0
