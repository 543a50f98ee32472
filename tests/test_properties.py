"""Random inputs against plain re-statements of the rules."""

from __future__ import annotations

import random
from datetime import timedelta

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fleetviews.functions import timing, topics
from fleetviews.plans.registry import Mapping, Registry, UnknownPattern

LEVELS = ["a", "b", "v.1", "x+y", "a b", "", "$", "(c)", "d|e", "^", "[f]", "{g}", "\\h"]


def covers(pattern: list[str], topic: list[str]) -> bool:
    """Level by level, as the rule reads."""
    for i, level in enumerate(pattern):
        if level == ">":
            return "/".join(topic[i:]) != ""
        if i >= len(topic) or (topic[i] == "" if level == "*" else topic[i] != level):
            return False
    return len(pattern) == len(topic)


def random_pairs(n: int, seed: int):
    rng = random.Random(seed)
    for _ in range(n):
        topic = [rng.choice(LEVELS) for _ in range(rng.randint(1, 4))]
        pattern = [
            rng.choice((level, level, "*", ">", rng.choice(LEVELS))) for level in topic
        ] + rng.choice(([], [], [">"], ["*"], ["a"]))
        yield "/".join(pattern), "/".join(topic)


def test_patterns_on_random_topics(spark):
    pairs = list(random_pairs(400, 7))
    frame = spark.createDataFrame([(p, t, covers(p.split("/"), t.split("/"))) for p, t in pairs], "p string, t string, want boolean")
    by_column = F.rlike(F.col("t"), topics.pattern_regex_column(F.col("p")))
    assert frame.where(by_column != F.col("want")).collect() == []
    wanted = {(r["p"], r["t"]): r["want"] for r in frame.collect()}
    few = sorted({p for p, _ in pairs})[::12]
    tests = [topics.topic_matches(F.col("t"), p).alias(f"c{i}") for i, p in enumerate(few)]
    for row in frame.select("p", "t", *tests).collect():
        for i, p in enumerate(few):
            assert row[f"c{i}"] == covers(p.split("/"), row["t"].split("/")), (p, row["t"])
    assert True in wanted.values() and False in wanted.values()


def test_resolution_on_random_patterns(spark):
    rng = random.Random(3)
    level = lambda: rng.choice(("a", "b", "c", "*", ">"))
    some = lambda: "/".join(level() for _ in range(rng.randint(1, 3)))
    registry = Registry([Mapping(some(), f"view{i}", "t") for i in range(12)])
    patterns = [some() for _ in range(150)]

    def best(pattern):
        try:
            return registry.resolve(pattern).mv
        except UnknownPattern:
            return None

    frame = registry.resolved(spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    for row in frame.collect():
        assert row["mv"] == best(row["pattern"]), row


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from(sorted(timing.UNIT_SECONDS)), st.booleans(), st.sampled_from(["", " ", "  "]))
def test_any_valid_duration(n, unit, upper, pad):
    text = pad + f"{n}{unit.upper() if upper else unit}" + pad
    assert timing.parse_duration(text) == timedelta(seconds=n * timing.UNIT_SECONDS[unit])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123456789dhrmins .-", max_size=8))
def test_other_texts_are_errors(text):
    clean = text.strip()
    digits = clean.rstrip("dhrmins")
    valid = digits.isdigit() and clean[len(digits):] in timing.UNIT_SECONDS
    try:
        timing.parse_duration(text)
        assert valid
    except ValueError:
        assert not valid
