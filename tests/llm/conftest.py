"""Small tables with every awkward row: nulls, empties, long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_rows() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeñßü") for _ in range(rng.randint(1, 7))) for _ in range(300)]

    def prose(n: int) -> str:
        words = [rng.choice(vocabulary) for _ in range(n)]
        return "".join(w + rng.choice([" ", " ", " ", ", ", ".\n", "\t"]) for w in words)

    shared, passage = prose(60), prose(45)
    long_ = prose(4000)
    texts = [None, "", " \t\n", "x", "one two", shared, shared, shared + " ", shared.replace(" ", "  "), long_,
             long_[:9000] + "changed" + long_[9000:], "a" * 700, "ab" * 400, "a" * 350]
    texts += [prose(rng.randint(3, 40)) + passage + prose(rng.randint(3, 40)) for _ in range(6)]
    base = prose(120).split(" ")
    for i in range(12):  # near copies
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"w{i}"
        texts.append(" ".join(copy))
    texts += [prose(rng.randint(1, 120)) for _ in range(30)]
    texts += [
        "Mail jo.doe+x@mail.example.org or a@b, x@y@z.co.uk; call +1 (555) 010-9999 now.",
        "Host 10.0.0.1, 300.1.1.1, 1.2.3.4.5.6.7.8 card 4111 1111 1111 1111 no 4111-1111-1111-1112",
        "iban: DE89 3704 0044 0532 0130 00 token = \"0123456789abcdef0123\" ftp://u:pw@host.example/x +49 30 123456 7",
        "Released under the MIT License.\n" + prose(30),
        "Released under the MIT License\n\nLicensed under the Apache License, version 2.0!\n" + prose(9),
        "### $$$ %%% ||| <<< " * 30, " ".join(["again and again we say the same old thing"] * 9),
    ]
    rows = [
        (i, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "Ä", "", None]), None if t is None else len(t))
        for i, t in enumerate(texts)
    ]
    return rows


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Folders by name: ``plain`` has unique ids, ``repeated`` null and repeated ones, ``empty`` no rows."""
    root = tmp_path_factory.mktemp("tables")
    rows = awkward_rows()
    again = rows + rows[5:8] + [rows[9], rows[9], (None, "one two", None, None, 7), (None, None, "en", "s1", 0)]
    clash = [F.lit(1).alias(c) for c in ("row_key", "KEY", "text_", "print", "size", "kept", "word", "hash", "times")]
    for name, data in (("plain", rows), ("repeated", again), ("empty", [])):
        frame = spark.createDataFrame(data, DOCS)
        if name == "repeated":
            frame = frame.select("*", *clash)
        frame.repartition(3).write.parquet(f"{root}/{name}/documents.parquet")
    return {name: f"{root}/{name}" for name in ("plain", "repeated", "empty")}


@pytest.fixture(scope="session")
def rows_of(spark):
    """Rows of a folder's documents as (doc_id, text or '')."""

    def read(folder: str) -> list[tuple]:
        rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
        return [(r.doc_id, r.text or "", r.lang, r.source) for r in rows]

    return read
