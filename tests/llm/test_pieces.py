"""SentencePiece encoding and decoding against the library itself."""

from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from fleetviews.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("folder", ["plain", "repeated", "empty", "/root/testdata/sf0.001"])
def test_query_equals_library(spark, tables, rows_of, library, folder):
    folder = tables.get(folder, folder)
    want = Counter()
    for doc_id, text, *_ in rows_of(folder):
        ids = library.encode(text)
        want[doc_id, len(ids), _digest(",".join(map(str, ids))), _digest(library.decode(ids))] += 1
    assert Counter(tuple(r) for r in pieces.op13_sentencepiece(spark, folder).collect()) == want


def _texts(rng: random.Random, names: list[str]):
    yield from ["", " ", "   ", "▁", "▁▁ ▁", "\n", "<s></s><unk><0x41>", "\0", "a\0b", "�", "ﬁ é", "x" * 5000, " " * 700]
    for _ in range(600):
        yield "".join(rng.choice(names).replace("▁", " ") for _ in range(rng.randint(1, 12)))
        yield "".join(rng.choice("aab \n\t▁") for _ in range(rng.randint(1, 40)))
        yield "".join(chr(rng.choice([rng.randint(0, 0x250), rng.randint(0xE000, 0x10FFFF)])) for _ in range(20))
        yield "".join(rng.choice("etaoin shrdlu.,") for _ in range(rng.randint(1, 200)))


def test_ids_and_texts_equal_library(library):
    rng, vocabulary = random.Random(11), pieces.vocabulary(PATH)
    known = pieces.Stretches(vocabulary)
    for text in _texts(rng, list(vocabulary.score)):
        ids = library.encode(text)
        assert vocabulary.ids(text).tolist() == ids, text
        assert vocabulary.ids(text, known).tolist() == ids, text
        assert vocabulary.decode(np.array(ids, np.int32)) == library.decode(ids), text


def test_decoding_any_ids_equals_library(library):
    """Also control, unknown and byte pieces in orders that no text gives."""
    rng, vocabulary = random.Random(12), pieces.vocabulary(PATH)
    for _ in range(3000):
        kinds = (rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3), 259, rng.randrange(259, 300))
        ids = [rng.choice(kinds) for _ in range(rng.randint(0, 8))]
        assert vocabulary.decode(np.array(ids, np.int32)) == library.decode(ids), ids


def test_ids_of_a_table_decode(spark, library):
    rows = [(1, library.encode("Über  all\n")), (2, []), (None, None), (2, [203, 1, 259])]
    got = pieces.decoded(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).collect()
    assert [(r.doc_id, r.text) for r in got] == [(i, library.decode(x or [])) for i, x in rows]


def _merged(text: str, score: dict[str, float]) -> list[str]:
    symbols = list(text)
    while len(symbols) > 1:
        joined = [score.get(a + b, pieces.NEVER) for a, b in zip(symbols, symbols[1:])]
        best = max(joined)
        if best == pieces.NEVER:
            break
        at = joined.index(best)
        symbols[at : at + 2] = ["".join(symbols[at : at + 2])]
    return symbols


def test_pairs_equal_merging():
    rng, vocabulary = random.Random(13), pieces.vocabulary(PATH)
    ids = list(vocabulary.text)
    short = [i for i in ids if len(vocabulary.text[i]) < 4]
    marks = [i for i in ids if not vocabulary.text[i].strip(pieces.MARK)]
    for _ in range(4000):
        pool = rng.choice((ids, short, marks))
        a, b = rng.choice(pool), rng.choice(pool)
        both = [vocabulary.text[a], vocabulary.text[b]]
        assert vocabulary.stands(a, b) == (_merged("".join(both), vocabulary.score) == both), both


def test_cache_forgets_without_changing_results(monkeypatch, library):
    monkeypatch.setattr(pieces, "CACHE", 3)
    monkeypatch.setattr(pieces, "PAIRS", 5)
    vocabulary = pieces.Vocabulary(PATH)
    known = pieces.Stretches(vocabulary)
    text = "one two three four five one two three six seven " * 20
    assert vocabulary.ids(text, known).tolist() == library.encode(text)
    assert len(known) <= 3
