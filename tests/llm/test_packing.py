"""Packing against whole-text encoding, and its promises."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fleetviews.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def _ids(tokenizer, text: str) -> np.ndarray:
    return np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")


@pytest.mark.parametrize("folder", ["plain", "repeated", "empty", "/root/testdata/sf0.001"])
def test_packing(spark, tables, rows_of, folder):
    folder = tables.get(folder, folder)
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter((r[0], _ids(tokenizer, r[1]).tobytes()) for r in rows_of(folder))
    pieces = packing.op9_packing(spark, folder).collect()
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
    for members in by_sequence.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 4096 and at & (at - 1) == 0 and at == members[0].window
    tokens = sum(p.length for p in pieces)
    assert tokens == sum(len(t) // 4 * n for (_, t), n in want.items())
    codes = Counter()
    for (doc_id, ids), n in want.items():
        for p in {(p.start, p.length) for p in pieces if p.doc_id == doc_id}:
            codes[doc_id, *p, zlib.crc32(ids[4 * p[0] : 4 * sum(p)])] += n
    assert all((p.doc_id, p.start, p.length, p.ids_crc32) in codes for p in pieces)
    if folder != tables["repeated"]:
        cover = Counter()
        for p in pieces:
            assert p.doc_tokens >= p.start + p.length
            cover.update((p.doc_id, i) for i in range(p.start, p.start + p.length))
        assert cover == Counter((d, i) for (d, t) in want for i in range(len(t) // 4))


def test_steps_are_balanced():
    rng = random.Random(1)
    tiers = [rng.choice(packing.TIERS) for _ in range(500)]
    loads = Counter()
    for tier, step in zip(tiers, packing.steps(tiers)):
        loads[step] += tier
    assert set(loads) == set(range(len(loads)))
    assert max(loads.values()) <= packing.STEP + 4096
    assert sum(x == packing.STEP for x in loads.values()) >= len(loads) - 2


def test_packed_windows_are_full():
    rng = random.Random(2)
    for n in (0, 1, 5, 300):
        lengths = [rng.choice([1, rng.randint(1, 700), rng.randint(1, 9000)]) for _ in range(n)]
        windows, rest = packing.packed(lengths)
        windows += list(packing.at_powers(rest))
        seen = Counter()
        for size, window in windows:
            assert sum(p.length for p in window) == size
            for p in window:
                seen.update((p.doc, i) for i in range(p.start, p.start + p.length))
        assert seen == Counter((d, i) for d, length in enumerate(lengths) for i in range(length))


def test_words_encode_like_texts():
    rng = random.Random(3)
    tokenizer = Tokenizer.from_file(PATH)
    alphabet = "aB'. ,\t\n  \x1c\x85é́ßΣς1٣<|>中🙂-_"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>. it's. don't, x'. ab.c. a.,", "Ünï.", "á.", "i'. 's. s."]
    encoder = packing.Encoder(PATH)
    for text, ids in zip(texts, encoder.batch([t.encode() for t in texts])):
        assert ids == _ids(tokenizer, text).tobytes(), text
