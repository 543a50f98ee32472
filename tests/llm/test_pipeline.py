"""The pipeline against a plain version of each stage, each on the rows that its predecessor kept."""

from __future__ import annotations

import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from .test_dedup import _brute_print, _order
from .test_packing import _ids
from .test_texts import WORD, _kept, _targets


def _accepted(rows):
    kept = _kept([(r[1] or "", r[3], r[2]) for r in rows])
    return [r for r, keep in zip(rows, kept) if keep]


def _without_copies(rows):
    best = {}
    for r in rows:
        print_, rank = re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), (-len(r[1] or ""), _order(r[0]))
        if print_ not in best or rank < best[print_][0]:
            best[print_] = (rank, r)
    return [r for _, r in best.values()]


def _without_near_copies(rows):
    rows = sorted(rows, key=lambda r: _order(r[0]))
    prints, group = [_brute_print(r[1] or "") for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return [r for i, r in enumerate(rows) if group[i] == i]


@pytest.mark.parametrize("folder", ["plain", "repeated", "empty"])
def test_pipeline(spark, tables, monkeypatch, folder):
    seen = {}

    def watched(name, stage):
        def call(spark, docs, sf_dir):
            seen[name] = docs.select("doc_id", "text", "source", "lang").collect()
            out = stage(spark, docs, sf_dir)
            assert name == "packing" or out.columns == docs.columns
            return out

        return name, call

    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*s) for s in corpus_pipeline.STAGES])
    pieces = corpus_pipeline.run(spark, tables[folder]).collect()
    docs, accepted, single, apart, mixed = (list(map(tuple, rows)) for rows in seen.values())
    assert Counter(accepted) == Counter(_accepted(docs))
    assert Counter(single) == Counter(_without_copies(accepted))
    assert Counter(apart) == Counter(_without_near_copies(single))
    if folder == "empty":
        assert not pieces and not mixed
        return
    assert 0 < len(apart) < len(single) < len(accepted) < len(docs)

    # Every source comes near its target, and nothing is taken more than twice.
    size = lambda r: len(WORD.findall(r[1] or ""))
    totals, taken = Counter(), Counter()
    for r in apart:
        totals[r[2]] += size(r)
    for r in mixed:
        taken[r[2]] += size(r)
    assert all(n <= 2 * Counter(apart)[r] for r, n in Counter(mixed).items())
    longest = max(map(size, apart))
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    for i, target in _targets([(s, totals[s]) for s in order]).items():
        assert target - longest - 1 <= taken[order[i]] <= target + 1

    # Every id of every document that the mix took lies in one piece.
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, got = Counter(), Counter()
    for doc_id, text, *_ in mixed:
        want[doc_id] += len(_ids(tokenizer, text or ""))
    for p in pieces:
        got[p.doc_id] += p.length
    assert got == want
