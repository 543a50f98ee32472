"""Hierarchical packing of tokenised documents into windows of several lengths.

Each task tokenises its documents and packs them itself, so no text and no token crosses the
network and work is as even as the input's partitions. Documents are routed by their length to
tiers (windows of 512, 1024, 2048 and 4096 tokens); of a longer document, whole longest windows
are cut off first and the rest is routed. In each tier, longest first, every document opens a
window; gaps are filled with the longest fitting documents of shorter tiers and, at the end, by
cutting one of them. What remains of the shortest tier is laid end to end. A last window of a
task that stays open is cut at powers of two, which need no padding.

Windows of a tier form steps of an equal number of tokens; the windows left over are dealt to
mixed steps, longest first to the lightest step.

Null and empty texts have one token, the end token. Rows that repeat an id are packed as rows of
their own. An empty table gives an empty result; other columns do not matter. Documents of any
length stream through in bounded buffers, but for the ids of one document.
"""

from __future__ import annotations

import heapq
import os
import sys
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from . import common

TIERS = (512, 1024, 2048, 4096)
END = 2
#: Tokens that a task holds before it packs.
BUFFER = 2_000_000
#: Tokens of a training step, a multiple of the longest window.
STEP = 8 * 4096
#: Words in a generation of a worker's cache.
CACHE = 300_000
#: Words that are encoded as one text.
JOINED = 32
ENDED = END.to_bytes(4, sys.byteorder)
STOPS = frozenset([b".", b","])


class Encoder:
    """Ids of texts as unsigned 32-bit numbers, the end token last.

    Words are encoded once while the cache lasts: no token spans white space. The cache has two
    generations, so that frequent words outlive rare ones.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on every core
        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def batch(self, texts: list[bytes]) -> list[bytes]:
        # The tokenizer ignores case, but not in the names of its special tokens. Bytes are split at
        # the six ASCII spaces only.
        words = [(text if b"<|" in text else text.lower()).split() for text in texts]
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        known, new, stopped = self.young, set(), []
        for word in set().union(*words).difference(known):
            if ids := self.old.get(word):
                known[word] = ids
            elif word[-1:] in STOPS and b"a" <= word[-2:-1] <= b"z":  # a letter ends its token here
                stopped.append(word)
                if word[:-1] not in known:
                    new.add(word[:-1])
            else:
                new.add(word)
        new |= STOPS.difference(known)
        # Names of special tokens are looked for first, also across blanks.
        special = [word for word in new if b"<|" in word]
        codes = self.tokenizer.encode_batch_fast([w.decode() for w in special], add_special_tokens=False)
        known.update(zip(special, [array("I", code.ids).tobytes() for code in codes]))
        known.update(self._joined(new.difference(special)))
        known.update([(word, known[word[:-1]] + known[word[-1:]]) for word in stopped])
        return [b"".join([*map(known.__getitem__, ws), ENDED]) for ws in words]


    def _joined(self, words: set[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Words with their ids, encoded many to a text: a token belongs to the word it begins in."""
        plain = [word.decode() for word in words]
        groups = [plain[at : at + JOINED] for at in range(0, len(plain), JOINED)]
        codes = self.tokenizer.encode_batch([" ".join(group) for group in groups], add_special_tokens=False)
        for group, code in zip(groups, codes):
            ids, starts = array("I", code.ids).tobytes(), [start for start, _ in code.offsets]
            end = at = 0
            for word in group:
                end, first = end + len(word) + 1, at
                while at < len(starts) and starts[at] < end:
                    at += 1
                yield word.encode(), ids[4 * first : 4 * at]


def little_endian(ids: bytes) -> bytes:
    return ids if sys.byteorder == "little" else np.frombuffer(ids, ">u4").astype("<u4").tobytes()


@cache
def encoder(path: str) -> Encoder:
    """One for a worker process, however many tasks it runs."""
    return Encoder(path)


class Piece(NamedTuple):
    length: int
    doc: int
    start: int


def packed(lengths: list[int], tiers=TIERS) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows (tier, pieces) and the pieces that fill none, in order."""
    longest, windows = tiers[-1], []
    waiting: list[list[Piece]] = [[] for _ in tiers]
    for doc, length in enumerate(lengths):
        cut = length // longest * longest
        windows += [(longest, [Piece(longest, doc, at)]) for at in range(0, cut, longest)]
        if length > cut:
            tier = next(i for i, size in enumerate(tiers) if length - cut <= size)
            waiting[tier].append(Piece(length - cut, doc, cut))
    for tier in waiting:
        tier.sort()
    for place in range(len(tiers) - 1, 0, -1):
        while waiting[place]:
            window = [waiting[place].pop()]
            gap = tiers[place] - window[0].length
            for shorter in reversed(waiting[:place]):
                while gap and (at := bisect_right(shorter, gap, key=lambda p: p.length)):
                    window.append(shorter.pop(at - 1))
                    gap -= window[-1].length
            # Nothing fits whole any more: what is cut goes back to the tier of its new length.
            source = next((x for x in (*waiting[:place], waiting[place]) if x), None) if gap else None
            if source:
                piece = source.pop()
                window.append(Piece(gap, piece.doc, piece.start))
                rest = Piece(piece.length - gap, piece.doc, piece.start + gap)
                insort(waiting[next(i for i, size in enumerate(tiers) if rest.length <= size)], rest)
                gap = 0
            if gap:
                waiting[0] += window
                break
            windows.append((tiers[place], window))
    # The shortest tier is laid end to end.
    window, gap = [], tiers[0]
    for piece in waiting[0]:
        while piece.length >= gap:
            windows.append((tiers[0], [*window, Piece(gap, piece.doc, piece.start)]))
            piece, window, gap = Piece(piece.length - gap, piece.doc, piece.start + gap), [], tiers[0]
        if piece.length:
            window.append(piece)
            gap -= piece.length
    return windows, window


def at_powers(pieces: list[Piece]) -> Iterator[tuple[int, list[Piece]]]:
    """An open window, cut into windows whose lengths are powers of two."""
    total = sum(p.length for p in pieces)
    rest = list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        if size := total & 1 << bit:
            window, gap = [], size
            while gap:
                piece = rest.pop()
                taken = min(gap, piece.length)
                window.append(Piece(taken, piece.doc, piece.start))
                gap -= taken
                if piece.length > taken:
                    rest.append(Piece(piece.length - taken, piece.doc, piece.start + taken))
            yield size, window


def steps(tiers: list[int], step: int = STEP) -> list[int]:
    """For each window the step it belongs to; full steps hold ``step`` tokens of one tier."""
    by_tier: dict[int, list[int]] = {}
    for place, tier in enumerate(tiers):
        by_tier.setdefault(tier, []).append(place)
    out, n, left = [0] * len(tiers), 0, []
    for tier, places in sorted(by_tier.items(), reverse=True):
        each = max(1, step // tier)
        full = len(places) // each * each
        for i, place in enumerate(places[:full]):
            out[place] = n + i // each
        n += full // each
        left += places[full:]
    loads = [(0, n + i) for i in range(-(-sum(tiers[p] for p in left) // step))]
    for place in left:  # longest first
        load, group = heapq.heappop(loads)
        out[place] = group
        heapq.heappush(loads, (load + tiers[place], group))
    return out


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " window long, step long"
)


def sequences(docs: DataFrame, path: str, tiers=TIERS, buffer: int = BUFFER, step: int = STEP) -> DataFrame:
    """One row per piece. Sequence and step numbers are unique over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).batch
        first = TaskContext.get().partitionId() << 36
        number = steps_done = held = 0
        ids: list[tuple[int | None, bytes]] = []

        def rows(windows):
            nonlocal number, steps_done
            groups = steps([size for size, _ in windows], step)
            out = []
            for (size, window), group in zip(windows, groups):
                offset = 0
                for length, doc, start in window:
                    doc_id, tokens = ids[doc]
                    code = zlib.crc32(little_endian(tokens[4 * start : 4 * (start + length)]))
                    out.append(
                        (doc_id, start, length, code, len(tokens) // 4, first + number, offset, size,
                         first + steps_done + group)
                    )
                    offset += length
                number += 1
            steps_done += max(groups, default=-1) + 1
            columns = list(zip(*out)) or [[]] * 9
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                for doc_id, tokens in zip(doc_ids[at : at + 256], encode(texts[at : at + 256])):
                    ids.append((doc_id, tokens))
                    held += len(tokens) // 4
                if held >= buffer:
                    windows, still_open = packed([len(t) // 4 for _, t in ids], tiers)
                    yield rows(windows + list(at_powers(still_open)))
                    ids, held = [], 0
        windows, still_open = packed([len(t) // 4 for _, t in ids], tiers)
        yield rows(windows + list(at_powers(still_open)))

    columns = docs.select(F.col("doc_id").cast("long"), common.text_of().cast("binary").alias("text"))
    return columns.mapInArrow(run, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
