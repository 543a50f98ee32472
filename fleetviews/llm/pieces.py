"""SentencePiece encoding and decoding by a table of prefixes, for vocabularies of the merge type.

Merging joins, again and again, the two neighbours whose joined piece scores highest, the leftmost
on ties. Its result has a local form: a sequence of pieces is the encoding of its text exactly when
every two neighbours are the encoding of theirs. So every prefix of a text has one last piece: the
one that ends there, and that goes with the last piece of what is left in front of it. An
Aho-Corasick automaton names the pieces that end at each place, and a test of two pieces replays
their own merges side by side, until one across their border would come first. The table of last
pieces then gives the ids from the end backwards, in time that grows with the text alone.

No piece of these vocabularies has a white-space mark behind another character, so a text falls
into stretches that begin with marks; where a vocabulary has such a piece, the text is one stretch.
Stretches are kept in a bounded cache for each worker. A character that no piece has is a stretch of
its own, and becomes its bytes (or the unknown piece, one for neighbours, where there are no bytes).

Null and empty texts have no ids. Rows that repeat an id are rows of their own, null ids stay null, an
empty table gives an empty result and other columns do not matter. Texts are taken whole; a task holds
the ids of 64 texts and the table of one stretch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, groupby

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

MARK = "▁"
LOST = "�"
UNKNOWN = " ⁇ "
#: Stretches in a generation of a worker's cache, and the longest that is kept.
CACHE, KEPT_LENGTH = 300_000, 48
#: Pairs of pieces whose test a worker remembers.
PAIRS = 2_000_000
TEXTS = 64
NEVER = float("-inf")


class Vocabulary:
    """Pieces of a model file with their scores, and the two directions over them."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalise = model.normalize
        every = range(model.get_piece_size())
        self.name = [model.id_to_piece(i) for i in every]
        self.unknown = model.unk_id()
        self.control = frozenset(i for i in every if model.is_control(i))
        self.byte = {i: int(self.name[i][3:5], 16) for i in every if model.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte.items()}
        self.leads = self.normalise("x").startswith(MARK)
        plain = [i for i in every if i != self.unknown and i not in self.control and i not in self.byte]
        self.score = {self.name[i]: model.get_score(i) for i in plain}
        # Characters that stand in pieces without being one are atoms of the merging all the same.
        self.text = dict(zip(plain, (self.name[i] for i in plain)))
        self.characters = set(chain.from_iterable(self.score))
        for c in sorted(self.characters - set(self.score)):
            self.text[len(every) + ord(c)] = c
        self.first_atom = len(every)
        self.automaton = ahocorasick.Automaton()
        for i, piece in self.text.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        inside = re.compile(f"[^{MARK}]{MARK}")
        cut = not any(inside.search(piece) for piece in self.score)
        self.stretches = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if cut else "(?s).+").findall
        self._merges: dict[int, tuple | None] = {}
        self._fit = Fits(self)
        self._surface = [n.replace(MARK, " ").encode() for n in self.name]
        for i, b in self.byte.items():
            self._surface[i] = bytes([b])
        for i in self.control:
            self._surface[i] = b""
        self._surface[self.unknown] = UNKNOWN.encode()

    # --- merges of single pieces, and the test of two ---

    def merges(self, piece: int) -> tuple | None:
        """How a piece comes about: its first and last characters, and for each merge in turn its score
        with the first and the last symbol after it. None for a piece that its own text does not give."""
        if piece not in self._merges:
            symbols, steps = list(self.text[piece]), []
            ends = symbols[0], symbols[-1]
            while len(symbols) > 1:
                scores = [self.score.get(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
                best = max(scores)
                if best == NEVER:
                    break
                at = scores.index(best)
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                steps.append((best, symbols[0], symbols[-1]))
            self._merges[piece] = (*ends, steps) if len(symbols) == 1 else None
        return self._merges[piece]

    def stands(self, left: int, right: int) -> bool:
        """Whether merging the joined texts of two pieces gives these two again."""
        a, b = self.merges(left), self.merges(right)
        if a is None or b is None:
            return False
        (_, last, before), (first, _, after) = a, b
        i = j = 0
        while True:
            across = self.score.get(last + first, NEVER)
            own = before[i][0] if i < len(before) else NEVER
            other = after[j][0] if j < len(after) else NEVER
            # Of equal scores the leftmost merge comes first: the left piece's, the border's, the right piece's.
            if across > own and across >= other and across > NEVER:
                return False
            if own == other == NEVER:
                return True
            if own >= other:
                last, i = before[i][2], i + 1
            else:
                first, j = after[j][1], j + 1

    # --- encoding ---

    def _table(self, text: str) -> list[int]:
        """The ids of characters that pieces have, from the unique last piece of every prefix."""
        last, size = [0] * (len(text) + 1), [0] * (len(text) + 1)
        fit = self._fit
        for end, (piece, length) in self.automaton.iter(text):
            end += 1
            # The longest that ends here comes first; what fits is unique.
            if not size[end] and fit[last[end - length] << 32 | piece if length < end else -1 - piece]:
                last[end], size[end] = piece, length
        out, place = [], len(text)
        while place:
            out.append(last[place])
            place -= size[place]
        out.reverse()
        return out

    def _spelled(self, character: str) -> list[int]:
        if self.byte_id:
            return [self.byte_id[b] for b in character.encode()]
        return [self.unknown]

    def stretch(self, text: str) -> list[int]:
        """The ids of one stretch."""
        if self.characters.issuperset(text):
            found = self._table(text)
        else:
            found, known = [], []
            for c in chain(text, [None]):
                if c in self.characters:
                    known.append(c)
                    continue
                found += self._table("".join(known))
                known = []
                if c is not None:
                    found.append(-1 - ord(c))
        if not found or (min(found) >= 0 and max(found) < self.first_atom):
            return found
        out: list[int] = []
        for i in found:
            out += self._spelled(chr(-1 - i) if i < 0 else self.text[i]) if i < 0 or i >= self.first_atom else [i]
        return out

    def ids(self, text: str | None, known: dict | None = None) -> np.ndarray:
        """The ids of a text; ``known`` maps stretches to their ids, and learns missing ones itself."""
        parts = self.stretches(self.normalise(text)) if text else []
        of = known.__getitem__ if known is not None else self.stretch
        found = np.fromiter(chain.from_iterable(map(of, parts)), np.int32)
        if not self.byte_id and len(found):
            found = found[np.r_[True, (found[1:] != self.unknown) | (found[:-1] != self.unknown)]]
        return found

    # --- decoding ---

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. Bytes that are no UTF-8 become the replacement character, one each."""
        ids = ids.tolist()
        if self.leads:
            # The mark that encoding puts in front of a text goes, behind whatever shows nothing.
            at = next((k for k, i in enumerate(ids) if i not in self.control), len(ids))
            begins = at < len(ids) and ids[at] != self.unknown and ids[at] not in self.byte
            if begins and self.name[ids[at]].startswith(MARK):
                rest = self.name[ids[at]][1:].replace(MARK, " ")
                return self._joined(ids[at + 1 :], rest) if rest else self._joined(ids[at + 1 :])
        return self._joined(ids)

    def _joined(self, ids: list[int], head: str = "") -> str:
        if not self.control.isdisjoint(ids):  # bytes on both sides of a control piece are no character
            runs = groupby(ids, self.control.__contains__)
            return head + "".join(self._joined(list(run)) for shows_nothing, run in runs if not shows_nothing)
        whole = b"".join(map(self._surface.__getitem__, ids))
        try:
            return head + whole.decode()
        except UnicodeDecodeError:
            return head + _repaired(whole)


def _repaired(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for length in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + length].decode())
                at += length
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append(LOST)
            at += 1
    return "".join(out)


class Fits(dict):
    """Whether a piece goes with the one in front of it (both in one number), or stands alone (negative)."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, key: int) -> bool:
        if len(self) >= PAIRS:
            self.clear()
        if key < 0:
            found = self.vocabulary.merges(-1 - key) is not None
        else:
            found = self.vocabulary.stands(key >> 32, key & 0xFFFFFFFF)
        self[key] = found
        return found


class Stretches(dict):
    """Ids by stretch, in two generations, so that frequent stretches outlive rare ones."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.older = vocabulary, {}

    def __missing__(self, text: str) -> list[int]:
        found = self.older.get(text)
        if found is None:
            found = self.vocabulary.stretch(text)
        if len(text) <= KEPT_LENGTH:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


@cache
def vocabulary(path: str) -> Vocabulary:
    """One for each worker and file."""
    return Vocabulary(path)


@cache
def _known(path: str) -> Stretches:
    return Stretches(vocabulary(path))


def encoded(docs: DataFrame, path: str, back: bool = False) -> DataFrame:
    """doc_id and ``ids`` of every text, by the model file at ``path``; with ``back`` also the ``text`` that
    the ids decode to, by the same worker."""
    names = ["doc_id", "ids", "text"][: 2 + back]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = vocabulary(path), _known(path)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                ids = [words.ids(t, known) for t in part.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids), pa.int32()))
                texts = [pa.array(map(words.decode, ids), pa.string())] if back else []
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, *texts], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>{', text string' * back}")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (doc_id, ids) with the ``text`` of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                lists = part.column("ids")
                none = np.zeros(0, np.int32)
                texts = [words.decode(x.values.to_numpy() if x.is_valid else none) for x in lists]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "text"]
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return encoded(docs, path, back=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
