"""Removal of long repeated passages with a run-compressed suffix index.

Every string of ``LENGTH`` bytes that also starts earlier in the corpus is removed; the first
occurrence stays. Three steps find them:

1. *Routing.* A window of LENGTH bytes is known by the least hash of its GRAM-byte substrings, so
   equal windows share it. Runs of windows with the same least hash become segments. Hashes that
   occur once in the corpus cannot belong to a repeat; the others are marked in a bitmap of fixed
   size, and only their segments leave the scan.
2. *Copies.* Equal segments (by both their least hash and a hash of their bytes, 128 bits in all)
   are one content with its first occurrence; windows of every later occurrence are repeats.
3. *Index.* Different contents with the same hash may still share windows. Whole hash groups go
   together into an index: the Burrows-Wheeler transform of their contents, compressed to its
   runs, with the suffix positions at run heads. Common prefixes are compared at run heads only;
   inside a run the match at a position is one byte shorter than at the position before it, so
   one pass in text order streams the matching statistics. Where they reach LENGTH the window
   occurs elsewhere; the earliest of the windows that match each other stays.

A group with more than ``GROUP`` contents is too much for one index. Its contents are routed again, like
texts in step 1, by the least of other hashes of their GRAM-byte substrings, then by one from either end of
the window: equal windows still meet, the others part, and steps 2 and 3 follow. Only what is in a large
group by every one of the hashes is grouped window by window, with the same result.

Null and empty texts have no bytes. Documents are ordered by id, nulls last; rows that repeat an id
are documents of their own, in a fixed order. An empty table gives an empty result; other columns do
not matter. Long texts are hashed in blocks, so memory does not grow with them but for the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

LENGTH = 100
GRAM = 32
#: Bits of the bitmap of hashes that occur more than once.
BITS = 1 << 27
#: Bits of the bitmap of documents that lose bytes.
DOC_BITS = 1 << 24
BLOCK = 1 << 18
#: Bytes and contents of one index, and contents beyond which a hash group is routed again.
INDEX_BYTES = 1 << 19
INDEX_CONTENTS = 16_000
GROUP = 2_000
#: Ways of routing: a seed, and how many substrings at either end of a window count (None: all of it).
ROUTES = ((0, None), (1, None), (2, None), (3, 8))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    x = data.astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | x[width:] << np.uint64(8 * width)
    for width in (8, 16):
        x = _mixed(x[:-width]) * np.uint64(0xD6E8FEB86659FD93) + x[width:]
    return _mixed(x)


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` over each ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


class Blocks:
    """Texts laid end to end in blocks of bounded size; windows never cross texts."""

    def __init__(self, length: int):
        self.length, self.width = length, length - GRAM + 1

    def __call__(self, texts) -> Iterator[tuple[np.ndarray, ...]]:
        """Blocks (bytes, and per text in them its start, length, row and offset in its text). A long
        text goes on in the next block, with the last LENGTH - 1 bytes again."""
        parts, held = [], 0
        for row, text in enumerate(texts):
            at = 0
            while len(text) - at >= self.length:
                piece = text[at : at + BLOCK]
                parts.append((piece, row, at))
                held += len(piece)
                at += len(piece) - self.length + 1
                if held >= BLOCK:
                    yield self._block(parts)
                    parts, held = [], 0
        if parts:
            yield self._block(parts)

    @staticmethod
    def _block(parts):
        lengths = np.array([len(p) for p, _, _ in parts])
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(p for p, _, _ in parts), np.uint8)
        return data, starts, lengths, np.array([r for _, r, _ in parts]), np.array([o for _, _, o in parts])

    def least(self, data, starts, lengths, seed: int = 0, ends: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gram hashes, the least hash of each window, and which windows lie in one text.

        With ``ends`` it is made of the least of that many hashes at the head and at the tail of a window.
        """
        grams = gram_hashes(data)
        if seed:
            grams = _mixed(grams ^ np.uint64(seed))
        least = _sliding(grams, ends or self.width, np.minimum)
        if ends:
            least = _mixed(least[: len(least) - (self.width - ends)]) + least[self.width - ends :]
        edge = np.zeros(len(least) + 1, np.int8)
        np.add.at(edge, starts, 1)
        np.add.at(edge, np.minimum(starts + lengths - self.length + 1, len(least)), -1)
        return grams, least, np.cumsum(edge[:-1]) > 0


def _texts(batch) -> list[bytes]:
    return [x.as_buffer().to_pybytes() for x in batch.column("text")]


def _repeated_hashes(rows: DataFrame, length: int) -> DataFrame:
    """Least hashes of windows that occur at more than one place."""

    def run(batches):
        blocks = Blocks(length)
        for batch in batches:
            for data, starts, lengths, _, _ in blocks(_texts(batch)):
                grams, least, inside = blocks.least(data, starts, lengths)
                edge = np.zeros(blocks.width - 1, np.uint64)
                most = _sliding(np.concatenate([edge, np.where(inside, least, np.uint64(0)), edge]), blocks.width, np.maximum)
                hashes, n = np.unique(grams[grams == most], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"]
                )

    found = rows.select("text").mapInArrow(run, "hash long, n long")
    return found.groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 1")


SEGMENT = "hash long, content long, key long, start long, n long, inner boolean, bytes binary"


def _segments(rows: DataFrame, length: int, shared=None, seed: int = 0, ends: int | None = None) -> DataFrame:
    """Runs of windows whose least hash may repeat: ``n`` windows from ``start`` on.

    ``rows`` has key, hash, start and text. A text is what starts there in the document, and its windows
    meet only others of the same ``hash``: none for whole documents, a group's for its contents.
    """

    def run(batches):
        blocks = Blocks(length)
        for batch in batches:
            keys, group, base = (batch.column(c).to_numpy() for c in ("key", "hash", "start"))
            for data, starts, lengths, row, offset in blocks(_texts(batch)):
                grams, least, inside = blocks.least(data, starts, lengths, seed, ends)
                part = np.searchsorted(starts, np.arange(len(least)), "right") - 1
                new = np.ones(len(least), bool)
                new[1:] = (least[1:] != least[:-1]) | (part[1:] != part[:-1]) | (inside[1:] != inside[:-1])
                heads = np.flatnonzero(new)
                # A run is cut after ``width`` windows, so that contents stay short.
                sizes = np.diff(np.append(heads, len(least)))
                pieces = -(-sizes // blocks.width)
                first = np.repeat(heads, pieces)
                nth = np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                n = np.minimum(np.repeat(sizes, pieces) - nth * blocks.width, blocks.width)
                first = first + nth * blocks.width
                keep = inside[first]
                if shared is not None:
                    keep &= common.in_bitmap(shared.value, BITS, least[first])
                first, n = first[keep], n[keep]
                if not len(first):
                    continue
                own = part[first]
                hashes = least[first]
                if seed:
                    hashes = _mixed(hashes ^ _mixed(group[row[own]].view(np.uint64)))
                raw = data.tobytes()
                texts = [raw[a : a + m + length - 1] for a, m in zip(first.tolist(), n.tolist())]
                # The same hash at a second place in the segment: its windows may repeat inside it.
                at = np.array([int(np.argmin(grams[a : a + (ends or blocks.width)])) for a in first.tolist()])
                inner = [t.find(t[a : a + GRAM], a + 1) >= 0 for t, a in zip(texts, at.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes.view(np.int64)),
                        pa.array(np.array([xxhash.xxh3_64_intdigest(t) for t in texts], np.uint64).view(np.int64)),
                        pa.array(keys[row[own]]),
                        pa.array(base[row[own]] + offset[own] + first - starts[own]),
                        pa.array(n.astype(np.int64)),
                        pa.array(inner, pa.bool_()),
                        pa.array(texts, pa.binary()),
                    ],
                    [x.split()[0] for x in SEGMENT.split(", ")],
                )

    return rows.select("key", "hash", "start", "text").mapInArrow(run, SEGMENT)


class RunIndex:
    """Run-length Burrows-Wheeler transform of some strings, with positions sampled at run heads."""

    def __init__(self, strings: list[bytes]):
        lengths = np.array([len(s) + 1 for s in strings])
        self.starts = np.cumsum(lengths) - lengths
        n, m = int(lengths.sum()), len(strings)
        # Each string ends in a symbol of its own, below all bytes.
        text = np.empty(n, np.int64)
        ends = self.starts + lengths - 1
        body = np.ones(n, bool)
        body[ends] = False
        text[body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + m
        text[ends] = np.arange(m)
        self.text, self.n = text, n
        self.suffixes = self._sorted(int(lengths.max()))
        before = text[self.suffixes - 1]  # the symbol before each suffix, in their order
        self.heads = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        self.symbols = before[self.heads]
        self.sampled = self.suffixes[self.heads]

    def _sorted(self, longest: int) -> np.ndarray:
        """Suffixes in order, by prefix doubling; no string is longer than ``longest``."""
        bits = int(self.text.max() + 1).bit_length()
        width = max(1, 62 // bits)
        code = np.zeros(self.n, np.uint64)
        padded = np.append(self.text, np.zeros(width, np.int64)).astype(np.uint64)
        for i in range(width):
            code = code << np.uint64(bits) | padded[i : i + self.n]
        while True:
            order = np.argsort(code)
            sorted_ = code[order]
            rank = np.empty(self.n, np.int64)
            rank[order] = np.cumsum(np.append(False, sorted_[1:] != sorted_[:-1]))
            if width >= longest or rank[order[-1]] == self.n - 1:
                return order
            following = np.append(rank[width:] + 1, np.zeros(min(width, self.n), np.int64))
            code = rank.astype(np.uint64) * np.uint64(self.n + 1) + following.astype(np.uint64)
            width *= 2

    def _prefix_lengths(self) -> np.ndarray:
        """At each run head, how far its suffix agrees with the one before it."""
        a, b = self.sampled[1:], self.suffixes[self.heads[1:] - 1]
        found, open_, step = np.zeros(len(a) + 1, np.int64), np.arange(len(a)), 16
        text = np.append(self.text, np.full(step, -1))
        at = 0
        while len(open_):
            places = np.arange(at, at + step)
            x = np.minimum(a[open_, None] + places, self.n + step - 1)
            y = np.minimum(b[open_, None] + places, self.n + step - 1)
            same = text[x] == text[y]
            agree = np.where(same.all(1), step, same.argmin(1))
            found[open_ + 1] += agree
            open_ = open_[agree == step]
            at += step
        return found

    def matches(self) -> np.ndarray:
        """For each text position the length of its match with the suffix before it in the order."""
        order = np.argsort(self.sampled)
        places, lengths = self.sampled[order], self._prefix_lengths()[order]
        last = np.searchsorted(places, np.arange(self.n), "right") - 1
        return lengths[last] - (np.arange(self.n) - places[last])

    def later(self, length: int) -> np.ndarray:
        """Text positions whose ``length`` bytes also start at an earlier position."""
        long_ = self.matches()[self.suffixes] >= length
        classes = np.flatnonzero(~long_)
        first = np.minimum.reduceat(self.suffixes, classes)
        members = np.cumsum(~long_) - 1
        out = np.zeros(self.n, bool)
        out[self.suffixes] = self.suffixes != first[members]
        return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - edges[::2]


MARK = "key long, start long, n long"


def _indexed(contents: DataFrame, length: int, width: int) -> DataFrame:
    """Repeated windows among contents of the same hash, by one run index for a block of hash groups."""

    def marked(block):
        index = RunIndex([b for _, _, b in block])
        later = index.later(length)
        keys, starts, sizes = [], [], []
        for (key, start, content), at in zip(block, index.starts.tolist()):
            a, n = _runs(later[at : at + len(content) - length + 1])
            keys += [key] * len(a)
            starts += (a + start).tolist()
            sizes += n.tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())],
            ["key", "start", "n"],
        )

    def run(batches):
        block, size, group, inner, last = [], 0, [], False, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("hash", "key", "start", "inner", "bytes")]
            for hash_, key, start, repeats, content in zip(*columns):
                if hash_ != last:
                    if len(group) > 1 or inner:
                        block += group
                        size += sum(len(b) for _, _, b in group)
                    if size >= INDEX_BYTES or len(block) >= INDEX_CONTENTS:
                        yield marked(block)
                        block, size = [], 0
                    group, inner, last = [], False, hash_
                group.append((key, start, content))
                inner = inner or repeats
        if len(group) > 1 or inner:
            block += group
        if block:
            yield marked(block)

    # Dealt by a hash of the hash: a repartition by the column itself is left out behind a join on it,
    # whose partitions adaptive execution may cut inside a group.
    dealt = contents.repartition(width, F.xxhash64("hash")).sortWithinPartitions("hash", "key", "start")
    return dealt.select("hash", "key", "start", "inner", "bytes").mapInArrow(run, MARK)


def _of_hashes(contents: DataFrame, hashes) -> DataFrame:
    """The rows whose hash is in the bitmap."""

    def run(batches):
        for batch in batches:
            hit = common.in_bitmap(hashes.value, BITS, batch.column("hash").to_numpy().view(np.uint64))
            yield batch.filter(pa.array(hit))

    return contents.mapInArrow(run, "hash long, key long, start long, inner boolean, bytes binary")


def _windowed(contents: DataFrame, length: int) -> DataFrame:
    """The same, window by window, for what no route parts."""

    def run(batches):
        for batch in batches:
            keys, starts, windows = [], [], []
            for key, start, content in zip(*(batch.column(c).to_pylist() for c in ("key", "start", "bytes"))):
                n = len(content) - length + 1
                keys += [key] * n
                starts += range(start, start + n)
                windows += [xxhash.xxh3_128_digest(content[i : i + length]) for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(windows, pa.binary()), pa.array(keys, pa.int64()), pa.array(starts, pa.int64())],
                ["window", "key", "start"],
            )

    windows = contents.select("key", "start", "bytes").mapInArrow(run, "window binary, key long, start long")
    first = windows.groupBy("window").agg(F.min(F.struct("key", "start")).alias("first"), F.count("*").alias("times"))
    later = windows.join(first.filter("times > 1"), "window").filter(F.struct("key", "start") != F.col("first"))
    return later.select("key", "start", F.lit(1).cast("long").alias("n"))


def _first_places(segments: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """The different contents of segments, each at its first place, and the marks of the other places."""
    place = F.min(F.struct("key", "start", "n", "inner", "bytes")).alias("first")
    contents = segments.groupBy("hash", "content").agg(F.count("*").alias("times"), place)
    contents = common.saved(contents.select("hash", "content", "times", "first.*"), f"contents-{step}")
    copied = contents.filter("times > 1").select(
        "hash", "content", F.col("key").alias("first_key"), F.col("start").alias("first_start")
    )
    copies = segments.select("hash", "content", "key", "start", "n").join(copied, ["hash", "content"]).filter(
        "key != first_key OR start != first_start"
    )
    return contents.select("hash", "key", "start", "inner", "bytes"), copies.select("key", "start", "n")


def marks(rows: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """key, start, n: the ``n`` windows from ``start`` on also start earlier. ``rows`` has key, text (binary)."""
    spark = rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(common.bitmap(_repeated_hashes(rows, length), "hash", BITS))
    zero = F.lit(0).cast("long")
    rows = rows.select("key", zero.alias("hash"), zero.alias("start"), "text")
    found = []
    for step, (seed, ends) in enumerate(ROUTES):
        segments = common.saved(_segments(rows, length, shared if step == 0 else None, seed, ends), f"segments-{step}")
        contents, copies = _first_places(segments, step)
        # Groups of one content without an inner repeat are done; their bytes stay where they are.
        groups = common.saved(
            contents.groupBy("hash").agg(F.count("*").alias("size"), F.max("inner").alias("inner"))
            .filter("size > 1 OR inner"),
            f"groups-{step}",
        )
        open_ = spark.sparkContext.broadcast(common.bitmap(groups, "hash", BITS))
        large = groups.filter(F.col("size") > group).select("hash")
        several = _of_hashes(contents, open_)
        found += [copies, _indexed(several.join(large, "hash", "left_anti"), length, width)]
        if large.isEmpty():
            break
        rest = several.join(large, "hash", "left_semi")
        rows = rest.select("key", "hash", "start", F.col("bytes").alias("text"))
    else:
        found.append(_windowed(rest, length))
    return reduce(DataFrame.unionAll, found)


OUT = "key long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def without_repeats(docs: DataFrame, key: str, length: int = LENGTH, texts: bool = True) -> DataFrame:
    """One row per row of ``docs``: key, doc_id, sizes, digest of what is left and, if asked for, that itself."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
        common.text_of().cast("binary").alias("text"),
    )
    found = common.saved(marks(rows, length), "marks")
    touched = spark.sparkContext.broadcast(common.bitmap(found.select("key").distinct(), "key", DOC_BITS))

    def judged(text: bytes, spans) -> tuple[int, int, int, str, bytes | None]:
        cut, left = np.zeros(len(text) + 1, np.int32), text
        if spans:
            np.add.at(cut, [s["start"] for s in spans], 1)
            np.add.at(cut, [s["start"] + s["n"] + length - 1 for s in spans], -1)
        removed = np.cumsum(cut[:-1]) > 0
        if spans:
            left = np.frombuffer(text, np.uint8)[~removed].tobytes()
        return (
            len(text), int(removed.sum()), len(_runs(removed)[0]), hashlib.sha256(left).hexdigest(),
            left if texts else None,
        )

    names = [x.split()[0] for x in OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def whole(batches):
        """Texts that lose nothing are done here; only the others travel on."""
        for batch in (b for b in batches if b.num_rows):
            go = common.in_bitmap(touched.value, DOC_BITS, batch.column("key").to_numpy().view(np.uint64))
            data = _texts(batch)
            out = [(None,) * 5 if g else judged(t, None) for g, t in zip(go.tolist(), data)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("doc_id"),
                 *[pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                 pa.array([t if g else None for g, t in zip(go.tolist(), data)], pa.binary())],
                [*names, "text"],
            )

    def cut(batches):
        for batch in (b for b in batches if b.num_rows):
            spans = batch.column("spans").to_pylist()
            out = [judged(t, s) for t, s in zip(_texts(batch), spans)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]],
                names,
            )

    seen = common.saved(rows.mapInArrow(whole, f"{OUT}, text binary"), "seen")
    spans = found.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    changed = seen.filter(F.col("text").isNotNull()).select("key", "doc_id", "text").join(spans, "key", "left")
    done = seen.filter(F.col("text").isNull()).select(*names)
    return done.unionAll(changed.mapInArrow(cut, OUT))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, key = common.keyed(common.documents(spark, sf_dir))
    return without_repeats(docs, key, texts=False).drop("key", "kept")
