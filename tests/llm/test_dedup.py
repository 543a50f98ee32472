"""Exact, repeated-passage and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from fleetviews.llm import common, components, exact_dedup, repeats, simhash

SPACE = re.compile(r"[\x20\x09-\x0D]")
FOLDERS = ["plain", "repeated", "empty"]


def _order(doc_id):
    return (doc_id is None, doc_id or 0)


@pytest.mark.parametrize("folder", FOLDERS)
def test_exact_dedup(spark, tables, rows_of, folder):
    groups = defaultdict(list)
    for doc_id, text, _, _ in rows_of(tables[folder]):
        groups[SPACE.sub("", text)].append((-len(text), _order(doc_id), doc_id))
    want = Counter()
    for bare, members in groups.items():
        best = min(members, key=lambda m: m[:2])
        digest = hashlib.sha256(bare.encode()).hexdigest()
        for place, member in enumerate(sorted(members, key=lambda m: m[:2])):
            want[(member[2], best[2], len(members), place == 0, digest)] += 1
    got = exact_dedup.op1_exact_dedup(spark, tables[folder]).collect()
    assert Counter(tuple(r) for r in got) == want


def test_exact_dedup_keeps_all_columns(spark, tables):
    docs = common.documents(spark, tables["repeated"])
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    bare = [SPACE.sub("", r.text or "") for r in kept.collect()]
    assert len(bare) == len(set(bare)) == len({SPACE.sub("", r.text or "") for r in docs.collect()})


def test_colliding_fingerprints_are_told_apart(spark, tables, rows_of):
    docs, key = common.keyed(common.documents(spark, tables["plain"]))
    weak = exact_dedup.decisions(docs, key, fields=((7, 3), (5, 2)), chunk=64)
    whole = exact_dedup.decisions(docs, key)
    columns = ["key", "keep_key", "group_size"]
    assert sorted(weak.select(*columns).collect()) == sorted(whole.select(*columns).collect())


def test_fingerprints_compose():
    printer, rng = exact_dedup.Fingerprinter(chunk=50), random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(333))
    whole = exact_dedup.Fingerprinter(chunk=1000).of(data)
    assert printer.of(data) == whole
    for cut in (0, 1, 49, 50, 200, 333):
        large = exact_dedup.Fingerprinter(chunk=1000)
        joined = large.combined(large.of_chunk(data[:cut]), cut, large.of_chunk(data[cut:]))
        assert joined[0] << 31 | joined[1] == whole


def _brute_repeats(texts, length=repeats.LENGTH):
    seen, out = set(), []
    for data in texts:
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            window = data[at : at + length]
            if window in seen:
                gone[at : at + length] = True
            seen.add(window)
        out.append(gone)
    return out


@pytest.mark.parametrize("group", [repeats.GROUP, 0])
@pytest.mark.parametrize("folder", FOLDERS)
def test_repeated_passages(spark, tables, rows_of, monkeypatch, folder, group):
    monkeypatch.setattr(repeats, "marks", lambda rows, length, marks=repeats.marks: marks(rows, length, group))
    rows = sorted(rows_of(tables[folder]), key=lambda r: _order(r[0]))
    want = Counter()
    for (doc_id, text, _, _), gone in zip(rows, _brute_repeats([t.encode() for _, t, _, _ in rows])):
        left = np.frombuffer(text.encode(), np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[(doc_id, len(gone), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())] += 1
    got = repeats.op2_suffix_dedup(spark, tables[folder]).collect()
    assert Counter(tuple(r) for r in got) == want


def test_repeated_passages_of_the_sample(spark, rows_of):
    folder = "/root/testdata/sf0.001"
    rows = sorted(rows_of(folder))
    got = {r.doc_id: r.n_removed for r in repeats.op2_suffix_dedup(spark, folder).collect()}
    gone = _brute_repeats([t.encode() for _, t, _, _ in rows])
    assert got == {r[0]: int(g.sum()) for r, g in zip(rows, gone)}


@pytest.mark.parametrize("group", [0, 3, 40])
def test_large_groups_are_routed_again(spark, group):
    """A passage in changing surroundings makes one large group by the first hash; rows by other routes are exact."""
    rng = random.Random(group)
    letters = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    core, tail, texts = letters(70), letters(25), []
    for i in range(60):
        around = [letters(40), core, rng.choice((tail, letters(25))), letters(30)]
        texts.append(b"".join(around) + rng.choice((b"", b"a" * 130, core * 2, b"".join(around[1:]))))
    texts += [texts[5], b"", texts[7][:99], b"a" * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text binary")
    flags = _brute_repeats(texts)
    gone = [np.zeros(len(t), bool) for t in texts]
    for r in repeats.marks(rows, repeats.LENGTH, group).collect():
        gone[r["key"]][r["start"] : r["start"] + r["n"] + repeats.LENGTH - 1] = True
    assert all((a == b).all() for a, b in zip(gone, flags)) and 0 < sum(map(sum, flags))


def test_groups_stay_whole_where_a_join_is_split(spark):
    """A hash group goes into one index, also where the join before it is sorted and its skew split."""
    rng = random.Random(4)
    letters = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    cores, texts = [letters(110) for _ in range(20)], []
    for core in cores:
        texts += [letters(40) + core + letters(40) for _ in range(10)]
    texts += [letters(40) + cores[0] + letters(40) for _ in range(150)]
    rng.shuffle(texts)
    split = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.files.maxPartitionBytes": "8k",
        "spark.sql.files.openCostInBytes": "1k", "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in split}
    for k, v in split.items():
        spark.conf.set(k, v)
    try:
        # Some group is beyond the limit, so that the join with the large groups has rows.
        rows = spark.createDataFrame(list(enumerate(texts)), "key long, text binary").repartition(8)
        found = repeats.marks(rows, repeats.LENGTH, 100).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    gone = [np.zeros(len(t), bool) for t in texts]
    for r in found:
        gone[r["key"]][r["start"] : r["start"] + r["n"] + repeats.LENGTH - 1] = True
    assert all((a == b).all() for a, b in zip(gone, _brute_repeats(texts)))


def test_routes_agree_on_equal_windows():
    """Whatever the route, equal windows have equal hashes, wherever they lie."""
    rng = random.Random(9)
    window = bytes(rng.randrange(256) for _ in range(repeats.LENGTH))
    texts = [bytes(rng.randrange(256) for _ in range(n)) + window + bytes(n) for n in (0, 3, 50, 200)]
    blocks = repeats.Blocks(repeats.LENGTH)
    for route in repeats.ROUTES:
        (data, starts, lengths, _, _), = blocks(texts)
        _, least, inside = blocks.least(data, starts, lengths, *route)
        places = [int(s) + n for s, n in zip(starts, (0, 3, 50, 200))]
        assert len({int(least[at]) for at in places}) == 1 and all(inside[at] for at in places)
        assert len(least) == len(data) - repeats.LENGTH + 1


def test_run_index_matches():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) for _ in range(25)]
    strings += [strings[0], strings[1] + b"a", b"a" * 70]
    index = repeats.RunIndex(strings)
    assert len(index.heads) <= index.n
    matches = index.matches()
    symbols = index.text.tolist()
    suffixes = sorted(range(index.n), key=lambda i: symbols[i:])
    assert suffixes == index.suffixes.tolist()
    for a, b in zip(suffixes, suffixes[1:]):
        n = 0
        while symbols[a + n] == symbols[b + n]:
            n += 1
        assert matches[b] == n
    later = index.later(5)
    flags = _brute_repeats(strings, 5)
    seen = set()
    for data, at in zip(strings, index.starts.tolist()):
        for i in range(len(data) - 4):
            assert later[at + i] == (data[i : i + 5] in seen)
            seen.add(data[i : i + 5])
    assert len(flags) == len(strings)


def test_blocks_cover_long_texts(monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 300)
    rng = random.Random(2)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 99, 100, 101, 1500, 250, 299, 300)]
    seen = Counter()
    blocks = repeats.Blocks(repeats.LENGTH)
    for data, starts, lengths, rows, offsets in blocks(texts):
        _, _, inside = blocks.least(data, starts, lengths)
        for at in np.flatnonzero(inside).tolist():
            part = int(np.searchsorted(starts, at, "right")) - 1
            place = int(offsets[part]) + at - int(starts[part])
            row = int(rows[part])
            assert data[at : at + 100].tobytes() == texts[row][place : place + 100]
            seen[row, place] += 1
    assert seen == Counter({(r, p): 1 for r, t in enumerate(texts) for p in range(len(t) - 99)})


def _brute_print(text: str) -> int:
    words = text.encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    codes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(c >> bit & 1 for c in codes) > len(codes))


@pytest.mark.parametrize("tile", [simhash.TILE, 7])
@pytest.mark.parametrize("folder", [*FOLDERS, "/root/testdata/sf0.001"])
def test_simhash(spark, tables, rows_of, monkeypatch, folder, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    folder = tables.get(folder, folder)
    rows = rows_of(folder)
    prints = [_brute_print(t) for _, t, _, _ in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[top(i)] = top(j)
    least = {}
    for i, row in enumerate(rows):
        least[top(i)] = min(least.get(top(i), (True, 0, None)), (*_order(row[0]), row[0]), key=lambda x: x[:2])
    want = Counter((r[0], f"{p:016x}", least[top(i)][2]) for i, (r, p) in enumerate(zip(rows, prints)))
    assert Counter(tuple(r) for r in simhash.op3_simhash(spark, folder).collect()) == want


def test_simhash_of_pieces(monkeypatch):
    rng = random.Random(4)
    text = " ".join(rng.choice(["Ab", "cÉd", "e", "Fgh"]) for _ in range(500))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "PIECE", 17)
    assert simhash.fingerprint(text.encode()) == whole == _brute_print(text)


def test_forest_spans_every_component():
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = np.concatenate([centres ^ (np.uint64(1) << np.uint64(b)) for b in range(0, 60, 3)] + [centres])
    near = np.unique(near)
    a, b = simhash.forest(near, None, 3)
    assert len(a) == len(near) - 40 and len(set(a.tolist())) == len(a)


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(200, 201), (201, 200), (7, 7)]
    rng.shuffle(edges)
    got = dict(components.roots(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 180)} | {200: 200, 201: 200}
    assert got == want
    assert components.roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_representatives(spark, tables):
    docs = common.documents(spark, tables["repeated"])
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    classes = simhash.op3_simhash(spark, tables["repeated"])
    assert kept.count() == classes.select("component_id").distinct().count()
