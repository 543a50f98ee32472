"""Repair of conversations against a search over all edits, and against rows in plain Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict
from functools import cache
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from fleetviews.llm import repair

SPACES = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile(r"(s?(ua)+)?")


@cache
def _cheapest(letters: str) -> tuple[int, str, str]:
    """Cost, edits and roles, by comparing whole edit texts from the back: no vectors, no walk."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    n = len(letters)
    due, to = "uuau", (2, 2, 3, 2)

    def relax(place: int, options: dict[int, list]) -> None:
        for _ in range(4):
            for q in range(4):
                found = list(options[q])
                if (place, to[q]) in best:
                    cost, edits = best[place, to[q]]
                    found.append((cost + 2, "I" + edits))
                if found:
                    best[place, q] = min([*found, *([best[place, q]] if (place, q) in best else [])])

    relax(n, {0: [(0, "")], 1: [], 2: [], 3: [(0, "")]})
    for i in range(n - 1, -1, -1):
        options = {}
        for q in range(4):
            rest = {to_: best[i + 1, to_] for to_ in range(4) if (i + 1, to_) in best}
            found = [(rest[q][0] + 3, "D" + rest[q][1])]
            if letters[i] not in "bd":
                own, extra = letters[i].lower(), letters[i].isupper()
                goal = to[q] if own == due[q] else 1 if q == 0 and own == "s" else None
                if goal is not None:
                    found.append((rest[goal][0] + extra, "K" + rest[goal][1]))
                found.append((rest[to[q]][0] + 2 + extra, "R" + rest[to[q]][1]))
            options[q] = found
        relax(i, options)
    return best[0, 0]


def _initials(edits: str) -> str:
    return edits.translate(str.maketrans("uaUA", "IIRR"))


def test_repairs_are_cheapest_and_least():
    rng = random.Random(2)
    for n in [0, 1, 1, 2, 2, 3, 3] + [rng.randint(0, 14) for _ in range(600)] + [200]:
        letters = "".join(rng.choice("bdsuaoSUAOuauaua") for _ in range(n))
        cost, edits = repair.repair(letters)
        assert (cost, _initials(edits)) == _cheapest(letters), letters
        kept = [e.lower() if e != "K" else letters[i].lower() for e, i in _steps(edits) if e != "D"]
        assert GRAMMAR.fullmatch("".join(kept)), (letters, edits)


def _steps(edits: str):
    i = 0
    for e in edits:
        yield e, i
        i += e in "DKUA"


def test_chunks_give_what_the_whole_gives():
    rng = random.Random(4)
    for _ in range(200):
        letters = "".join(rng.choice("bdsuaoSUAOuauaua") for _ in range(rng.randint(1, 60)))
        cuts = sorted(rng.sample(range(1, len(letters)), min(len(letters) - 1, rng.randint(0, 5)))) if len(letters) > 1 else []
        parts = [letters[a:b] for a, b in zip([0, *cuts], [*cuts, len(letters)])]
        behind, v = [], repair.END
        for part in reversed(parts):
            behind.append(v)
            v = repair.through(repair.matrix(part), v)
        q, edits = 0, ""
        for part, end in zip(parts, reversed(behind)):
            more, q = repair.Checkpoints(part, end).walk(q)
            edits += more
        assert (v[0], edits + repair.TAIL[q]) == repair.repair(letters)


def test_vectors_are_stored_at_square_roots():
    points = repair.Checkpoints("ua" * 5000, repair.END)
    assert len(points.marks) <= 102 and len(points.vectors(0)) == 102


def _expected(rows: list[tuple]) -> dict:
    """The contract row by row, over (conv_id, turn, role, text)."""
    by_conversation = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, members = zlib.crc32(name.encode()) % 20, by_conversation[conv]
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        members += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, members in by_conversation.items():
        members.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], sha256(m[2].encode()).hexdigest()))
        letters, initials, seen = "", "", set()
        for turn, role, text in members:
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            rest = text.rstrip(SPACES)
            if not rest:
                letters += "b"
            elif (role, text) in seen:
                letters += "d"
            else:
                letters += initial if rest[-1] in ".!?" else initial.upper()
            seen.add((role, text))
            initials += initial
        cost, edits = repair.repair(letters)
        assert (cost, _initials(edits)) == _cheapest(letters)
        lines = []
        for e, i in _steps(edits):
            if e == "K":
                lines.append(f"{members[i][1]}:{members[i][2]}")
            elif e != "D":
                role = {"u": "user", "a": "assistant"}[e.lower()]
                lines.append(f"{role}:{members[i][2] if e.isupper() else ''}")
        turns = [m[0] for m in members if m[0] is not None]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            letters.count("b"), letters.count("d"), sum(map(str.isupper, letters)),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, _initials(edits), sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def _rows(kind: str) -> list[tuple]:
    rng = random.Random(9)
    rows = []
    for conv in range(60):
        roles = (["system"] if rng.random() < 0.3 else []) + ["user", "assistant"] * rng.randint(0, 5)
        for turn, role in enumerate(roles):
            text = rng.choice(["Yes.", "So it is!", "no end", "Why?  \n", " \t", "Über. ", f"Turn {turn} of {conv}."])
            if rng.random() < 0.1:
                role = rng.choice(["tool", "", None, "User", "assistant"])
            rows.append((conv, turn + 3 * (rng.random() < 0.1), role, None if rng.random() < 0.03 else text))
    if kind == "hot":
        return rows + [(7, t, "user" if t % 2 else "assistant", rng.choice(["Yes.", f"{t} is here."])) for t in range(900)]
    if kind == "awkward":
        rows += rows[:30] + rows[:5] * 3 + [(None, t, "user", "Hm.") for t in (None, None, 0, 2)]
        rows += [(200, None, None, None), (201, 5, "user", "x" * 30_000 + ".")]
        # Conversations of one row that the damage drops.
        rows += [(c, 0, "user", "Gone.") for c in range(300, 340) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    return rows if kind != "empty" else []


@pytest.mark.parametrize("kind, bits", [("awkward", 12), ("awkward", 1), ("hot", 4), ("empty", 12)])
def test_query_equals_rows_in_python(spark, tmp_path, monkeypatch, kind, bits):
    monkeypatch.setattr(repair, "CHUNK_BITS", bits)
    rows = _rows(kind)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    clash = [F.lit(1).alias(c) for c in ("place", "DIGEST", "chunk", "edits", "kind", "cost", "_conv_id")]
    frame.select("*", *clash).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = repair.op11_conversation_repair(spark, str(tmp_path)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == _expected(rows)
    assert len(got) == len({r[0] for r in rows})


def test_query_on_the_given_conversations(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = repair.op11_conversation_repair(spark, folder).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == _expected(rows)
