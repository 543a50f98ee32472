"""Cheapest repair of conversations whose turns are missing, empty, repeated, cut off or out of role.

A repaired conversation's roles are nothing, or an optional system turn and pairs of user and
assistant. Every row is kept (0), given the role that is due (2) or deleted (3), which blank rows
and repeats must be; a row cut off costs 1 if it stays, and an empty turn of the due role may be
inserted anywhere (2). Of the cheapest repairs the one whose edits (Delete, Insert, Keep, Rerole)
come first in ASCII is taken.

Four states tell which role is due. Backward vectors give the cost of the rest from each state; they
are stored at every square root of the rows only, and a block's vectors are computed again while the
walk forward takes, at each row, the least edit that keeps the cost. Rows count as one letter each
there, texts stay where they are. A conversation of any length is cut into chunks of at most 4096
rows, in order: the cost from state to state over a chunk is a matrix of 16 numbers, the matrices
of a conversation give the vector behind each chunk, each chunk is walked from its possible states,
and the conversation picks the walks that fit together. So one conversation may hold any share of
all rows: a task sorts, walks or holds chunks, and per conversation only its matrices meet.

Null roles and texts are one blank. Rows are ordered by turn (null first), then role and the digest of
the text; equal rows are interchangeable, and the first is no duplicate. Two texts are equal when
their SHA-256 is. Null ids are one conversation. An empty table gives an empty result, other columns
do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

# States: nothing yet; a system turn; a user turn; a whole pair. The role that is due, and where it leads.
DUE = ("u", "u", "a", "u")
TO = (2, 2, 3, 2)
STATES = range(4)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: What inserting still costs behind the last row, and the turns it takes.
END = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "ua", "a", "")
NEVER = 1 << 60
#: Rows of a chunk, as a power of two.
CHUNK_BITS = 12
ROLES = {"u": "user", "a": "assistant"}
#: One letter a row: blank, duplicate, or the initial of its role (o: another), a capital where cut off.
BLANK, DUPLICATE = "b", "d"

Vector = tuple[int, int, int, int]


def _choices(letter: str) -> list[list[tuple[str, int, int]]]:
    """For each state the edits of a row, but for inserting, as (letter, cost, next state) in ASCII order."""
    out = []
    for q in STATES:
        edits = [("D", DELETE, q)]
        if letter not in (BLANK, DUPLICATE):
            own, extra = letter.lower(), CUT_OFF * letter.isupper()
            if own == DUE[q]:
                edits.append(("K", KEEP + extra, TO[q]))
            elif q == 0 and own == "s":
                edits.append(("K", KEEP + extra, 1))
            # An inserted or re-roled turn is written as its role, small when inserted.
            edits.append((DUE[q].upper(), REROLE + extra, TO[q]))
        out.append(edits)
    return out


CHOICES = {letter: _choices(letter) for letter in BLANK + DUPLICATE + "suaoSUAO"}


def before(letter: str, after: Vector) -> Vector:
    """The vector in front of a row, turns inserted there included, from the one behind it."""
    v = [min([cost + after[to] for _, cost, to in edits]) for edits in CHOICES[letter]]
    user, pair = v[2], v[3]
    user, pair = min(user, pair + INSERT), min(pair, user + INSERT)
    return min(v[0], user + INSERT), min(v[1], user + INSERT), user, pair


def matrix(letters: str) -> list[int]:
    """Least cost over a chunk from each state to each state, by rows."""
    columns = [tuple(0 if q == to else NEVER for q in STATES) for to in STATES]
    for letter in reversed(letters):
        columns = [before(letter, v) for v in columns]
    return [min(columns[to][q], NEVER) for q in STATES for to in STATES]


def through(chunk: list[int], after: Vector) -> Vector:
    """The vector in front of a chunk from the one behind it."""
    return tuple(min(chunk[4 * q + to] + after[to] for to in STATES) for q in STATES)


class Checkpoints:
    """The vectors of a chunk, stored at every square root of its rows."""

    def __init__(self, letters: str, end: Vector):
        self.letters, self.block = letters, isqrt(len(letters)) + 1
        self.marks = {len(letters): end}
        v = end
        for i in range(len(letters) - 1, -1, -1):
            v = before(letters[i], v)
            if i % self.block == 0:
                self.marks[i] = v

    def vectors(self, start: int) -> list[Vector]:
        """Those of one block, the one behind it last."""
        stop = min(start + self.block, len(self.letters))
        out = [self.marks[stop]]
        for letter in reversed(self.letters[start:stop]):
            out.append(before(letter, out[-1]))
        return out[::-1]

    def walk(self, state: int) -> tuple[str, int]:
        """The least edits of least cost from a state, and the state behind the chunk."""
        out, q = [], state
        for start in range(0, len(self.letters), self.block):
            vectors = self.vectors(start)
            for i, letter in enumerate(self.letters[start : start + self.block]):
                here, after = vectors[i], vectors[i + 1]
                while True:
                    tight = [(e, to) for e, cost, to in CHOICES[letter][q] if cost + after[to] == here[q]]
                    if tight and tight[0][0] == "D" or INSERT + here[TO[q]] != here[q]:
                        edit, q = tight[0]
                        out.append(edit)
                        break
                    out.append(DUE[q])
                    q = TO[q]
        return "".join(out), q


def repair(letters: str) -> tuple[int, str]:
    """Cost and edits of a conversation in one piece."""
    points = Checkpoints(letters, END)
    edits, q = points.walk(0)
    return points.marks[0][0], edits + TAIL[q]


def audit(edits: Column) -> Column:
    """Edits by their initials."""
    return F.translate(edits, "uaUA", "IIRR")


# --- the same over tables ---

def _rowwise(df: DataFrame, each: Callable[[dict], dict], **kinds: tuple[str, pa.DataType]) -> DataFrame:
    """``df`` with columns that ``each`` gives of a row, as name=(Spark type, Arrow type)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [each(row) for row in part.to_pylist()]
                added = [pa.array([m[name] for m in made], kind) for name, (_, kind) in kinds.items()]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], [*part.schema.names, *kinds])

    old = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    new = [f"`{name}` {kind}" for name, (kind, _) in kinds.items()]
    return df.mapInArrow(run, ", ".join(old + new))


LONGS = ("array<long>", pa.list_(pa.int64()))
TEXTS = ("array<string>", pa.list_(pa.string()))
ONE_LONG = ("long", pa.int64())


def _stripped(text: Column) -> Column:
    """Without white space at the end."""
    return F.rtrim(text, F.lit(common.SPACES))


def ordered(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest and ``place``, which numbers rows in the order of conversations.

    The sort's ranges split a conversation of any size, and equal rows by where they come from.
    """
    rows = messages.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    ).select("*", F.sha2("text", 256).alias("digest"), F.monotonically_increasing_id().alias("tie"))
    sorted_ = rows.orderBy("conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "tie")
    return common.saved(sorted_.drop("tie").withColumn("place", F.monotonically_increasing_id()), "conversation-rows")


def chunks(lines: DataFrame) -> DataFrame:
    """Rows of a conversation as letters, 4096 at most together: conv_id, chunk, start, letters, initials."""
    firsts = lines.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place"))
    end = F.right(_stripped(F.col("text")), F.lit(1))
    initial = F.left("role", F.lit(1))
    small = lines.select(
        "conv_id", "place", (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut_off"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
    )
    judged = small.join(firsts.select("place", F.lit(True).alias("first")), "place", "left")
    letter = (
        F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE)
        .when(F.col("cut_off"), F.upper("initial")).otherwise(F.col("initial"))
    )
    row = F.struct("place", letter.alias("letter"), "initial")
    grouped = judged.groupBy("conv_id", F.shiftright("place", CHUNK_BITS).alias("chunk")).agg(
        F.sort_array(F.collect_list(row)).alias("rows")
    )
    return grouped.select(
        "conv_id", "chunk", F.col("rows")[0]["place"].alias("start"),
        F.concat_ws("", F.col("rows.letter")).alias("letters"), F.concat_ws("", F.col("rows.initial")).alias("initials"),
    )


LEGAL = {"su", "ua", "au"}


def _illegal(initials: str) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _measured(row: dict) -> dict:
    letters, initials = row["letters"], row["initials"]
    return {
        "matrix": matrix(letters), "ends": initials[0] + initials[-1],
        "counts": [letters.count(BLANK), letters.count(DUPLICATE), sum(map(str.isupper, letters)), _illegal(initials)],
    }


def _scanned(row: dict) -> dict:
    """The vectors behind a conversation's chunks, its cost and its counts."""
    parts, v, behind = row["parts"], END, []
    for part in reversed(parts):
        behind.append(list(v))
        v = through(part["matrix"], v)
    counts = [sum(c) for c in zip(*(p["counts"] for p in parts))]
    counts[3] += sum(a["ends"][1] + b["ends"][0] not in LEGAL for a, b in zip(parts, parts[1:]))
    return {"behind": behind[::-1], "cost": v[0], "total": counts}


def _walked(row: dict) -> dict:
    """The edits of a chunk from each state it may be entered in; the first of a conversation only from none."""
    points = Checkpoints(row["letters"], tuple(row["behind"]))
    walks = [points.walk(q) for q in (STATES if row["nth"] else (0,))]
    return {"edits": [w[0] for w in walks], "leaves": [w[1] for w in walks]}


def _entered(row: dict) -> dict:
    q, states = 0, []
    for part in row["parts"]:
        states.append(q)
        q = part["leaves"][q]
    return {"states": states, "tail": TAIL[q]}


def _by_conversation(rows: DataFrame, *columns: str) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("chunk", *columns))).alias("parts")
    return rows.groupBy("conv_id").agg(parts)


def _with(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Both by conversation and chunk; null ids meet."""
    named = other.withColumnsRenamed({"conv_id": "_conv_id", "chunk": "_chunk"})
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("chunk") == F.col("_chunk"))
    return rows.join(named, same).drop("_conv_id", "_chunk")


def edited(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with the edits of their rows (conv_id, chunk, start, edits), and a row for each conversation:
    cost and the counts of blank, duplicate and cut off rows and of illegal neighbours."""
    cut = common.saved(
        _rowwise(chunks(lines), _measured, matrix=LONGS, ends=("string", pa.string()), counts=LONGS), "chunks"
    )
    scanned = common.saved(
        _rowwise(
            _by_conversation(cut, "matrix", "ends", "counts"), _scanned,
            behind=("array<array<long>>", pa.list_(pa.list_(pa.int64()))), cost=ONE_LONG, total=LONGS,
        ),
        "conversation-costs",
    )
    vectors = scanned.select("conv_id", F.posexplode(F.arrays_zip(F.col("parts.chunk").alias("chunk"), "behind"))).select(
        "conv_id", F.col("col.chunk").alias("chunk"), F.col("col.behind").alias("behind"), F.col("pos").alias("nth")
    )
    walked = common.saved(
        _rowwise(
            _with(cut.select("conv_id", "chunk", "start", "letters"), vectors), _walked, edits=TEXTS, leaves=LONGS
        ),
        "chunk-walks",
    )
    entered = _rowwise(_by_conversation(walked, "leaves"), _entered, states=LONGS, tail=("string", pa.string()))
    count = F.size("states") - 1
    entries = entered.select(
        "conv_id", "tail", count.alias("last"), F.posexplode(F.arrays_zip(F.col("parts.chunk").alias("chunk"), "states"))
    ).select(
        "conv_id", F.col("col.chunk").alias("chunk"), F.col("col.states").cast("int").alias("state"),
        F.when(F.col("pos") == F.col("last"), F.col("tail")).otherwise("").alias("tail"),
    )
    taken = _with(walked.select("conv_id", "chunk", "start", "edits"), entries).select(
        "conv_id", "chunk", "start", F.concat(F.col("edits")[F.col("state")], "tail").alias("edits")
    )
    names = ("blank", "duplicate", "truncated", "illegal")
    costs = scanned.select("conv_id", "cost", *[F.col("total")[i].alias(n) for i, n in enumerate(names)])
    return common.saved(taken, "chunk-edits"), costs


def repaired(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """The turns of repaired conversations: conv_id, place, step (order within a place), role, text."""
    one = F.regexp_extract_all("edits", F.lit("([ua]*[DKUA](?:[ua]+$)?)"), F.lit(1))
    by_row = edits.select("start", F.posexplode(one)).select(
        (F.col("start") + F.col("pos")).alias("place"), F.split("col", "").alias("edits")
    )
    turns = lines.select("conv_id", "place", "role", "text").join(by_row, "place").select(
        "conv_id", "place", "role", "text", F.posexplode("edits").alias("step", "edit")
    ).where(F.col("edit").isin(*"KUAua"))
    role = F.col("role")
    for letter, name in ROLES.items():
        role = F.when(F.lower("edit") == letter, F.lit(name)).otherwise(role)
    text = F.when(F.col("edit").isin(*ROLES), F.lit("")).otherwise(F.col("text"))
    return turns.select("conv_id", "place", "step", role.alias("role"), text.alias("text"))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its turns, read in order; a task holds a batch of rows, never a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hasher, kind = None, None, None

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([now], kind), pa.array([hasher.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"]
            )

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, line in zip(*(c.to_pylist() for c in batch.columns)):
                if hasher is None or conv != now:
                    if hasher is not None:
                        yield row()
                    now, hasher = conv, sha256(line.encode())
                else:
                    hasher.update(b"\n")
                    hasher.update(line.encode())
        if hasher is not None:
            yield row()

    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step")
    return rows.select("conv_id", F.concat("role", F.lit(":"), "text").alias("line")).mapInArrow(
        run, f"conv_id {kind}, repaired_sha256 string"
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the contract's damage, decided by their conversation and turn."""
    blank = F.lit(" ")
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")
    )
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    rows = rows.withColumn("kind", F.crc32(name.cast("binary")) % 20).where("kind != 0")
    text = (
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.explode(times).alias("copy"),
    ).drop("copy")


def gaps(rows: DataFrame) -> DataFrame:
    """conv_id and the turns missing between its first and last."""
    turns = rows.groupBy("conv_id", "turn").agg(F.lit(1)).groupBy("conv_id")
    return turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    lines = ordered(damaged(conversations))
    edits, costs = edited(lines)
    out = conversations.select("conv_id").distinct()
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("chunk", "edits"))), lambda x: x["edits"])
    audits = edits.groupBy("conv_id").agg(audit(F.concat_ws("", pieces)).alias("audit"))
    for part in (gaps(lines), costs, audits, digests(repaired(lines, edits))):
        part = part.withColumnRenamed("conv_id", "_conv_id")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left").drop("_conv_id")
    zeros = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zeros],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
