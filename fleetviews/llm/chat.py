"""Chat formatting of typed content parts, by DataFrame functions alone.

A message is a list of parts (type, text, reference, tokens). A visitor turns them, in order, into
one string: text is escaped, every other part becomes the placeholder of its type; the references
and the tokens that placeholders expand to are recorded. A turn is
``<s>[ROLE]role[/ROLE] content</s>``; the loss mask lists the spans of assistant content.

Escaping is reversible: a control string inside a text, after its first character followed by any
number of backslashes, gets one more backslash there. So no text holds a control string, texts
without one are unchanged, and taking one backslash away restores the rest.

Null texts, roles and parts are empty; unknown types are written as documents. Turns are ordered by
turn (null first), then role and text; repeated rows are turns of their own. A null conversation id
is a conversation of its own. An empty table gives an empty result; other columns do not matter. A
conversation is one training example and therefore one row of the result, however long.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Tokens of an attachment that states none.
EXPANDED = {"image": 576, "audio": 250, "document": 1024}
CONTROLS = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", *PLACEHOLDERS.values())
ASSISTANT = "assistant"
PART = "struct<type: string, text: string, ref: string, tokens: bigint>"

# ``(<)(\**)(s>|/s>|...)``, one alternative per first character.
_FORMS = [
    (re.escape(first), "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == first)) for first in ("<", "[")
]


def escaped(text: Column) -> Column:
    for first, rest in _FORMS:
        text = F.regexp_replace(text, rf"({first}\\*)({rest})", r"$1\\$2")
    return text


def unescaped(text: Column) -> Column:
    for first, rest in _FORMS:
        text = F.regexp_replace(text, rf"({first}\\*)\\({rest})", r"$1$2")
    return text


def _visited(part: Column) -> Column:
    """One part as it stands in the content."""
    kind = part["type"]
    mark = F.lit(PLACEHOLDERS["document"])
    for name in ("image", "audio"):
        mark = F.when(kind == name, PLACEHOLDERS[name]).otherwise(mark)
    return F.when(kind == "text", escaped(F.coalesce(part["text"], F.lit("")))).otherwise(mark)


def _tokens(part: Column) -> Column:
    default = F.lit(EXPANDED["document"])
    for name in ("image", "audio"):
        default = F.when(part["type"] == name, EXPANDED[name]).otherwise(default)
    return F.coalesce(part["tokens"], default.cast("long"))


def formatted(messages: DataFrame) -> DataFrame:
    """messages: conv_id, turn, role, parts. Returns conv_id, formatted, loss_mask (start and length in
    code points), attachments (turn, type, ref, tokens) and attachment_tokens."""
    parts = F.filter(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: p["type"].isNotNull())
    others = F.filter("parts", lambda p: p["type"] != "text")
    turns = messages.select(
        F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts")
    ).select(
        "conv_id", "turn", "role",
        F.concat(F.lit("<s>[ROLE]"), escaped(F.col("role")), F.lit("[/ROLE] ")).alias("head"),
        F.concat_ws("", F.transform("parts", _visited)).alias("content"),
        F.transform(
            others,
            lambda p: F.struct(
                F.col("turn").alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens")
            ),
        ).alias("attachments"),
    )
    ends = "</s>"
    length = F.char_length("head") + F.char_length("content") + len(ends)
    earlier = Window.partitionBy("conv_id").orderBy("turn", "role", "content").rowsBetween(
        Window.unboundedPreceding, -1
    )
    turns = turns.withColumn("start", F.coalesce(F.sum(length).over(earlier), F.lit(0)).cast("long"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "content", "start", "head", "attachments")))
    rows = turns.groupBy("conv_id").agg(ordered.alias("turns"))
    learned = F.filter("turns", lambda t: t["role"] == ASSISTANT)
    rows = rows.select(
        "conv_id",
        F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["content"], F.lit(ends)))).alias("formatted"),
        F.transform(
            learned,
            lambda t: F.struct(
                (t["start"] + F.char_length(t["head"])).alias("start"),
                F.char_length(t["content"]).cast("long").alias("length"),
            ),
        ).alias("loss_mask"),
        F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
    )
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda total, a: total + a["tokens"])
    return rows.withColumn("attachment_tokens", tokens)


def parsed(rows: DataFrame) -> DataFrame:
    """``formatted`` read back: conv_id, formatted, turns (role, text) and the text under the loss mask."""
    pieces = F.filter(F.split("formatted", re.escape("</s>")), lambda x: x != "")
    head = len("<s>[ROLE]")
    turns = F.transform(
        pieces,
        lambda x: F.struct(
            unescaped(F.substring_index(F.substr(x, F.lit(head + 1)), "[/ROLE] ", 1)).alias("role"),
            unescaped(F.split(x, re.escape("[/ROLE] "), 2)[1]).alias("text"),
        ),
    )
    # Four bytes a code point, so that a span is found without counting from the start.
    wide = F.encode("formatted", "UTF-32")
    under = F.transform(
        "loss_mask",
        lambda s: unescaped(F.decode(
            F.substring(F.col("wide"), (4 * s["start"] + 1).cast("int"), (4 * s["length"]).cast("int")), "UTF-32"
        )),
    )
    return rows.withColumn("wide", wide).select(
        "conv_id", "formatted", turns.alias("turns"), F.concat_ws("", under).alias("learned")
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(probe).alias("text"),
    )
    part = F.struct(F.lit("text").alias("type"), "text", F.lit(None).cast("string").alias("ref"),
                    F.lit(None).cast("long").alias("tokens"))
    messages = rows.unionByName(added).select("conv_id", "turn", "role", F.array(part).alias("parts"))
    back = parsed(formatted(messages))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", line), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escaped(text: str) -> str:
    for first, rest in _FORMS:
        text = rf"regexp_replace({text}, '({first}\\*)({rest})', '\1\\\2', 'g')"
    return text


OP4_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, length({_sql_escaped('role')}) + length({_sql_escaped('text')}) + {len('<s>[ROLE][/ROLE] </s>')} AS n
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
