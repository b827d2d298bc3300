"""Operator 2: chat formatting.

A declarative template names the markers of a turn, the roles whose text bears
loss, and the transitions that a finite-state machine over the roles allows.
A conversation becomes segments of (text, loss): the header and the end of each
turn without loss, its text with the loss flag of its role. The formatted
string is the segments in order.

Control strings inside roles and texts are escaped, so markers occur only where
a turn begins or ends: ESCAPE itself becomes ESCAPE 0, and the first character
of a control string becomes ESCAPE 1 or ESCAPE 2. `read_back` reverses it.

Defined cases: null role or text counts as empty; turns are ordered by turn
(nulls first), then role, then text; repeated rows are turns of their own; a
null conv_id is a conversation; unknown roles are formatted and make the order
invalid; an empty table gives an empty result; other columns are not read. One
conversation is one row, as its digest needs all of its text in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ESCAPE = "␛"
TEMPLATE = {
    "begin": "[TURN]",
    "after_role": "[/TURN]",
    "end": "</s>",
    "control": {r"\[(/?(?:TURN|INST)\])": ("[", "1"), r"<(/?s>)": ("<", "2")},
    "loss_roles": ["assistant"],
    "start": "start",
    "transitions": {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "accept": ["assistant"],
}


def escaped(text: Column, template: dict = TEMPLATE) -> Column:
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    for pattern, (_, code) in template["control"].items():
        out = F.regexp_replace(out, pattern, f"{ESCAPE}{code}$1")
    return out


def unescaped(text: Column, template: dict = TEMPLATE) -> Column:
    for first, code in template["control"].values():
        text = F.replace(text, F.lit(ESCAPE + code), F.lit(first))
    return F.replace(text, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def valid_order(roles: Column, template: dict = TEMPLATE) -> Column:
    """Whether the roles, in order, lead from the start to an accepting state; a state is the last role."""
    moves = [f"{a}\n{b}" for a, to in template["transitions"].items() for b in to]
    end = F.aggregate(roles, F.lit(template["start"]), lambda s, r: F.when(F.concat(s, F.lit("\n"), r).isin(moves), r).otherwise(F.lit("\nbad")))
    return end.isin(template["accept"])


def format_chats(rows: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, segments, formatted, valid_order. rows: (conv_id, turn, role, text)."""
    empty = F.lit("")
    turns = F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turns)).alias("turns"))

    def segments(t: Column) -> Column:
        def part(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        return F.array(
            part(F.concat(F.lit(template["begin"]), escaped(t["role"], template), F.lit(template["after_role"])), F.lit(False)),
            part(escaped(t["text"], template), t["role"].isin(template["loss_roles"])),
            part(F.lit(template["end"]), F.lit(False)),
        )

    chats = chats.withColumn("segments", F.flatten(F.transform("turns", segments)))
    chats = chats.withColumn("formatted", F.array_join(F.col("segments.text"), ""))
    return chats.select("conv_id", "segments", "formatted", valid_order(F.col("turns.role"), template).alias("valid_order"))


def read_back(chats: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """chats with turns, parsed from the formatted string, and loss_texts, from the segments under the loss mask."""
    sep = template["after_role"]
    pieces = F.split("formatted", template["end"].replace("/", "\\/"))
    chats = chats.withColumn("__pieces", F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))))

    def turn(p: Column) -> Column:
        body = F.substring(p, len(template["begin"]) + 1, 2147483647)
        at = F.instr(body, sep)
        return F.struct(unescaped(F.substring(body, F.lit(1), at - 1), template).alias("role"), unescaped(F.substring(body, at + len(sep), F.lit(2147483647)), template).alias("text"))

    return chats.withColumns(
        {
            "turns": F.transform("__pieces", turn),
            "loss_texts": F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], template)),
        }
    ).drop("__pieces")


def op2_chat_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    back = read_back(format_chats(rows))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = back.withColumn("__loss", F.array_join("loss_texts", ""))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2("__loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid_order",
    )


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after,
         length(regexp_replace(regexp_replace(replace(role, chr(9243), chr(9243) || '0'), '\[(/?(TURN|INST)\])', chr(9243) || '1\1', 'g'), '<(/?s>)', chr(9243) || '2\1', 'g'))
         + length(regexp_replace(regexp_replace(replace(text, chr(9243), chr(9243) || '0'), '\[(/?(TURN|INST)\])', chr(9243) || '1\1', 'g'), '<(/?s>)', chr(9243) || '2\1', 'g'))
         + 17 AS chars
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars,
       bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user')
                     WHEN before = 'system' THEN role = 'user'
                     WHEN before = 'user' THEN role = 'assistant'
                     WHEN before = 'assistant' THEN role = 'user' ELSE false END
                AND (after IS NOT NULL OR role = 'assistant')) AS valid_order
FROM e GROUP BY conv_id
"""
