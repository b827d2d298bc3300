"""Operator 12: conversation structure repair.

A grammar over the initials of roles says what a sound conversation is:
nothing, or an optional system turn and then user and assistant in turn. Each
row is kept, given another role or deleted, and empty turns may be inserted,
each at a price; blank rows and repeats must go, and a row that breaks off
costs one more where it stays. Wanted are the least cost and, among the edits of
that cost, those whose initials (Delete, Insert, Keep, Rerole) come first.

The cost is found by layers in the manner of Wu and Manber: for c = 0, 1, 2, ..
each turn has a bitset of the grammar states from which the rest of the
conversation can be repaired at cost c or less. A layer's set of a turn is made
of those of the next turn and of up to three layers before, by table lookup. The
first layer that holds the start state at the first turn gives the cost. Going
forward from there, each edit is the least letter whose state lies in the layer
that its price leaves; no two edits of one letter lead to different states, so
that is the least audit.

Sets are full within a few layers of being reached, as states of one turn differ
by a few inserts; a layer only visits turns whose sets are neither empty nor
full, so a conversation costs time in proportion to its turns, not to turns
times cost. One conversation is one row, as its digest needs all of its text in
order; roles' initials, faults and digests go to Python, texts stay behind.

Defined cases: null role or text counts as one space; rows are ordered by turn
(nulls first), then role, then text; a null conv_id is a conversation; unknown,
empty or blank roles fit no state and are given another role or deleted; a
conversation without rows has cost 0 and an empty audit; very long texts and
repeated rows count whole; gaps beyond the range of a long are null; an empty
table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, table

RETYPE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
SOUND, GONE, OPEN = 0, 1, 2
#: States: before all turns, after system, after user, after assistant. What each initial leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ACCEPT = 1 << START | 1 << ASSISTANT
FULL = 15


def _before(initial: str) -> list[int]:
    """For each set of states, the set of those that the initial leads into it."""
    return [sum(1 << q for q, to in MOVES.get(initial, {}).items() if states >> to & 1) for states in range(16)]


_BEFORE = {x: _before(x) for x in MOVES}
_OTHER = [u | a for u, a in zip(_BEFORE["u"], _BEFORE["a"])]
_NONE = [0] * 16


def layers(initials: list[str], faults: list[int]) -> tuple[int, array]:
    """The least cost, and for each turn and state (at 4 * turn + state) the first layer that holds it, -1 if none yet."""
    n = len(initials)
    keep = [_BEFORE.get(x, _NONE) for x in initials]
    first = array("q", [-1]) * (4 * (n + 1))
    now, one, two, three = (bytearray(n + 2) for _ in range(4))  # this layer, and those of 1, 2 and 3 less
    low, high, cost = n, n, 0  # turns above high are full in all four, those below low empty
    while True:
        i = high
        while i >= 0:
            found = one[i] | _OTHER[two[i]]
            if i == n:
                found |= ACCEPT
            else:
                found |= three[i + 1]
                if faults[i] == SOUND:
                    found |= keep[i][now[i + 1]] | _OTHER[two[i + 1]]
                elif faults[i] == OPEN:
                    found |= keep[i][one[i + 1]] | _OTHER[three[i + 1]]
            if i < low and not found:
                break
            new = found & ~one[i]
            while new:
                q = (new & -new).bit_length() - 1
                first[4 * i + q] = cost
                new &= new - 1
            now[i] = found
            i -= 1
        low = min(low, i + 1)
        if now[0] >> START & 1:
            return cost, first
        while high >= 0 and three[high] == FULL:
            high -= 1
        now, one, two, three = three, now, one, two
        cost += 1


def least_audit(initials: list[str], faults: list[int]) -> tuple[int, str, list[tuple[int, str | None]]]:
    """(cost, audit, result); result: (row, or -1 for an inserted turn; its new role, if it has one)."""
    cost, first = layers(initials, faults)
    n, i, state, left, audit, result = len(initials), 0, START, cost, [], []

    def open_to(turn: int, q: int | None, price: int) -> bool:
        return q is not None and left >= price and 0 <= first[4 * turn + q] <= left - price

    while i < n or left:
        other = "a" if state == USER else "u"
        named, to = {"u": "user", "a": "assistant"}[other], MOVES[other][state]
        more = CUT_OFF if i < n and faults[i] == OPEN else 0
        if i < n and open_to(i + 1, state, DELETE):
            audit.append("D")
            i, left = i + 1, left - DELETE
        elif open_to(i, to, INSERT):
            audit.append("I")
            result.append((-1, named))
            state, left = to, left - INSERT
        elif faults[i] != GONE and open_to(i + 1, kept := MOVES.get(initials[i], {}).get(state), more):
            audit.append("K")
            result.append((i, None))
            i, state, left = i + 1, kept, left - more
        else:
            audit.append("R")
            result.append((i, named))
            i, state, left = i + 1, to, left - RETYPE - more
    return cost, "".join(audit), result


_FOUND = pa.struct([("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("result", pa.list_(pa.struct([("at", pa.int32()), ("role", pa.string())])))])
FOUND = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, result array<struct<at: int, role: string>>"
LEGAL = {"su", "ua", "au"}


def mended(turns: list[dict]) -> dict:
    """The counts, the cost and the edits of one conversation. turns: (initial, blank, open, digest) in order."""
    seen, faults, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for t in turns:
        fault = "blank" if t["blank"] else "duplicate" if t["digest"] in seen else "truncated" if t["open"] else None
        seen.add(t["digest"])
        faults.append(SOUND if fault is None else OPEN if fault == "truncated" else GONE)
        if fault:
            counts[fault] += 1
    initials = [t["initial"] for t in turns]
    cost, audit, result = least_audit(initials, faults)
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    return counts | {"illegal": illegal, "cost": cost, "audit": audit, "result": [{"at": at, "role": role} for at, role in result]}


def mending(turns: Column) -> Column:
    @F.arrow_udf(FOUND)
    def mend(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for chats in batches:
            yield pa.array((mended(x.as_py() or []) for x in chats), _FOUND)

    return mend(turns)


def repaired(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, the counts of faults, cost, audit, and turns, the repaired (role, text) in order.

    rows: (conv_id, turn, role, text); copies: how often each row stands in its conversation, 0 for not at all.
    """
    role, text = (F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text"))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), role, text, (F.lit(1) if copies is None else copies).cast("int").alias("copies"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("own"))
    chats = chats.withColumn("own", F.flatten(F.transform("own", lambda t: F.array_repeat(t, t["copies"]))))
    shown = F.filter("own.turn", lambda t: t.isNotNull())
    spaces = F.lit(" \t\n\u000b\f\r")

    def facts(t: Column) -> Column:
        last = F.substring(F.rtrim(t["text"], spaces), -1, 1)
        digest = F.md5(F.concat(F.length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"]))
        return F.struct(F.substring(t["role"], 1, 1).alias("initial"), (~t["text"].rlike(f"[^{SPACE}]")).alias("blank"), (~last.isin(".", "!", "?")).alias("open"), digest.alias("digest"))

    chats = chats.withColumn("shown", shown).withColumn("found", mending(F.transform("own", facts)))
    span = F.try_subtract(F.array_max("shown"), F.array_min("shown"))
    gaps = F.when(F.size("shown") == 0, F.lit(0).cast("long")).otherwise(F.try_add(span, F.lit(1).cast("long") - F.size(F.array_distinct("shown"))))

    def said(x: Column) -> Column:
        own = F.get("own", x["at"])
        return F.struct(F.coalesce(x["role"], own["role"]).alias("role"), F.coalesce(own["text"], F.lit("")).alias("text"))

    counts = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return chats.select("conv_id", gaps.alias("gaps"), *[F.col(f"found.{c}") for c in counts], F.transform("found.result", said).alias("turns"))


def damage(rows: DataFrame) -> tuple[DataFrame, Column]:
    """rows with some texts and roles changed, and how often each row stands there: fixed by the CRC-32 of conversation and turn."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    hit = F.crc32(F.encode(key, "UTF-8")) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    out = rows.select("conv_id", "turn", F.when(hit == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("copies"))
    return out, F.col("copies")


def op12_cost_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, copies = damage(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    out = repaired(rows, copies)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(whole, 256).alias("repaired_sha256"))
