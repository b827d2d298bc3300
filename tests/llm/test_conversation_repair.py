"""Least repairs: against a shortest-path search over (cost, audit), and the query against plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import pyarrow.parquet as pq

from siltstone.llm import conversation_repair as C

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, copies string, own string"
STEPS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def shortest(initials, faults):
    """(cost, audit, (row, role) of the result), by Dijkstra's search in order of (cost, audit)."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, q, out = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(initials) and q in (0, 3):
            return cost, audit, list(out)
        for r, to in STEPS[q].items():
            if r != "s":
                name = {"u": "user", "a": "assistant"}[r]
                heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*out, (-1, name))))
                if i < len(initials) and faults[i] != C.GONE:
                    heapq.heappush(heap, (cost + 2 + (faults[i] == C.OPEN), audit + "R", i + 1, to, (*out, (i, name))))
        if i < len(initials):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q, out))
            if faults[i] != C.GONE and initials[i] in STEPS[q]:
                heapq.heappush(heap, (cost + (faults[i] == C.OPEN), audit + "K", i + 1, STEPS[q][initials[i]], (*out, (i, None))))


def test_layers_find_the_least_audit():
    r = random.Random(7)
    for _ in range(3000):
        n = r.randrange(10)
        initials, faults = [r.choice("suuaaat") for _ in range(n)], [r.choice([C.SOUND] * 3 + [C.GONE, C.OPEN]) for _ in range(n)]
        assert C.least_audit(initials, faults) == shortest(initials, faults)


def test_long_conversation_in_linear_time():
    r = random.Random(8)
    n = 60_000
    initials, faults = [r.choice("uasua") for _ in range(n)], [r.choice([0, 0, 0, 1, 2]) for _ in range(n)]
    cost, audit, result = C.least_audit(initials, faults)
    whole = "".join(initials[i] if role is None else role[0] for i, role in result)
    assert re.fullmatch("(s?(ua)+)?", whole)
    assert len(audit) == audit.count("I") + n
    left = [f for f, e in zip(faults, [e for e in audit if e != "I"]) if e != "D"]
    assert cost == 3 * audit.count("D") + 2 * (audit.count("I") + audit.count("R")) + left.count(C.OPEN) and C.GONE not in left


def brute(rows):
    """The query, in plain Python."""
    chats = {}
    for conv, turn, role, text in rows:
        own = chats.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        own += [((turn is not None, turn), "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = {}
    for conv, own in chats.items():
        own.sort()
        turns = [t for (known, t), _, _ in own if known]
        seen, faults, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            body = text.rstrip(" \t\n\v\f\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append({0: C.GONE, 1: C.GONE, 2: C.OPEN, None: C.SOUND}[fault])
            if fault is not None:
                counts[fault] += 1
        initials = [role[:1] for _, role, _ in own]
        cost, audit, result = shortest(initials, faults)
        said = "\n".join(f"{role or own[i][1]}:{own[i][2] if i >= 0 else ''}" for i, role in result)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


def digests(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_query_by_brute_force(spark):
    rows = pq.read_table(f"{SF}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()
    assert digests(C.op12_cost_layers(spark, SF)) == brute([tuple(r.values()) for r in rows])


def test_odd_rows(spark, tmp_path):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", "", None]), r.choice([None, "", " \n", "Yes.", "Yes. \t", "no", "é!", "?" + "x" * 50_000])) for c in range(40) for t in [None, *range(r.randrange(8)), 3, 3]]
    rows += [(None, None, None, None), (99, 0, "user", "a."), (98, None, "user", "a."), (97, -(2**63), "user", "a."), (97, 2**63 - 1, "user", "b.")]
    df = spark.createDataFrame([(*x, "clash", "clash") for x in rows], SCHEMA)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got, want = digests(C.op12_cost_layers(spark, str(tmp_path))), brute(rows)
    assert got.keys() == want.keys()
    for c, x in want.items():
        assert got[c][1:] == x[1:] and got[c][0] == (x[0] if x[0] < 2**63 else None), c
    assert C.repaired(df.limit(0)).count() == 0


def test_repaired_turns(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "assistant", "How are you?"), (2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in C.repaired(df).collect()}
    assert (got[1].cost, got[1].audit) == (2, "RK") and [tuple(t) for t in got[1].turns] == [("user", "Hello."), ("assistant", "How are you?")]
    assert (got[2].cost, got[2].audit, got[2].truncated) == (3, "D", 1) and got[2].turns == []
