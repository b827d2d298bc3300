"""Chunks along the tree of a text, against a recursive twin."""

import random
import re

import pytest

from siltstone.operators import chunks
from siltstone.plans import QUERIES


def words(s):
    return len([w for w in re.split(r"[\x20\t\n\r\f\v]+", s) if w])


def slow_line(line, budget):
    """Sentences merged in order; those beyond the budget in runs of words."""
    out, held = [], ""
    for sentence in re.findall(r"(?s).+?(?:[.!?]+[\x20\t\n\r\f\v]+|$)", line):
        if held and words(held + sentence) > budget:
            out.append(held)
            held = ""
        if words(sentence) <= budget:
            held += sentence
        else:
            run = ""
            for part in re.findall(r"[\x20\t\n\r\f\v]*[^\x20\t\n\r\f\v]+|[\x20\t\n\r\f\v]+$", sentence):
                gap = re.match(r"[\x20\t\n\r\f\v]*", part).group()
                if words(run) == budget and part != gap:
                    out.append(run + gap)
                    run = part[len(gap) :]
                else:
                    run += part
            out.append(run)
    return out + [held] if held else out


def slow(text, budget):
    lines = re.findall(r"[^\n]*\n(?:[ \t\r\f\v]*\n)*|[^\n]+$", text)
    depth, opened = [], 0
    for line in lines:
        body = line.lstrip(" \t")
        closing = len(body) - len(body.lstrip(")]}"))
        depth.append((max(0, opened - closing), len(line[: len(line) - len(body)].expandtabs(4))))
        for c in line:
            opened = max(0, opened + (c in "([{") - (c in ")]}"))

    def grouped(lo, hi, head=None):
        members = [] if head is None else [(head, head + 1)]
        while lo < hi:
            end = next((j for j in range(lo + 1, hi) if depth[j] <= depth[lo]), hi)
            members.append((lo, end))
            lo = end
        out, held = [], ""
        for a, b in members:
            own = "".join(lines[a:b])
            if words(own) <= budget:
                if words(held) + words(own) > budget:
                    out.append(held)
                    held = ""
                held += own
                continue
            if held:
                out.append(held)
            held = ""
            out += slow_line(own, budget) if b == a + 1 else grouped(a + 1, b, a)
        return out + [held] if held else out

    return grouped(0, len(lines))


def nested(seed):
    r = random.Random(seed)
    out, level = [], 0
    for _ in range(r.randrange(1, 60)):
        level = max(0, level + r.choice([-2, -1, 0, 0, 1]))
        body = "".join(f"{r.choice(['alpha', 'b', 'gamma(x)', '[y', 'z]', '{', '}', 'end.', 'why?', 'é😀'])}{r.choice([' ', ' ', '  '])}" for _ in range(r.randrange(0, 14)))
        out.append("  " * level + r.choice(["", "}", "\t"]) + body + r.choice(["\n", "\n", "\n\n", " \n"]))
    return "".join(out)[: r.choice([10**9, 200])]


def cut(text, budget):
    spans = list(chunks.tree_spans(text, budget))
    assert all(words(text[s : s + n]) == w <= budget for s, n, w in spans)
    return [text[s : s + n] for s, n, _ in spans]


@pytest.mark.parametrize("budget", [1, 3, 8, 20, 1000])
def test_chunks_by_a_recursive_twin(budget):
    for seed in range(300):
        text = nested(seed)
        got = cut(text, budget)
        assert "".join(got) == text and got == slow(text, budget), seed


def test_nodes_stay_whole():
    text = "def a():\n  one two\n  three four\ndef b():\n  five six\n  if seven:\n    eight nine ten\n    eleven twelve\n"
    assert cut(text, 8) == ["def a():\n  one two\n  three four\n", "def b():\n  five six\n", "  if seven:\n    eight nine ten\n    eleven twelve\n"]
    assert cut("x = [\n1 2 3\n4 5 6\n]\ny = 2\n", 9) == ["x = [\n1 2 3\n4 5 6\n", "]\ny = 2\n"]


def test_deep_nesting_and_very_long_texts():
    deep = "".join("(" * 3 + " word\n" for _ in range(30_000))
    assert "".join(cut(deep, 50)) == deep
    long = "a b " * 200_000
    assert [words(x) for x in cut(long, 512)] == [512] * 781 + [400_000 - 512 * 781]


def test_rows(spark, tmp_path):
    rows = [(1, None, 7), (2, "", 7), (3, " \n\t\n", 7), (4, "one", 7), (None, "a b c d. e f", 7), (5, "x y\nz", 7), (5, "x y\nz", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk int")
    got = sorted((tuple(r) for r in chunks.tree_chunks(df, "doc_id", "text", 4).collect()), key=str)
    want = [(3, 0, 0, 4, 0), (4, 0, 0, 3, 1), (None, 0, 0, 9, 4), (None, 1, 9, 3, 2), (5, 0, 0, 5, 3), (5, 0, 0, 5, 3)]
    assert got == sorted(want, key=str)
    assert chunks.tree_chunks(df.limit(0), "doc_id", "text").count() == 0
    assert chunks.tree_chunks(df.select(df.doc_id.cast("string"), "text"), "doc_id", "text").schema["doc_id"].dataType.simpleString() == "string"


def test_query_by_the_twin(spark):
    d = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
        at = 0
        for n, piece in enumerate(slow(r.text or "", 512)):
            want.append((r.doc_id, n, at, len(piece), words(piece)))
            at += len(piece)
    got = [tuple(r) for r in QUERIES["tree_chunks"](spark, d).collect()]
    assert sorted(got) == sorted(want) and len(got) > 100
