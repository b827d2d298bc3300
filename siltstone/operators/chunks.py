"""Chunks along the tree that indentation and brackets give a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: A line with the blank lines behind it.
_LINE = re.compile(r"[^\n]*\n(?:[\x20\t\r\f\v]*\n)*|[^\n]+$")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SENTENCE = re.compile(r".+?(?:[.!?]+[\x20\x09-\x0D]+|$)", re.DOTALL)
_BRACKET = re.compile(r"[(\[{]|[)\]}]")
_LEADING = re.compile(r"([\x20\t]*)([)\]}]*)")
TAB = 4


def depths(lines: list[str]) -> list[tuple[int, int]]:
    """(open brackets, indentation) of each line; brackets that a line begins by closing are no longer open in it."""
    out, opened = [], 0
    for line in lines:
        space, closing = _LEADING.match(line).groups()
        out.append((max(0, opened - len(closing)), len(space.expandtabs(TAB))))
        for b in _BRACKET.findall(line):
            opened = opened + 1 if b in "([{" else max(0, opened - 1)
    return out


def node_ends(depth: list[tuple[int, int]]) -> list[int]:
    """For each line the end of its node: of the deeper lines that follow it."""
    ends, above = [len(depth)] * len(depth), []
    for i, d in enumerate(depth):
        while above and depth[above[-1]] >= d:
            ends[above.pop()] = i
        above.append(i)
    return ends


def pieces(line: str, budget: int) -> Iterator[tuple[int, int]]:
    """(characters, words) of the parts of one line beyond the budget: sentences, merged where they fit; runs of words in a longer sentence."""
    chars = held = 0
    for m in _SENTENCE.finditer(line):
        sentence = m.group()
        n = len(_WORD.findall(sentence))
        if held + n > budget and chars:
            yield chars, held
            chars = held = 0
        if n <= budget:
            chars, held = chars + len(sentence), held + n
            continue
        starts = [w.start() for w in _WORD.finditer(sentence)][::budget][1:]
        edges = [0, *starts, len(sentence)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            yield b - a, min(budget, n - k * budget)
    if chars:
        yield chars, held


def tree_spans(text: str, budget: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, words) of the chunks of a text, in order and without gaps.

    A node of at most `budget` words stays whole; a larger one is split into its
    first line and the nodes below. Siblings are merged while they fit. Nodes are
    kept on a stack, so that nesting may have any depth, and each line is looked at once.
    """
    lines = _LINE.findall(text)
    ends = node_ends(depths(lines))
    words, chars = [0], [0]
    for line in lines:
        words.append(words[-1] + len(_WORD.findall(line)))
        chars.append(chars[-1] + len(line))
    first = last = 0  # lines of the chunk that is being merged
    frames = [(0, len(lines))]
    while frames:
        at, end = frames.pop()
        while at < end:
            below = ends[at]
            split = words[below] - words[at] > budget and below > at + 1
            if split:  # its first line, then what is below
                frames += [(below, end), (at + 1, below)]
                below = at + 1
            if split or words[below] - words[first] > budget:
                if last > first:
                    yield chars[first], chars[last] - chars[first], words[last] - words[first]
                first = at
            last = below
            if words[below] - words[at] > budget:  # a single line
                start = chars[at]
                for n, w in pieces(lines[at], budget):
                    yield start, n, w
                    start += n
                first = last = below
            if split:
                break
            at = below
        else:
            if last > first:
                yield chars[first], chars[last] - chars[first], words[last] - words[first]
            first = last = end


def tree_chunks(df: DataFrame, key: str, text: str, budget: int = 512) -> DataFrame:
    """(key, chunk, start, length, n_words): whole texts in chunks of at most `budget` words, cut where their tree allows.

    Null and empty texts have no chunk; a text of white space alone is one chunk
    without words. Starts and lengths count code points; a null key stays null.
    """
    key_type = df.schema[key].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                rows = [(i, n, *span) for i, t in enumerate(part.column(1).to_pylist()) for n, span in enumerate(tree_spans(t or "", budget))]
                at, *columns = zip(*rows) if rows else ([], [], [], [], [])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]], names=[key, "chunk", "start", "length", "n_words"])

    return df.select(key, text).mapInArrow(batches, f"`{key}` {key_type}, chunk long, start long, length long, n_words long")
