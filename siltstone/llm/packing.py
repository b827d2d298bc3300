"""Operator 5: packing into windows by minimum bin slack.

A document's ids are cut at multiples of the window; what remains is a piece
shorter than a window. Only the counts of pieces by length, at most `window` numbers, reach
the driver. There each window starts with the longest piece left, and a bitset
of reachable sums over the other lengths (a big integer, one bit per sum) finds
the multiset that comes closest to the capacity; the counts are read off by
going back through the bitsets. A filling is repeated as often as the counts
allow, so the number of distinct fillings depends on the window, not on the
corpus. Pieces get gapless ranks within their length, and rank and filling give
sequence and offset.

Defined cases: null text counts as empty (the end id alone); repeated rows are
pieces of their own; a null doc_id is an id; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import table, written
from .sharding import numbered

WINDOW = 2048
END = 1
VOCABULARY = "byte_bpe_50k"
#: Entries of the cache of encoded words in each Python worker.
CACHE = 400_000


class Words(dict):
    """Ids of ' ' + word as little-endian 16-bit bytes."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self[word] = np.array(self.encode(" " + word), "<u2").tobytes()
        return ids


class Encoder:
    """The ids that the vocabulary's tokenizer gives, word by word through a cache.

    The tokenizer never joins a space with what stands before it, unless white
    space meets white space; such texts, and those with the tokenizer's added
    strings, are encoded whole.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = Words(self.plain.encode_ordinary)
        self.odd = re.compile(r"\s\s|^\s|\s\Z")

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if any(a in text for a in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        if self.odd.search(text):
            return np.array(self.plain.encode_ordinary(text), "<u4")
        first, *rest = text.split(" ")
        head = np.array(self.plain.encode_ordinary(first), "<u2").tobytes()
        return np.frombuffer(head + b"".join(map(self.words.__getitem__, rest)), "<u2").astype("<u4")


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document cut at multiples of window, END after its ids."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _encoders:
            _encoders[vocabulary] = Encoder(vocabulary)
        encode = _encoders[vocabulary]
        for b in it:
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(b.column(1)):
                ids = np.append(encode(text.as_py()), np.array([END], "<u4")).astype("<u4")
                for s in range(0, len(ids), window):
                    part = ids[s : s + window]
                    row.append(i)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    total.append(len(ids))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {doc_type}, start long, length long, ids_crc32 long, doc_tokens long")


def least_slack(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths within counts whose sum is largest, room at most: length to number."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach = (reach | reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    found: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            found[length] = found.get(length, 0) + take
            total -= length * take
    return found


def fillings(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """(length to number, repeats) of all windows, until no piece is left."""
    left, out = dict(counts), []
    while left:
        largest = max(left)
        others = dict(left)
        others[largest] -= 1
        if not others[largest]:
            del others[largest]
        fill = least_slack(others, window - largest)
        fill[largest] = fill.get(largest, 0) + 1
        times = min(left[x] // n for x, n in fill.items())
        for x, n in fill.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        out.append((fill, times))
    return out


def places(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, number in one sequence, offset) for each length of each filling."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for fill, times in fillings(counts, window):
        offset = 0
        for length in sorted(fill, reverse=True):
            n, first = fill[length], used.get(length, 0)
            rows.append((length, first, first + n * times, sequence, n, offset))
            used[length] = first + n * times
            offset += n * length
        sequence += times
    return rows


def packed(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece with its sequence_id and offset."""
    spark = docs.sparkSession
    cut = written(pieces(docs, window, vocabulary))
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # window rows at most
    plan = spark.createDataFrame(places(counts, window), "_length long, _first long, _end long, _sequence long, _n long, _offset long")
    placed = cut.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    ranked = numbered(placed, "length", ["_file", "_place"], ["doc_id", "start", "ids_crc32"], "_rank")
    met = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    at = F.col("_rank") - F.col("_first")
    return met.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_sequence") + F.floor(at / F.col("_n"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + (at % F.col("_n")) * F.col("length")).cast("long").alias("offset"),
    )


def op5_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
