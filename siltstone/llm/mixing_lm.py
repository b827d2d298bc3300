"""Operator 6: document scores by logistic mixing of hashed-context bit predictors.

A text is its words, lower-cased in A-Z, and one end. A symbol is a frequent
word, the end, or an escape for any other word; symbols are leaves of a Huffman
tree, so a text becomes bits, each at a node. Three predictors look up counts of
0 and 1: the node alone, hashed with the document's class, hashed with the word
before. The class is the document's most frequent word among the CLASSES most
frequent ones, and costs log2(CLASSES) bits. After an escape comes a bit, known
or new, whose probability is the share of words seen once (Good-Turing). A known
word costs its share of the counts of all words behind the escape; a new one is
spelled in bytes, down a second tree, by five predictors (the last one to four
bytes, and all bytes so far).

The stretched probabilities are mixed by weights that a gate selects (how much
the special contexts have seen); a last table, by gate and mixed prediction,
refines the result. Both are learnt from the bits of all training documents,
each predicted from the counts of all other documents (of all other spelt
words): one pass counts zeros and ones by gate and predictions, these rounded
to a grid, so that what is learnt from is bounded by the grid and sums of whole
numbers, the same however the input is partitioned. Newton steps on these counts
give the weights.

Counts come from all training documents, by three aggregations: of words (a
distributed table, joined to the words behind escapes); of (context, symbol)
pairs, dealt by the region of the context's slots, so that each task owns its
part of a table; and of the spelling of all words behind the escape. Vocabulary
and tables grow with the counts up to 2 ** MOST_WORD_BITS and 2 ** MOST_BITS
entries, which bounds what is broadcast; beyond that slots are shared, and words
stay in the distributed table, so no word is left out.

Training documents are those whose crc32 of the id as text, mod FOLDS, is not
HELD_OUT. Defined cases: null text counts as empty (one end); very long texts
are scored whole; a null doc_id counts as the text "null"; repeated rows are
scored each; without training documents all counts are zero; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

FOLDS, HELD_OUT = 7, 2
#: Words seen less often stand behind the escape.
LEAST_COUNT = 3
MOST_WORD_BITS, MOST_BITS = 17, 21
CLASSES = 64
REGION_BITS = 6
SPELL_BITS = (16, 18, 18, 18, 18)
DELTA = 0.4
GATES = 9
CELLS = 33
#: Grids of predictions that weights are learnt on: levels and step, of words and of spelling.
LEVELS = ((33, 0.5), (15, 1.0))
NEWTON = 30
#: How much the weights are held to a plain mean, for gates with few bits: as a count of bits predicted by 1.
PRIOR = 100.0
#: Bytes of texts that a task works on at once; a longer text is one piece.
CHUNK_BYTES = 5 << 19
#: Tokens whose pairs one task sums at most for a region that holds a third of them, about.
TOKENS_A_SUM = 1 << 28
BITS_AT_ONCE = 1 << 18
#: Bits whose places in a grid are made at a time, so that all of it stays in a cache.
AT_A_TIME = 1 << 13
#: Places that a tally holds before it sums them, and the largest grid that it keeps whole.
PLACES_AT_ONCE, WHOLE_GRID = 1 << 19, 1 << 20
STOP = 256  # the spelling alphabet: bytes, then this
#: Costs are looked up on a grid of predictions, so that they are the same however bits are batched.
GRID, EDGE = 256, 24


class Tree:
    """A Huffman tree over symbols; paths from the root in one array."""

    def __init__(self, weights: list[float]) -> None:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        n = len(weights)
        parent, side = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.uint8)
        for node in range(n, 2 * n - 1):
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x], parent[y], side[y] = node, node, 1
            heapq.heappush(heap, (a + b, node))
        top = 2 * n - 2
        at, steps = np.arange(n), []
        self.length = np.zeros(n, np.int64)
        while (live := np.flatnonzero(at != top)).size:  # one step up from every leaf that is still below the root
            steps.append((live, parent[at[live]] - n, side[at[live]]))
            self.length[live] += 1
            at[live] = parent[at[live]]
        self.start = np.cumsum(self.length) - self.length
        self.nodes, self.bits = np.zeros(int(self.length.sum()), np.uint32), np.zeros(int(self.length.sum()), np.uint8)
        for i, (live, nodes, bits) in enumerate(steps):
            to = self.start[live] + self.length[live] - 1 - i
            self.nodes[to], self.bits[to] = nodes, bits

    def expand(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, node, bit) of every bit of the symbols."""
        length = self.length[symbols]
        item = np.repeat(np.arange(len(symbols), dtype=np.int32), length)
        at = np.arange(len(item)) + np.repeat(self.start[symbols] - (np.cumsum(length) - length), length)
        return item, self.nodes[at], self.bits[at]


def mixed_bits(x: np.ndarray) -> np.ndarray:
    return mix(x.copy())


def mix(x: np.ndarray) -> np.ndarray:
    """mixed_bits in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def region(context: np.ndarray) -> np.ndarray:
    """The part of a table that holds a context's slots."""
    return mixed_bits(context) >> np.uint32(32 - REGION_BITS)


def slots(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """Slots inside the context's region of a table of 2 ** bits."""
    return mixed_bits(context ^ (node * np.uint32(0x9E3779B1))) >> np.uint32(32 + REGION_BITS - bits)


def whole_slots(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    return (region(context) << np.uint32(bits - REGION_BITS)) | slots(context, node, bits)


def item_slots(contexts: list[np.ndarray], item: np.ndarray, node: np.ndarray, bits: list[int]) -> list[np.ndarray]:
    """whole_slots of the items' contexts in each table; regions are drawn once for each item, not for each of its bits."""
    turned, item, out = node * np.uint32(0x9E3779B1), item.astype(np.intp), []
    for context, b in zip(contexts, bits):
        at = context.take(item)
        at ^= turned
        at = mix(at)
        at >>= np.uint32(32 + REGION_BITS - b)
        at |= (region(context) << np.uint32(b - REGION_BITS)).take(item)
        out.append(at)
    return out


def paired(counts: np.ndarray) -> np.ndarray:
    """Counts of 0 and 1 in turn, each two as one item, to be fetched at once."""
    return counts.view(np.dtype((np.void, 2 * counts.itemsize)) if counts.itemsize > 4 else np.int64)


class Mixer:
    """Count tables over one alphabet, their gated weights and the refining table."""

    def __init__(self, counts: list[np.ndarray], special: tuple[int, int], levels: tuple[int, float]) -> None:
        """counts: of 0 and 1 in turn, by slot. special: the predictors whose counts select the gate. levels: the grid to learn on."""
        self.counts, self.special, self.levels = counts, special, levels
        self.left: list[np.ndarray] = []
        k = len(counts)
        self.weights = np.full((GATES, k), 1.0 / k, np.float32)
        self.cells = np.zeros((GATES * CELLS, 2))
        self.ready: list[tuple[np.ndarray, np.ndarray]] | None = None

    def fix(self) -> None:
        """Turn counts into what scoring looks up."""
        self.ready = [(np.log((c[1::2] + DELTA) / (c[0::2] + DELTA)).astype(np.float32), self.fill(c[0::2] + c[1::2])) for c in self.counts]
        refined = np.log((self.cells[:, 1] + 0.5) / (self.cells[:, 0] + 0.5))
        centre = np.tile((np.arange(CELLS) - CELLS // 2) / 2, GATES)
        trust = np.minimum(self.cells.sum(1) / 200, 1)
        self.refined = (trust * refined + (1 - trust) * centre).astype(np.float32)
        grid = np.arange(-GRID * EDGE, GRID * EDGE + 1) / GRID
        self.costs = np.log1p(np.exp(-grid)) / math.log(2)

    @staticmethod
    def fill(total: np.ndarray) -> np.ndarray:
        return (total > 0).astype(np.uint8) + (total >= 8).astype(np.uint8)

    def mixed(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        columns = np.ascontiguousarray(self.weights.T)
        dot = columns[0].take(gate) * x[0]
        for i in range(1, len(x)):
            dot += columns[i].take(gate) * x[i]
        return dot

    @staticmethod
    def cell(dot: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return gate * CELLS + np.clip(np.rint(dot * 2), -(CELLS // 2), CELLS // 2).astype(np.intp) + CELLS // 2

    def cost(self, at: list[np.ndarray], bit: np.ndarray) -> np.ndarray:
        """Bits that each bit costs."""
        x = [s.take(i) for (s, _), i in zip(self.ready, at)]
        a, b = (self.ready[k][1].take(at[k]) for k in self.special)
        gate = (3 * a + b).astype(np.intp)
        dot = self.mixed(x, gate)
        dot = 0.5 * (dot + self.refined.take(self.cell(dot, gate)))
        on = np.clip(np.rint(np.where(bit, dot, -dot) * GRID), -GRID * EDGE, GRID * EDGE)
        return self.costs.take(on.astype(np.intp) + GRID * EDGE)

    def keys(self, counts: list[np.ndarray], on: list[np.ndarray], bit: np.ndarray, less: int = 0) -> np.ndarray:
        """Places in the grid of bits at on (2 * slot + bit in each table), predicted by counts; less: what is taken from each bit's own count."""
        return self.grid_keys([paired(c).take(k >> 1).view(c.dtype) for c, k in zip(counts, on)], bit, less)

    def grid_keys(self, seen: list[np.ndarray], bit: np.ndarray, less: int = 0) -> np.ndarray:
        """Places in the grid of bits that have these counts of 0 and 1, in turn, in each table."""
        levels, step = self.levels
        if len(bit) > AT_A_TIME:
            cuts = range(0, len(bit), AT_A_TIME)
            return np.concatenate([self.grid_keys([c[2 * lo : 2 * (lo + AT_A_TIME)] for c in seen], bit[lo : lo + AT_A_TIME], less) for lo in cuts])
        same, other = (np.empty((len(seen), len(bit)), np.float32) for _ in range(2))
        on = bit.astype(bool)
        for t, c in enumerate(seen):
            zero, one = c[0::2].astype(np.float32), c[1::2].astype(np.float32)
            same[t], other[t] = np.where(on, one, zero), np.where(on, zero, one)
        same = np.maximum(same - np.float32(less), 0)
        np.maximum(other, 0, out=other)
        a, b = (self.fill(same[t] + other[t]).astype(np.int32) for t in self.special)
        same += np.float32(DELTA)
        other += np.float32(DELTA)
        x = np.log(np.divide(same, other, out=same), out=same)
        x *= np.where(bit, np.float32(1 / step), np.float32(-1 / step))
        np.clip(np.rint(x, out=x), -(levels // 2), levels // 2, out=x)
        x += levels // 2
        key = 3 * a + b
        for level in x.astype(np.int32):
            key = key * levels + level
        return key * 2 + bit

    def whole(self) -> None:
        """Make the whole counts that a document's bits are taken out of, if they aren't made yet."""
        if not self.left:
            most = max(float(c.max(initial=0)) for c in self.counts)
            self.left = [c.astype(np.int32 if most < 1 << 30 else np.int64) for c in self.counts]

    def documents_keys(self, bit: np.ndarray, on: list[np.ndarray], times: np.ndarray, edges: list[int]) -> np.ndarray:
        """As document_keys, of several documents at once, whose bits lie between edges."""
        self.whole()
        seen = []
        for c, k in zip(self.left, on):
            times = times.astype(c.dtype, copy=False)
            away, slot, pairs = -times, k >> 1, paired(c)
            found = np.empty(len(k), pairs.dtype)
            for lo, hi in zip(edges[:-1], edges[1:]):
                np.add.at(c, k[lo:hi], away[lo:hi])
                np.take(pairs, slot[lo:hi], out=found[lo:hi], mode="clip")
                np.add.at(c, k[lo:hi], times[lo:hi])
            seen.append(found.view(c.dtype))
        return self.grid_keys(seen, bit)

    def document_keys(self, runs: Callable[[], Iterable]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in the grid of a document's bits, predicted from the counts of all others, and how often each bit stands there.

        runs() gives its (bit, places in the tables, times) again at each call.
        The document's bits are taken out of whole counts and put back.
        """
        self.whole()
        for _, on, times in runs():
            for c, k in zip(self.left, on):
                np.subtract.at(c, k, times.astype(c.dtype))
        for bit, on, times in runs():
            yield self.keys(self.left, on, bit), times
        for _, on, times in runs():
            for c, k in zip(self.left, on):
                np.add.at(c, k, times.astype(c.dtype))

    def learn(self, places: np.ndarray, counts: np.ndarray) -> None:
        """Weights and refining table from the bits counted by place in the grid, places ascending."""
        levels, step = self.levels
        k = len(self.counts)
        at, bit = places >> 1, places & 1
        cells, of = np.unique(at, return_inverse=True)
        n1, n = np.bincount(of, counts * bit, len(cells)), np.bincount(of, counts, len(cells))
        gate, rest = np.divmod(cells, levels**k)
        x = np.stack([(rest // levels ** (k - 1 - t) % levels - levels // 2) * step for t in range(k)], 1)
        for g in np.unique(gate).tolist():
            own = gate == g
            xs, ns, ones, w = x[own], n[own], n1[own], np.full(k, 1 / k)

            def loss(w: np.ndarray, xs=xs, ns=ns, ones=ones) -> float:
                dot = xs @ w
                return float(np.sum(ns * np.logaddexp(0, dot) - ones * dot) + 0.5 * PRIOR * np.sum((w - 1 / k) ** 2))

            least = loss(w)
            for _ in range(NEWTON):
                q = 1 / (1 + np.exp(-np.clip(xs @ w, -30, 30)))
                slope = xs.T @ (ones - ns * q) - PRIOR * (w - 1 / k)
                move = np.linalg.solve((xs * (ns * q * (1 - q))[:, None]).T @ xs + PRIOR * np.eye(k), slope)
                while (now := loss(w + move)) > least and np.abs(move).max() > 1e-9:
                    move = move / 2
                if now > least:
                    break
                w, least = w + move, now
                if np.abs(move).max() < 1e-7:
                    break
            self.weights[g] = w.astype(np.float32)
        dot = np.einsum("ij,ij->i", self.weights[gate].astype(np.float64), x)
        to = self.cell(dot, gate)
        self.cells = np.stack([np.bincount(to, n - n1, GATES * CELLS), np.bincount(to, n1, GATES * CELLS)], 1)


class Tally:
    """Counts by place in a grid: of all places of a small grid, of those seen of a large one."""

    def __init__(self, mixer: Mixer) -> None:
        levels = mixer.levels[0]
        self.grid = GATES * levels ** len(mixer.counts) * 2
        self.new: list[tuple[np.ndarray, np.ndarray | None]] = []
        self.size, self.whole = 0, np.zeros(self.grid if self.grid <= WHOLE_GRID else 0)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, places: np.ndarray, times: np.ndarray | None = None) -> None:
        """Without times each place counts once."""
        self.new.append((places, times))
        self.size += len(places)
        if self.size >= PLACES_AT_ONCE:
            self.take()

    def take(self) -> None:
        """Sum the new places."""
        new, self.new, self.size = self.new, [], 0
        places = np.concatenate([p for p, _ in new])
        times = None if all(t is None for _, t in new) else np.concatenate([np.ones(len(p), np.int64) if t is None else t for p, t in new])
        if len(self.whole):
            self.whole += np.bincount(places, times, self.grid)
            return
        self.parts.append(np.unique(places, return_counts=True) if times is None else summed_places(places, times))
        if sum(len(p) for p, _ in self.parts[1:]) >= PLACES_AT_ONCE:
            self.parts = [summed_places(*(np.concatenate(x) for x in zip(*self.parts)))]

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, counts), places ascending."""
        if self.new:
            self.take()
        if len(self.whole):
            places = np.flatnonzero(self.whole)
            return places, self.whole[places].astype(np.int64)
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        places, counts = summed_places(*(np.concatenate(x) for x in zip(*self.parts)))
        return places.astype(np.int64), counts.astype(np.int64)


def summed_places(places: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places, ascending, and the sums of their times."""
    order = np.argsort(places)
    places = places[order]
    starts = np.flatnonzero(np.append(True, places[1:] != places[:-1])[: len(places)])
    return places[starts], np.add.reduceat(times[order].astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)


class Words(NamedTuple):
    """The words of some texts, one after the other, and how many each text has."""

    flat: pa.Array
    sizes: np.ndarray


def split(texts: pa.Array) -> Words:
    """Words of texts, lower-cased in A-Z; null counts as empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)
    word = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves an empty string there
    owner = np.repeat(np.arange(len(sizes)), sizes)[word.to_numpy(zero_copy_only=False)]
    return Words(flat.filter(word).cast(pa.binary()), np.bincount(owner, minlength=len(sizes)))


def table_bits(tokens: int) -> int:
    """log2 of the slots for contexts of so many tokens."""
    return min(MOST_BITS, max(REGION_BITS + 6, max(tokens, 1).bit_length() - 2))


class Model:
    """The vocabulary, both trees and both mixers."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, documents: int) -> None:
        self.vocabulary, self.counts = pa.array(words, pa.binary()), np.array(counts, np.float64)
        self.end, self.escape = len(words), len(words) + 1
        self.symbols = self.escape + 1
        self.total, self.documents = total, documents
        self.bits = table_bits(total)
        weights = [*counts, documents, total - documents - sum(counts)]
        self.word_tree = Tree([max(x, 1) for x in weights])
        spelt = Counter(b for w in words for b in w)
        self.byte_tree = Tree([spelt.get(b, 0) + 1 for b in range(256)] + [len(words) + 1])
        # the counts of nodes alone follow from those of the symbols
        item, node, bit = self.word_tree.expand(np.arange(self.symbols))
        self.alone = np.bincount(2 * node.astype(np.int64) + bit, np.array(weights, np.float64)[item], 2 * self.symbols).astype(np.float32)

    @cached_property
    def words(self) -> list[bytes]:
        return self.vocabulary.to_pylist()

    @cached_property
    def ids(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    def behind(self, words: pa.Array) -> list[bytes]:
        """Those of words that stand behind the escape."""
        words = words.drop_null()
        return words.filter(pc.is_null(pc.index_in(words, value_set=self.vocabulary))).to_pylist()

    def sizes(self) -> list[int]:
        """Bits of the tables that tasks count: by class, by word before, and those of the spelling."""
        return [self.bits, self.bits, *SPELL_BITS]

    def load(self, parts: Iterator[tuple[int, int, bytes]]) -> None:
        """Take the counted regions (table, region, counts)."""
        full = [np.zeros(2 << b, np.float32) for b in self.sizes()]
        for t, r, counts in parts:
            n = len(full[t]) >> REGION_BITS
            full[t][r * n : (r + 1) * n] = np.frombuffer(counts, np.float32)
        self.word_mix = Mixer([self.alone, *full[:2]], (1, 2), LEVELS[0])
        self.spell_mix = Mixer(full[2:], (2, 4), LEVELS[1])

    # chunks -----------------------------------------------------------------

    def chunk(self, texts: Words | list[list[bytes]]) -> dict:
        """Tokens of some documents: ids, the symbol, class and word before of each, and the words behind escapes."""
        if isinstance(texts, list):
            texts = Words(pa.array(list(chain.from_iterable(texts)), pa.binary()), np.array([len(w) for w in texts], np.int64))
        found = pc.index_in(texts.flat, value_set=self.vocabulary)
        rare = found.is_null()
        own = texts.flat.filter(rare).dictionary_encode()
        known = found.fill_null(0).to_numpy().astype(np.int64)
        known[rare.to_numpy(zero_copy_only=False)] = own.indices.to_numpy() + np.int64(self.symbols)
        sizes = texts.sizes + 1
        ids = np.full(int(sizes.sum()), self.end, np.int64)
        inner = np.ones(len(ids), bool)
        inner[np.cumsum(sizes) - 1] = False
        ids[inner] = known
        n = len(sizes)
        doc = np.repeat(np.arange(n), sizes)
        low = ids < min(CLASSES, self.end)
        common = np.bincount(doc[low] * CLASSES + ids[low], minlength=n * CLASSES).reshape(n, CLASSES)
        symbol = np.minimum(ids, self.escape)
        before = np.empty_like(symbol)
        before[1:] = symbol[:-1]
        before[np.cumsum(sizes) - sizes] = self.end
        return {"doc": doc, "ids": ids, "symbol": symbol, "kind": common.argmax(1)[doc], "before": before, "own": own.dictionary, "sizes": sizes}

    @staticmethod
    def contexts(kind: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (kind.astype(np.uint32) + np.uint32(1)) * np.uint32(0x01000193), (before.astype(np.uint32) + np.uint32(101)) * np.uint32(0x27D4EB2F)

    def word_bits(self, symbol: np.ndarray, kind: np.ndarray | np.integer, before: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(item, bit, slots) for runs of items."""
        step = max(1, BITS_AT_ONCE // 16)
        for lo in range(0, len(symbol), step):
            own = slice(lo, lo + step)
            item, node, bit = self.word_tree.expand(symbol[own])
            c1, c2 = self.contexts(kind[own] if np.ndim(kind) else np.full(len(symbol[own]), kind), before[own])
            yield item + lo, bit, [node, *item_slots([c1, c2], item, node, [self.bits] * 2)]

    def spell_bits(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(word, bit, slots) for runs of words."""
        lo = 0
        while lo < len(words):
            hi, n = lo, 0
            while hi < len(words) and n < BITS_AT_ONCE // 8:  # by bytes, as a word may be very long
                n += len(words[hi]) + 1
                hi += 1
            part = words[lo:hi]
            size = np.fromiter(map(len, part), np.int64, len(part)) + 1
            owner = np.repeat(np.arange(len(part)), size)
            flat = np.frombuffer(b"\0".join(part) + b"\0", np.uint8).astype(np.int64)
            last = np.cumsum(size) - 1
            symbol = flat.copy()
            symbol[last] = STOP
            place = np.arange(len(flat)) - (last + 1 - size)[owner]
            back = []
            for k in (1, 2, 3, 4):
                shifted = np.zeros(len(flat), np.int64)
                shifted[k:] = flat[: max(0, len(flat) - k)]
                back.append(np.where(place >= k, shifted + 1, 0).astype(np.uint32))
            contexts = [back[0] + np.uint32(7)]
            for k in (1, 2, 3):
                contexts.append(contexts[-1] * np.uint32(0x01000193) + back[k] * np.uint32(0x10DCD) + np.uint32(k))
            # the bytes so far by prefix sums of byte and place, so that long words cost no loop
            drawn = mixed_bits((flat.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1) + place.astype(np.uint32) * np.uint32(0x85EBCA77))
            sums = np.cumsum(drawn.astype(np.uint64)) - drawn
            contexts.append((sums - sums[last + 1 - size][owner]).astype(np.uint32) ^ np.uint32(0x5BD1E995))
            item, node, bit = self.byte_tree.expand(symbol)
            yield owner[item] + lo, bit, item_slots(contexts, item, node, SPELL_BITS)
            lo = hi

    # counting -----------------------------------------------------------------

    def pairs(self, texts: Words | list[list[bytes]]) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(table, region, (context, symbol) as one number, counts) of some documents."""
        c = self.chunk(texts)
        for t, context in enumerate((c["kind"], c["before"])):
            keys, n = np.unique(context * self.symbols + c["symbol"], return_counts=True)
            at = keys // self.symbols
            r = region(self.contexts(at, at)[t])
            order = np.argsort(r, kind="stable")
            keys, n, r = keys[order], n[order].astype(np.uint32), r[order]
            edges = np.searchsorted(r, np.arange((1 << REGION_BITS) + 1))
            for i in np.flatnonzero(np.diff(edges)).tolist():
                own = slice(edges[i], edges[i + 1])
                yield t, i, keys[own].tobytes(), n[own].tobytes()

    def count_pairs(self, t: int, keys: np.ndarray, n: np.ndarray, into: np.ndarray) -> None:
        """Add pairs of one region to its counts."""
        step = max(1, BITS_AT_ONCE // 16)
        for lo in range(0, len(keys), step):
            at, symbol = np.divmod(keys[lo : lo + step], self.symbols)
            item, node, bit = self.word_tree.expand(symbol)
            slot = slots(self.contexts(at, at)[t][item], node, self.bits)
            into += np.bincount(2 * slot.astype(np.int64) + bit, n[lo : lo + step][item], len(into))

    # scoring -----------------------------------------------------------------

    def tally(self, texts: Words | list[list[bytes]], into: Tally) -> None:
        """Count the symbols' bits of some documents in the grid."""
        c = self.chunk(texts)
        kinds = c["kind"][np.cumsum(c["sizes"]) - c["sizes"]]
        pairs, times = np.unique((c["doc"] * self.symbols + c["before"]) * self.symbols + c["symbol"], return_counts=True)
        rest, symbol = np.divmod(pairs, self.symbols)
        doc, before = np.divmod(rest, self.symbols)
        edges = np.searchsorted(doc, np.arange(len(kinds) + 1))
        most, first = BITS_AT_ONCE // 16, 0
        while first < len(kinds):
            lo = int(edges[first])
            last = max(first + 1, int(np.searchsorted(edges, lo + most, "right")) - 1)  # as many documents as one run of bits holds
            own = slice(lo, int(edges[last]))

            def runs(own=own, kind=np.repeat(kinds[first:last], np.diff(edges[first : last + 1]))) -> Iterable:
                for item, bit, at in self.word_bits(symbol[own], kind, before[own]):
                    yield item, bit, [2 * i.astype(np.int64) + bit for i in at], times[own].take(item)

            if own.stop - lo <= most:
                for item, bit, on, n in runs():
                    into.add(self.word_mix.documents_keys(bit, on, n, np.searchsorted(item, edges[first : last + 1] - lo).tolist()), n)
            else:  # one document of several runs
                for places, n in self.word_mix.document_keys(lambda runs=runs: (x[1:] for x in runs())):
                    into.add(places, n)
            first = last

    def tally_spelling(self, words: list[bytes], into: Tally) -> None:
        """Count the bits of words that stand behind escapes, each word once, in the grid. Each bit is taken out of its own prediction."""
        for _, bit, at in self.spell_bits(words):
            into.add(self.spell_mix.keys(self.spell_mix.counts, [2 * i.astype(np.int64) + bit for i in at], bit, 1))

    def fit(self, texts: Iterator[list[bytes]]) -> None:
        """Weights and refining tables from documents, in one process."""
        words, spelling, behind = Tally(self.word_mix), Tally(self.spell_mix), set()
        for text in texts:
            self.tally([text], words)
            behind.update(w for w in text if w not in self.ids)
        self.tally_spelling(sorted(behind), spelling)
        self.word_mix.learn(*words.sums())
        self.spell_mix.learn(*spelling.sums())

    def score(self, c: dict, documents: int) -> np.ndarray:
        """Bits of each text of a chunk, without those of the words behind escapes."""
        key = (c["symbol"] * self.symbols + c["before"]) * CLASSES + c["kind"]
        items, of = np.unique(key, return_inverse=True)
        pair, kind = np.divmod(items, CLASSES)
        symbol, before = np.divmod(pair, self.symbols)
        cost = np.zeros(len(items))
        for item, bit, at in self.word_bits(symbol, kind, before):
            first = int(item[0])
            own = np.bincount(item - first, self.word_mix.cost(at, bit))
            cost[first : first + len(own)] = own
        return np.bincount(c["doc"], cost[of], documents) + math.log2(CLASSES)

    def spelling(self, words: list[bytes]) -> np.ndarray:
        """Bits that the spelling of each word costs."""
        cost = np.zeros(len(words))
        for item, bit, at in self.spell_bits(words):
            first = int(item[0])
            own = np.bincount(item - first, self.spell_mix.cost(at, bit))
            cost[first : first + len(own)] = own
        return cost


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fold(doc_id) -> int:
    return zlib.crc32(str("null" if doc_id is None else doc_id).encode()) % FOLDS


def chunks(it: Iterator[pa.RecordBatch], train_only: bool) -> Iterator[tuple[list, Words]]:
    """(ids, words) of documents, in chunks of about CHUNK_BYTES bytes."""
    ids, parts, n = [], [], 0
    for b in it:
        own, texts = b.column(0).to_pylist(), b.column(1)
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64) + 1
        if train_only:
            rows = [r for r, i in enumerate(own) if fold(i) != HELD_OUT]
            own, size = [own[r] for r in rows], size[rows]
        else:
            rows = None
        ends, lo = np.cumsum(size), 0
        while lo < len(own):
            done = int(ends[lo] - size[lo])
            hi = min(len(own), int(np.searchsorted(ends, done + CHUNK_BYTES - n)) + 1)
            parts.append(texts.slice(lo, hi - lo) if rows is None else texts.take(pa.array(rows[lo:hi])))
            ids += own[lo:hi]
            n += int(ends[hi - 1]) - done
            lo = hi
            if n >= CHUNK_BYTES:
                yield ids, split(pa.concat_arrays(parts))
                ids, parts, n = [], [], 0
    if ids:
        yield ids, split(pa.concat_arrays(parts))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) of the training documents, and the number of these under a null word."""

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = 0
        for ids, texts in chunks(it, True):
            found = pc.value_counts(texts.flat)
            documents += len(ids)
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "c"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([documents], pa.int64())], names=["word", "c"])

    return docs.select("doc_id", "text").mapInArrow(counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


PART = "t int, region int, salt int, keys binary, n binary"


def part_rows(rows: list[tuple[int, int, bytes | None, bytes]], salt: int = 0) -> pa.RecordBatch:
    t, r, k, n = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(r, pa.int32()), pa.array([salt] * len(t), pa.int32()), pa.array(k, pa.binary()), pa.array(n, pa.binary())], names=["t", "region", "salt", "keys", "n"])


def context_counts(docs: DataFrame, counts: DataFrame, shared, salts: int = 1) -> DataFrame:
    """(t, region, n): the counts of each region of each table. shared: the broadcast Model. salts: tasks that share the sums of a region."""

    def paired(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(it, True):
            yield part_rows(list(shared.value.pairs(texts)), TaskContext.get().partitionId() % salts)

    def spelt(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sums = [np.zeros(2 << b) for b in SPELL_BITS]
        for b in it:
            for _, bit, at in m.spell_bits(m.behind(b.column(0))):
                for x, i in zip(sums, at):
                    x += np.bincount(2 * i.astype(np.int64) + bit, minlength=len(x))
        for t, x in enumerate(sums):
            for r, part in enumerate(x.astype(np.float32).reshape(1 << REGION_BITS, -1)):
                if part.any():
                    yield part_rows([(t + 2, r, None, part.tobytes())], TaskContext.get().partitionId() % salts)

    def summed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        found: dict[tuple[int, int], np.ndarray] = {}
        for b in it:
            for t, r, _, k, n in zip(*(x.to_pylist() for x in b.columns)):
                into = found.setdefault((t, r), np.zeros((2 << m.sizes()[t]) >> REGION_BITS))
                if k is None:
                    into += np.frombuffer(n, np.float32)
                else:
                    m.count_pairs(t, np.frombuffer(k, np.int64), np.frombuffer(n, np.uint32), into)
        for (t, r), x in found.items():
            yield part_rows([(t, r, None, x.astype(np.float32).tobytes())])

    # floats hold whole numbers up to 2 ** 24 exactly, and sums of those beyond are rounded alike in any order but for the last bit
    parts = docs.select("doc_id", "text").mapInArrow(paired, PART).unionByName(counts.select("word").mapInArrow(spelt, PART))
    if salts > 1:
        parts = parts.repartition("t", "region", "salt").mapInArrow(summed, PART)
    return parts.repartition("t", "region").mapInArrow(summed, PART).select("t", "region", "n")


def fitted(docs: DataFrame, counts: DataFrame, shared) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, cells) of both mixers, from all training documents and all words behind escapes. shared: the broadcast Model with its counts."""

    def rows(tally: Tally, mix: int) -> Iterator[pa.RecordBatch]:
        places, n = tally.sums()
        if len(places):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), mix, np.int32)), pa.array(places), pa.array(n)], names=["mix", "place", "n"])

    def words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(shared.value.word_mix)
        for _, texts in chunks(it, True):
            shared.value.tally(texts, tally)
        yield from rows(tally, 0)

    def spelling(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(shared.value.spell_mix)
        for b in it:
            shared.value.tally_spelling(shared.value.behind(b.column(0)), tally)
        yield from rows(tally, 1)

    def learn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, held = shared.value, [[x.to_numpy() for x in b.columns] for b in it]
        mix, places, n = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64),) * 3
        out = []
        for i, x in enumerate((m.word_mix, m.spell_mix)):
            own = np.flatnonzero(mix == i)
            own = own[np.argsort(places[own])]
            x.learn(places[own], n[own])
            out += [x.weights, x.cells]
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float64).tobytes() for x in out], pa.binary())], names=["x"])

    kind = "mix int, place long, n long"
    counted = docs.select("doc_id", "text").mapInArrow(words, kind).unionByName(counts.select("word").mapInArrow(spelling, kind))
    grid = counted.groupBy("mix", "place").agg(F.sum("n").alias("n"))  # bounded by the grids
    found = [np.frombuffer(r.x, np.float64) for r in grid.coalesce(1).mapInArrow(learn, "x binary").collect()]
    if not found:
        return []
    return [(w.reshape(GATES, -1).astype(np.float32), c.reshape(-1, 2)) for w, c in (found[:2], found[2:])]


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    spark = docs.sparkSession
    counts = written(word_counts(docs))
    once = F.sum(F.when(F.col("word").isNotNull() & (F.col("c") == 1), 1).otherwise(0))
    sums = counts.agg(F.sum("c").alias("n"), F.count("word").alias("v"), F.sum(F.when(F.col("word").isNull(), F.col("c"))).alias("documents"), once.alias("once")).first()
    total, documents = sums.n or 0, sums.documents or 0
    kinds = sums.v + (1 if documents else 0)
    frequent = counts.where(F.col("word").isNotNull() & (F.col("c") >= LEAST_COUNT))
    top = frequent.orderBy(F.desc("c"), "word").limit(1 << MOST_WORD_BITS).collect()  # at most so many words
    model = Model([bytes(r.word) for r in top], [r.c for r in top], total, documents)
    escaped = total - documents - sum(r.c for r in top)
    new = (sums.once + 1) / (escaped + 2) if escaped else 1.0
    del top
    start = spark.sparkContext.broadcast(model)
    model.load((r.t, r.region, r.n) for r in context_counts(docs, counts, start, -(-total // TOKENS_A_SUM) or 1).collect())  # bounded by the tables' size
    start.unpersist()
    shared = spark.sparkContext.broadcast(model)
    learnt = fitted(docs, counts, shared)
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    of = total + kinds + 1

    def results(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for mix, (weights, cells) in zip((m.word_mix, m.spell_mix), learnt):
            if mix.ready is None:
                mix.weights, mix.cells = weights, cells
        for mix in (m.word_mix, m.spell_mix):
            if mix.ready is None:
                mix.fix()
            mix.counts, mix.left = [], []  # scoring looks up what fix() made of them
        row = TaskContext.get().partitionId() << 33
        names = ["row", "doc_id", "n_tokens", "n_known", "base", "bits", "bytes", "word", "n", "spelt"]
        value = np.log10((np.concatenate([m.counts, [m.documents, 0]]) + 1) / of)
        id_type = None

        def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for b in batches:
                id_type = b.column(0).type
                yield b

        none = pa.nulls
        for b_ids, texts in chunks(typed(it), False):
            c = m.chunk(texts)
            n = len(b_ids)
            bits = m.score(c, n)
            rare = c["symbol"] == m.escape
            common = ~rare
            known = np.bincount(c["doc"][common], np.where(c["ids"][common] == m.end, m.documents > 0, True), n).astype(np.int64)
            base = np.bincount(c["doc"][common], value[c["ids"][common]], n)
            lengths = np.append(0, np.cumsum(pc.binary_length(texts.flat).to_numpy().astype(np.int64) + 1))
            ends = np.cumsum(texts.sizes)
            sizes = lengths[ends] - lengths[ends - texts.sizes]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + row), pa.array(b_ids, id_type), pa.array(c["sizes"]), pa.array(known), pa.array(base), pa.array(bits), pa.array(sizes), none(n, pa.binary()), none(n, pa.int64()), none(n, pa.float64())], names=names)
            pairs, times = np.unique((c["ids"][rare] - m.symbols) * n + c["doc"][rare], return_counts=True)
            # words of training documents are known; only those of held-out ones may have to be spelled
            word, owner = np.divmod(pairs, n)
            held = np.array([fold(i) == HELD_OUT for i in b_ids])
            spell = np.unique(word[held[owner]])
            cost = np.full(len(c["own"]), np.nan)
            cost[spell] = m.spelling(c["own"].take(pa.array(spell)).to_pylist())
            for lo in range(0, len(pairs), 1 << 16):
                own = slice(lo, lo + (1 << 16))
                w = word[own]
                k = len(w)
                x = cost[w]
                yield pa.RecordBatch.from_arrays([pa.array(owner[own] + row), none(k, id_type), *[none(k, pa.int64())] * 2, *[none(k, pa.float64())] * 2, none(k, pa.int64()), c["own"].take(pa.array(w)), pa.array(times[own]), pa.array(x, mask=np.isnan(x))], names=names)
            row += n

    made = written(docs.select("doc_id", "text").mapInArrow(results, f"row long, doc_id {doc_type}, n_tokens long, n_known long, base double, bits double, bytes long, word binary, n long, spelt double"))
    rare = made.where(F.col("word").isNotNull()).select("row", "word", "n", "spelt")
    rare = rare.join(counts.where(F.col("word").isNotNull()), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    seen = F.col("c") > 0
    cost = F.when(seen, -F.log2(F.lit(1 - new) * F.col("c") / F.lit(float(max(escaped, 1))))).otherwise(-F.log2(F.lit(new)) + F.col("spelt"))
    rare = rare.groupBy("row").agg(
        F.sum(F.col("n") * F.log10((F.col("c") + 1) / F.lit(float(of)))).alias("more"), F.sum(F.when(seen, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * cost).alias("more_bits")
    )
    rows = made.where(F.col("word").isNull()).select("row", "doc_id", "n_tokens", "n_known", "base", "bits", "bytes")
    out = rows.join(rare, "row", "left").withColumn("bits", F.col("bits") + F.coalesce("more_bits", F.lit(0.0)))
    key = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "UTF-8"))
    return out.select(
        "doc_id",
        (key % FOLDS == HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (-F.col("bits") * math.log10(2)).alias("score"),
        (F.col("bits") / F.greatest(F.col("bytes"), F.lit(1))).alias("bits_per_byte"),
    )


def op6_context_mixing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
