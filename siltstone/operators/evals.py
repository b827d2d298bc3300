"""Evaluation and operations metrics: rates, duplicates, schemas, queues, ratchets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.session import stored, spread


def rate(part: Column, whole: Column) -> Column:
    """part / whole rounded to 6 places; 0 for an empty whole."""
    return F.round(F.when(whole > 0, part / whole).otherwise(F.lit(0.0)), 6)


def sampled(df: DataFrame, key: str, n: int) -> DataFrame:
    """n rows, the same every time: those of least key hash."""
    return df.orderBy(F.sha2(F.col(key).cast("string"), 256), key).limit(n)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers spread over all 64 bits, one to one."""
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


#: A number for each byte at each of the first 64 places of a word; later places are mixed when they come up.
BYTES = _mixed(np.arange(1, (64 << 8) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


def _shingles(raw: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of texts that end at `ends` of raw, sorted in each text, and their number in each."""
    lows = np.concatenate([[0], ends[:-1]])
    word = ~BLANK[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    begun = lows[lows < ends]
    first[begun] = word[begun]
    at, place = np.flatnonzero(first), np.flatnonzero(word)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    x = ((place - at[np.cumsum(first)[place] - 1]) << 8) | raw[place]
    v = BYTES[np.minimum(x, len(BYTES) - 1)]
    far = x >= len(BYTES)
    v[far] = _mixed((x[far].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    w = _mixed(np.add.reduceat(v, np.flatnonzero(first[place])))
    doc = np.searchsorted(ends, at, "right")
    n = np.bincount(doc, minlength=len(ends))
    odd = _mixed(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    runs = max(0, len(w) - k + 1)
    g = np.zeros(runs, np.uint64)
    for j in range(k):
        g += w[j : j + runs] * odd[j]
    whole = doc[:runs] == doc[k - 1 :] if runs else np.zeros(0, bool)
    g, own = _mixed(g[whole]), doc[:runs][whole]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        lo = np.cumsum(n) - n
        more = np.array([np.sum(w[lo[i] : lo[i] + n[i]] * odd[: n[i]]) + np.uint64(n[i]) for i in short], np.uint64)
        g, own = np.concatenate([g, _mixed(more)]), np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        g, own = g[order], own[order]
    n = np.bincount(own, minlength=len(ends))
    for lo, hi in zip(np.cumsum(n) - n, np.cumsum(n)):
        g[lo:hi].sort()
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (own[1:] != own[:-1])
    return g[new], np.bincount(own[new], minlength=len(ends))


#: Bytes of text that are shingled at once.
TEXT_AT_ONCE = 1 << 20


def _shingled(b: pa.RecordBatch, k: int = 5) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of a batch (.., text) with at most TEXT_AT_ONCE bytes, or one row: the rows, the sizes of their sets, their hashes."""
    texts = b.column("text").cast(pa.large_binary())
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        done = ends[lo] - size[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, done + TEXT_AT_ONCE, "right")))
        own = texts.slice(lo, hi - lo)
        begin = int(np.frombuffer(own.buffers()[1], np.int64)[own.offset])
        raw = np.frombuffer(own.buffers()[2] or b"", np.uint8)[begin : begin + ends[hi - 1] - done]
        h, n = _shingles(raw, ends[lo:hi] - done, k)
        yield b.slice(lo, hi - lo), n, h
        lo = hi


def lowered(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the lower-case text as its last column, text."""
    return df.select(*[c for c in df.columns if c != text], F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))


def with_shingles(df: DataFrame, text: str, out: str, k: int = 5) -> DataFrame:
    """df with the distinct hashes of all runs of k lower-case words, of all words where there are fewer, in place of the text."""
    rest = [c for c in df.columns if c != text]

    def shingle(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for rows, n, h in _shingled(b, k):
                sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(rest)], sets], names=[*rest, out])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return lowered(df, text).mapInArrow(shingle, f"{kinds}, `{out}` array<bigint>")


#: Sets that hold a shingle beyond which it comes late in the order of the prefix filter.
COMMON = 16
#: So many of the most common shingles have their place in that order by their count; it decides what is compared, not what is found.
LATE = 1 << 20
#: Parts that hashes are dealt to, bits of a hash that are kept in a part, hashes that are packed at once.
SHARDS, REST, AT_ONCE = 1024, 30, 1 << 18
#: Pairs that a task holds before it counts them.
MET = 1 << 18
#: Up to so many ids are broadcast.
BROADCAST = 1_000_000
#: Items that hold a shingle beyond which those that meet by it are compared in blocks, so many items in a block, and hashes in it about.
HOT, BLOCK, BLOCK_HASHES = 64, 1024, 1 << 20
#: Items of a block that hold a shingle beyond which it is a column of a matrix product, and columns of a product.
DENSE, COLUMNS = 8, 4096


def picked(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of df whose key is in keys, a stored table; only keys travel where they are few."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST else keys, on, "left_semi")


def distinct_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text): each different text once, under its least key. Only digests are shuffled, texts where both the kept and the left out rows are many, or a least key stands twice.

    Rows without a key are left out. Of kept and left out rows, the fewer are sent to the texts.
    """
    named = spread(df.select(F.col(key).alias("id"), F.col(text).alias("text"))).where("id IS NOT NULL").withColumn("_t", F.xxhash64("text"))
    digests = named.select("id", "_t", F.unhex(F.sha2("text", 256)).alias("_d")).groupBy("_d", "_t", "id").agg(F.count("*").alias("c"))
    rows = stored(digests.select("id", "_t", "c", (F.min("id").over(Window.partitionBy("_d")) == F.col("id")).alias("kept")))
    n = {r.kind: r["count"] for r in rows.groupBy(F.when(~F.col("kept"), "left").when(F.col("c") > 1, "more").otherwise("once").alias("kind")).count().collect()}
    more = rows.where(F.col("kept") & (F.col("c") > 1)).select("id", "_t")
    if n.get("once", 0) <= n.get("left", 0) + n.get("more", 0):
        once = picked(named, rows.where(F.col("kept") & (F.col("c") == 1)).select("id", "_t"), ["id", "_t"])
    else:
        left = rows.where(~F.col("kept") | (F.col("c") > 1)).select("id", "_t")
        once = named.join(F.broadcast(left) if n.get("left", 0) + n.get("more", 0) <= BROADCAST else left, ["id", "_t"], "left_anti")
    once = once.select("id", "text")
    return once.unionByName(picked(named, more, ["id", "_t"]).select("id", "text").dropDuplicates()) if n.get("more") else once


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, all first ones first, so that small numbers compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(x: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _pieces(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of batches (.., h) with at most AT_ONCE hashes, or one row: the rows, their sizes, their hashes. Also of batches (.., text) of lower-case texts."""
    for b in it:
        if "h" not in b.schema.names:
            yield from _shingled(b)
            continue
        sizes = b.column("h").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, lo = np.cumsum(sizes), 0
        while lo < len(sizes):
            done = ends[lo] - sizes[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
            own = b.slice(lo, hi - lo)
            yield own, sizes[lo:hi], own.column("h").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            lo = hi


def _by_shard(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The rows of each shard, of batches in order of shard."""
    at, rows = None, []
    for b in it:
        for shard, *row in zip(*(c.to_pylist() for c in b.columns)):
            if shard != at and rows:
                yield at, rows
                rows = []
            at = shard
            rows.append(row)
    if rows:
        yield at, rows


def common_shingles(items: DataFrame) -> DataFrame:
    """(k, c) of the shingles that more than COMMON of items (h, or lower-case text) hold, k their first 40 bits. About three bytes of each shingle are shuffled."""

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, h in _pieces(it):
            k = np.sort(h >> np.uint64(64 - 10 - REST))
            ends = np.searchsorted(k, np.arange(SHARDS + 1, dtype=np.uint64) << np.uint64(REST))
            rest = (k & np.uint64((1 << REST) - 1)).astype(np.uint32)
            full = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([_planes(_steps(rest[ends[s] : ends[s + 1]])) for s in full], pa.binary())], names=["shard", "keys"])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(it):
            k, c = np.unique(np.concatenate([np.cumsum(_numbers(x, np.uint32), dtype=np.uint32) for (x,) in rows]), return_counts=True)
            often = c > COMMON
            yield pa.RecordBatch.from_arrays([pa.array((shard << REST) + k[often].astype(np.int64)), pa.array(c[often].astype(np.int64))], names=["k", "c"])

    packed = items.select("h" if "h" in items.columns else "text").mapInArrow(pack, "shard int, keys binary")
    return packed.repartition("shard").sortWithinPartitions("shard").mapInArrow(count, "k long, c long")


def meeting(items: DataFrame, least: float, days: int | None) -> DataFrame:
    """(hot, id, id2, c, need) of items (id, day, h), or with lower-case text for h. Two that overlap by more than `least` stand in a row (false, id, id2), id < id2, or share an id2 in rows (true, id, id2, size).

    Two such sets share s = 1 + n / 20 of their first n - ceil(least * n) + s
    shingles, n the smaller set. Those that no more than HOT hold make pairs,
    which need s of them. Holders of a common one are named by its leader, the
    holder of fewest rare shingles, so that most shingles of a group have one
    leader, and nothing is paired. An item with few common ones sends none;
    its pairs need fewer of the others instead.
    """
    late = stored(common_shingles(items)).orderBy(F.desc("c"), "k").limit(LATE).toArrow().sort_by("k")
    sent = items.sparkSession.sparkContext.broadcast((late.column(0).to_numpy(), late.column(1).to_numpy()))

    def shared(n: np.ndarray) -> np.ndarray:
        return np.minimum(1 + n // 20, np.ceil(n * least).astype(np.int64))

    def few(n: np.ndarray) -> np.ndarray:
        """Up to so many common shingles count as few: under what any partner must share."""
        return shared(np.ceil(n * least).astype(np.int64)) // 2

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = sent.value
        for rows, n, h in _pieces(it):
            doc = np.repeat(np.arange(len(n)), n)
            k = (h >> np.uint64(64 - 10 - REST)).astype(np.int64)
            c = np.zeros(len(k), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                c = np.where(keys[at] == k, counts[at], 0)
            rare = np.bincount(doc[c == 0], minlength=len(n))
            order = np.lexsort((h, c, doc))
            place = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
            order = order[place < np.repeat(n - np.ceil(n * least).astype(np.int64) + shared(n), n)]
            k, doc, hot = k[order], doc[order], c[order] > HOT
            common = np.bincount(doc[hot], minlength=len(n))
            sends = ~hot | (common > few(n))[doc]
            k, doc, hot = k[sends], doc[sends], hot[sends]
            shard = (k >> REST) + hot * SHARDS
            order = np.argsort(shard, kind="stable")  # documents stay in order in each shard
            k, doc, hot, shard = k[order], doc[order], hot[order], shard[order]
            ends = np.searchsorted(shard, np.arange(2 * SHARDS + 1))
            rest = (k & ((1 << REST) - 1)).astype(np.uint32)
            ids, day = (rows.column(x).to_numpy(zero_copy_only=False).astype(kind) for x, kind in (("id", np.int64), ("day", np.int32)))
            extra = np.where(hot, rare[doc], common[doc]).astype(np.int32)
            full = np.flatnonzero(np.diff(ends))
            cut = [(ends[s], ends[s + 1]) for s in full]
            out = [[_planes(rest[a:b]) for a, b in cut], [_planes(_steps(ids[doc[a:b]])) for a, b in cut], [_planes(n[doc[a:b]].astype(np.int32)) for a, b in cut], [_planes(day[doc[a:b]]) for a, b in cut], [_planes(extra[a:b]) for a, b in cut]]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *[pa.array(x, pa.binary()) for x in out]], names=["shard", "keys", "ids", "ns", "days", "extras"])

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate(held)
        order = np.lexsort((both[:, 2], both[:, 1], both[:, 0]))
        both = both[order]
        at = np.flatnonzero(np.concatenate([[True], (both[1:, :3] != both[:-1, :3]).any(1)]))
        c = np.diff(np.append(at, len(both)))
        return pa.RecordBatch.from_arrays([pa.array(both[at, 0] == 1), pa.array(both[at, 1]), pa.array(both[at, 2]), pa.array(c), pa.array(both[at, 3])], names=["hot", "id", "id2", "c", "need"])

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for shard, rows in _by_shard(it):
            k = np.concatenate([_numbers(x[0], np.uint32) for x in rows])
            ids = np.concatenate([np.cumsum(_numbers(x[1], np.int64)) for x in rows])
            n, day, extra = (np.concatenate([_numbers(x[i], np.int32) for x in rows]).astype(np.int64) for i in (2, 3, 4))
            order = np.lexsort((ids, extra, k)) if shard >= SHARDS else np.argsort(k, kind="stable")
            k, ids, n, day, extra = k[order], ids[order], n[order], day[order], extra[order]
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            sizes = np.diff(np.append(starts, len(k)))
            if shard >= SHARDS:
                some = np.repeat(sizes > 1, sizes)
                found = [np.stack([np.ones(some.sum(), np.int64), ids[some], np.repeat(ids[starts], sizes)[some], n[some]], 1)]
            else:
                found = (paired(x, y, ids, n, day, extra) for x, y in _within(starts, sizes))
            for x in found:
                held.append(x)
                size += len(x)
                if size > MET:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    def paired(x: np.ndarray, y: np.ndarray, ids: np.ndarray, n: np.ndarray, day: np.ndarray, common: np.ndarray) -> np.ndarray:
        near = (ids[x] != ids[y]) & (np.minimum(n[x], n[y]) >= np.maximum(n[x], n[y]) * least)
        if days is not None:
            near &= np.abs(day[x] - day[y]) <= days
        x, y = x[near], y[near]
        both = (common[x] > few(n[x])) & (common[y] > few(n[y]))  # what they share of common ones shows in their leaders
        need = shared(np.minimum(n[x], n[y])) - np.where(both, 0, np.minimum(common[x], common[y]))
        return np.stack([np.zeros(len(x), np.int64), np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), np.maximum(need, 1)], 1)

    packed = items.mapInArrow(pack, "shard int, keys binary, ids binary, ns binary, days binary, extras binary")
    met = packed.repartition("shard").sortWithinPartitions("shard").mapInArrow(meet, "hot boolean, id long, id2 long, c long, need long")
    return met.groupBy("hot", "id", "id2").agg(F.sum("c").alias("c"), F.max("need").alias("need")).where(F.col("hot") | (F.col("c") >= F.col("need")))


def cells(met: DataFrame) -> DataFrame:
    """(id, cells) of meeting(): cells are (cell, lo, hi, side, leaders). Each pair has one cell in which both stand; a cell's items are at most about two blocks."""
    labels = met.where("hot").select("id", F.col("id2").alias("cell"), F.col("need").alias("n"))
    named = labels.groupBy("id").agg(F.sort_array(F.collect_list("cell")).alias("leaders"))
    sizes = labels.groupBy("cell").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_HASHES)).alias("parts"))
    own = labels.join(sizes, "cell").join(named, "id").withColumn("s", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = own.select("id", "cell", F.least("s", "t").alias("lo"), F.greatest("s", "t").alias("hi"), (F.col("s") > F.col("t")).cast("int").alias("side"), "leaders")
    theirs = named.select(F.col("id").alias("id2"), F.col("leaders").alias("leaders2"))
    pairs = met.where("NOT hot").select("id", "id2").join(named, "id", "left").join(theirs, "id2", "left").where(~F.coalesce(F.arrays_overlap("leaders", "leaders2"), F.lit(False))).select("id", "id2")
    parts = pairs.groupBy("id").agg(F.ceil(F.count("*") / (BLOCK // 4)).alias("parts"))
    leaf = pairs.join(parts, "id").select("id", "id2", F.pmod(F.xxhash64("id2"), F.col("parts")).alias("hi"))
    none = F.array().cast("array<bigint>")
    leaves = leaf.select(F.col("id2").alias("id"), F.col("id").alias("cell"), F.lit(-1).cast("long").alias("lo"), "hi", F.lit(1).alias("side"), none.alias("leaders"))
    centres = leaf.select("id", "hi").distinct().select("id", F.col("id").alias("cell"), F.lit(-1).cast("long").alias("lo"), "hi", F.lit(0).alias("side"), none.alias("leaders"))
    return blocks.unionByName(leaves).unionByName(centres).groupBy("id").agg(F.collect_list(F.struct("cell", "lo", "hi", "side", "leaders")).alias("cells"))


def _cells(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell, of batches in order of (cell, lo, hi)."""
    held, at = [], None
    for b in it:
        keys = np.stack([b.column(x).to_numpy(zero_copy_only=False) for x in ("cell", "lo", "hi")], 1)
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else np.zeros(0, np.int64)
        for lo, hi in zip(starts, np.append(starts[1:], len(keys))):
            if tuple(keys[lo]) != at and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            at = tuple(keys[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _common(h: np.ndarray, doc: np.ndarray, left: int, right: int, within: bool) -> np.ndarray:
    """How many values each two documents share: of all with each other, or of the first `left` with the others."""
    out = np.zeros((left, right), np.int64)
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(h)))
    less = sizes <= DENSE
    for x, y in _within(starts[less], sizes[less]):
        x, y = doc[x], doc[y]
        if not within:
            cross = (x < left) & (y >= left)
            x, y = x[cross], y[cross] - left
        out += np.bincount(x * right + y, minlength=left * right).reshape(left, right)
    starts, sizes = starts[~less], sizes[~less]
    for lo in range(0, len(starts), COLUMNS):
        n = sizes[lo : lo + COLUMNS]
        column = np.repeat(np.arange(len(n)), n)
        row = doc[np.repeat(starts[lo : lo + COLUMNS] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        x = np.zeros((left if within else left + right, len(n)), np.float32)
        x[row, column] = 1
        out += (x @ x.T if within else x[:left] @ x[left:].T).astype(np.int64)  # exact, as counts are small
    return out


def compared(placed: DataFrame, least: float, days: int | None) -> DataFrame:
    """(a, b, jaccard) of the pairs of each cell that overlap by more than `least`."""

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _cells(it):
            t = t.sort_by([("side", "ascending"), ("id", "ascending")])
            ids, day, side = (t.column(x).to_numpy().astype(np.int64) for x in ("id", "day", "side"))
            cell, within, block = t.column("cell")[0].as_py(), t.column("lo")[0].as_py() == t.column("hi")[0].as_py(), t.column("lo")[0].as_py() >= 0
            left = len(ids) if within else int((side == 0).sum())
            right = left if within else len(ids) - left
            if not left or not right:
                continue
            sets = t.column("h").combine_chunks()
            n = pc.list_value_length(sets).to_numpy(zero_copy_only=False).astype(np.int64)
            shared = _common(sets.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(ids)), n), left, right, within)
            first = 0 if within else left
            jaccard = shared / np.maximum(n[:left, None] + n[None, first:] - shared, 1)
            near = jaccard > least
            if within:
                near = np.triu(near, 1)
            if days is not None:
                near &= np.abs(day[:left, None] - day[None, first:]) <= days
            if block:  # a pair with several leaders in common counts where the least of them leads
                leaders = t.column("leaders").combine_chunks()
                each = pc.list_value_length(leaders).to_numpy(zero_copy_only=False).astype(np.int64)
                named, doc = leaders.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(ids)), each)
                near &= _common(named[named < cell], doc[named < cell], left, right, within) == 0
            x, y = np.nonzero(near)
            for lo in range(0, len(x), AT_ONCE):
                a, b = ids[x[lo : lo + AT_ONCE]], ids[first + y[lo : lo + AT_ONCE]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(jaccard[x[lo : lo + AT_ONCE], y[lo : lo + AT_ONCE]])], names=["a", "b", "jaccard"])

    order = ["cell", "lo", "hi"]
    return placed.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "a long, b long, jaccard double")


def _within(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places in the same run, at most about MET at once."""
    for size in np.unique(sizes[sizes > 1]):
        own = starts[sizes == size]
        for i in range(size - 1):
            later = np.arange(i + 1, size)
            step = max(1, MET // len(later))
            for lo in range(0, len(own), step):
                part = own[lo : lo + step, None]
                yield np.broadcast_to(part + i, (len(part), len(later))).ravel(), (part + later).ravel()


def near_pairs(items: DataFrame, least: float = 0.6, days: int | None = 7) -> DataFrame:
    """(a, b, jaccard) of items at most `days` apart, of all where it is None, whose hashed shingle sets overlap by more than `least`. items: (id, day, h), ids and days whole numbers, or (id, day, text) of texts to be shingled.

    Sets meet by the first shingles of each in one order (meeting), which puts
    common ones last, so that boilerplate is not what sets meet by. What met is
    compared in cells of bounded size, a set being sent once to each of its
    cells and not once for each pair. The sets are never stored: shingles travel
    packed by hash, and items are read three times, the third time shingled only
    if they met another.
    """
    texts = "h" not in items.columns
    items = items.select("id", "day", "text" if texts else "h")
    placed = stored(cells(stored(meeting(lowered(items) if texts else items, least, days))))
    own = items.join(F.broadcast(placed) if placed.count() <= BROADCAST else placed, "id")
    own = with_shingles(own, "text", "h") if texts else own
    return compared(own.select("id", "day", "h", F.explode("cells").alias("_c")).select("_c.*", "id", "day", "h"), least, days)


def window_pairs(by: list[str], days: int) -> Column:
    """For counts (by.., day, n) the pairs of a row's items with each other and with those of the same group up to `days` days later; summed, each pair counts once."""
    later = Window.partitionBy(*by).orderBy("day").rangeBetween(1, days)
    n = F.col("n").cast("double")  # exact up to 2 ** 53 pairs
    return n * (n - 1) / 2 + n * F.coalesce(F.sum("n").over(later), F.lit(0))


def duplicate_share(docs: DataFrame, least: float = 0.6, days: int = 7) -> DataFrame:
    """(duplicates, pairs, rate) in one row, over all pairs of docs (doc_id, text, day) at most `days` apart. Duplicates have shingle sets that overlap by more than `least`, or equal texts.

    Copies are never paired: a text is compared once, and its copies enter as counts by day. Null texts equal each other.
    """
    digest = F.sha2(F.coalesce("text", F.lit("\u0000")), 256)
    daily = docs.groupBy(digest.alias("_digest"), "day").agg(F.count("*").alias("n"), F.min("doc_id").alias("_least"))
    counts = stored(daily.select(F.min("_least").over(Window.partitionBy("_digest")).alias("id"), "day", "n"))
    items = distinct_texts(docs).select("id", F.lit(0).alias("day"), "text")
    a, b = (counts.select(F.col("id").alias(x), F.col("day").alias(f"_{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    between = near_pairs(items, least, None).select("a", "b").join(a, "a").join(b, "b").where(F.abs(F.col("_a") - F.col("_b")) <= days)
    near = between.agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("x"))
    same = counts.select(window_pairs(["id"], days).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("x"))
    every = counts.groupBy("day").agg(F.sum("n").alias("n"))  # a row for each day
    pairs = every.select(window_pairs([], days).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("pairs"))
    duplicates = near.unionByName(same).agg(F.sum("x").alias("duplicates"))
    return duplicates.join(F.broadcast(pairs)).select("duplicates", "pairs", rate(F.col("duplicates"), F.col("pairs")).alias("rate"))


def queue_ages(jobs: DataFrame, now: Column) -> DataFrame:
    """(state, jobs, oldest_id, oldest_age_s). jobs: (id, state, ts)."""
    age = (F.unix_micros(now) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / 1e6
    return jobs.groupBy("state").agg(F.count("*").alias("jobs"), F.min_by("id", F.struct("ts", "id")).alias("oldest_id"), F.floor(age).cast("long").alias("oldest_age_s"))


def ratchet(rows: DataFrame, group: str, order: list[str], metric: str) -> DataFrame:
    """Rows with keep: strictly better than the best before."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(metric).over(w)
    return rows.withColumn("best_before", best).withColumn("keep", best.isNull() | (F.col(metric) > best))


def classification_errors(v: Column) -> Column:
    """Names of the rules that a JSON classification breaks; the rules are the fields' types, ranges and a closed set of keys."""
    doc = F.try_parse_json(v)
    #: The categories.
    categories = ["news", "tutorial", "opinion", "review", "ad", "personal", "other"]
    category, language = F.try_variant_get(doc, "$.category", "string"), F.try_variant_get(doc, "$.language", "string")
    spam, topics, summary = F.try_variant_get(doc, "$.isSpam", "boolean"), F.try_variant_get(doc, "$.topics", "array<string>"), F.try_variant_get(doc, "$.summary", "string")
    extra = F.array_except(F.json_object_keys(v), F.array(*[F.lit(k) for k in ("category", "language", "isSpam", "topics", "summary")]))
    fine = F.lit(False)
    return F.array_compact(
        F.array(
            F.when(doc.isNull(), "json"),
            F.when(category.isNull() | ~category.isin(categories), "category"),
            F.when(language.isNull(), "language"),
            F.when(spam.isNull(), "isSpam"),
            F.when(topics.isNull() | (F.size(topics) > 5) | F.exists(topics, lambda t: ~F.length(t).between(1, 40)), "topics"),
            F.when(F.coalesce(F.length(summary) > 400, fine), "summary"),
            F.when(F.coalesce(F.size(extra) > 0, fine), "additional"),
        )
    )
