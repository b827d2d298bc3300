"""Operator 9: quality by an interpolated modified Kneser-Ney 3-gram model.

Trusted text is that of all labelled rows with quality 1 and toxic 0 but the
held-out ones (per_language and max_chars bound it where a caller gives them).
Its 3-grams are counted once; continuation counts of
the lower orders, the three discounts of each order and language, and the
probabilities and back-off weights come from joins of count tables.

A backed-off log probability is a sum over the n-grams of a text. With
  one(w)        = p1(w) - unseen + b2(w)
  two(v, w)     = b3(v, w) + p2(v, w) - b2(v) - p1(w)
  three(u, v, w) = p3(u, v, w) - b3(u, v) - p2(v, w)
(log10, terms that the model lacks count as 0), that of a token whose 3-gram is
known adds up to p3, of one whose 2-gram is known to b3 + p2, of any other to
b3 + b2 + p1. So one table of weights by n-gram is joined with the n-grams of
the documents, in shards by the hash of the n-gram, and the products of weight
and count are summed by document: its perplexity is 10 ** (-sum / tokens).
The weights of the HOT words with most different words before them and a bitmap
of all other n-grams, of 2 ** MOST_WIDTH bits at most, travel to the executors, so that the n-grams which
the model can't hold are not shuffled; all others meet their weights in the
join, packed by shard. Shards grow in number with the model, so that a task
holds about SHARD_KEYS weights of it. Keys are whole 64-bit hashes.

One in HOLD_OUT trusted rows, by the hash of the id, is never trained on. The
limit of a language is the `quantile` of the perplexities of all its trusted
rows that the model has not seen, times `slack`; languages without such rows
take the limit of all.

Defined cases: null text counts as empty; a text without words has perplexity
null and is not kept; very long texts are scored whole; a null language is a
language of its own; languages without trusted rows are scored by the shared
model or, without one, by the unseen word's probability for each word; repeated
rows are scored alike; empty tables (no documents or labels) give a model
without n-grams, an empty limit, and keep every text with words; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, table, written

#: Languages with a model of their own, by trusted rows; all others share OTHER.
LANGUAGES = 16
OTHER = "\x03"
QUANTILE = 0.99
SLACK = 1.1
HOLD_OUT = 5
SHARD_BITS = 4  # upper bits of a key, for models of up to 2 ** SHARD_BITS * SHARD_KEYS n-grams
SHARD_KEYS = 1 << 22
#: N-grams that a task packs at once, and documents at most (their places take 16 bits).
PAIRS, PLACES = 1 << 21, 1 << 16
#: Tokens whose 3-grams a task counts before they are shuffled.
TOKENS = 1 << 19
#: Bytes of documents for which a shard of 2 ** SHARD_BITS gets one more task.
SALT_BYTES = 2 << 30
#: Spark states about 2 ** 63 bytes for rows of unknown size.
UNKNOWN_BYTES = 1 << 58
#: Slots of the bitmap for each n-gram, and log2 of all its slots at most; a full one lets more n-grams pass, to the same sums.
SLOTS, MOST_WIDTH = 8, 27
#: Words that travel; all others are joined.
HOT = 1 << 18
#: Log10 probability of a word in a language that the model has not seen.
UNSEEN = -7.0

START, STOP = "\x01", "\x02"
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def hashed_longs(values: np.ndarray, seeds: np.ndarray | int = 42) -> np.ndarray:
    """XXH64 of 8-byte integers, as the xxhash64 function gives it; chained by the hash before as the seed."""
    r = np.uint64

    def turned(x: np.ndarray, n: int) -> np.ndarray:
        return x << r(n) | x >> r(64 - n)

    with np.errstate(over="ignore"):
        h = (r(seeds) if isinstance(seeds, int) else seeds) + _P5 + r(8)
        h = h ^ turned(values * _P2, 31) * _P1
        h = turned(h, 27) * _P1 + _P4
        h ^= h >> r(33)
        h *= _P2
        h ^= h >> r(29)
        h *= _P3
        h ^= h >> r(32)
    return h


def trusted_rows(docs: DataFrame, labels: DataFrame, per_language: int | None = None, max_chars: int | None = None) -> DataFrame:
    """(doc_id, lang, text) of all trusted rows that are not held out; of bounded ones where bounds are given: the per_language rows of least id hash in each language, of at most max_chars characters."""
    good = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id").distinct()
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text").where(F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(HOLD_OUT)) != 0)
    rows = rows.where(F.col("text").isNotNull() if max_chars is None else F.length("text") <= max_chars).join(good, "doc_id", "left_semi")
    most = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    rows = rows.withColumn("lang", F.when(F.col("lang").isin([r.lang for r in most]), F.col("lang")).otherwise(F.lit(OTHER)))
    if per_language is None:
        return rows
    fit = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("o"))
    for cols in (["lang", F.pmod("o", F.lit(64))], ["lang"]):
        order = Window.partitionBy(*cols).orderBy("o", "doc_id")
        fit = fit.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    return rows.join(fit.select("doc_id").distinct(), "doc_id", "left_semi")


def hashed_words(names: list[str], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of language and word, of each text with two starts before and a stop behind, and their number (0 without words)."""
    digest = xxhash.xxh64_intdigest
    flat: list[int] = []
    sizes = []
    seeds = {x: digest(x.encode("utf-8", "surrogatepass"), 42) for x in set(names)}
    ends = {x: (digest(START.encode(), s), digest(STOP.encode(), s)) for x, s in seeds.items()}
    for name, t in zip(names, texts):
        words = (t or "").encode("utf-8", "surrogatepass").split()
        sizes.append(len(words) + 3 if words else 0)
        if words:
            seed, (start, stop) = seeds[name], ends[name]
            flat += [start, start]
            flat += [digest(w, seed) for w in words]
            flat.append(stop)
    return np.array(flat, np.uint64), np.array(sizes, np.int64)


def trigrams(rows: DataFrame) -> DataFrame:
    """(lang, u, v, w, n) of the 3-grams of words, padded by two starts and a stop, counted by task. A word is the 64-bit hash of language and word."""

    def counts(lang: str, parts: list[np.ndarray]) -> pa.RecordBatch:
        u, v, w = np.concatenate(parts, axis=1)
        order = np.lexsort((w, u, v))
        u, v, w = u[order], v[order], w[order]
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1])
        starts = np.flatnonzero(new)
        n = np.diff(np.append(starts, len(u)))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *(pa.array(x[starts].view(np.int64)) for x in (u, v, w)), pa.array(n)], names=["lang", "u", "v", "w", "n"])

    def made(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}
        for b in it:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                langs = part.column(0).to_pylist()
                flat, sizes = hashed_words(langs, part.column(1).to_pylist())
                edges = np.append(0, np.cumsum(sizes)).tolist()
                for lang, a, z in zip(langs, edges[:-1], edges[1:]):
                    if a < z:
                        x = flat[a:z]
                        held.setdefault(lang, []).append(np.stack([x[:-2], x[1:-1], x[2:]]))
                        size[lang] = size.get(lang, 0) + z - a
                        if size[lang] >= TOKENS:
                            yield counts(lang, held.pop(lang))
                            size[lang] = 0
        for lang, parts in held.items():
            yield counts(lang, parts)

    return rows.select("lang", "text").mapInArrow(made, "lang string, u long, v long, w long, n long")


def counted(grams: DataFrame) -> DataFrame:
    """Distinct 3-grams with their count c, the continuation count c2 of (v, w), and for the contexts (u, v) and (v) the
    totals and how many n-grams have a count of 1, 2, 3 or more. One shuffle, by v: all these groups lie within it.

    firsts mark one row of each (v, w), (u, v) and (v).
    """
    uv, vw, v = (Window.partitionBy("lang", *x) for x in (["u", "v"], ["v", "w"], ["v"]))
    x = grams.repartition("lang", "v").groupBy("lang", "u", "v", "w").agg(F.sum("n").alias("c"))
    x = x.withColumns({"total3": F.sum("c").over(uv), **{f"a{i}": F.sum((F.least("c", F.lit(3)) == i).cast("int")).over(uv) for i in (1, 2, 3)}, "first_uv": F.row_number().over(uv.orderBy("w")) == 1})
    x = x.withColumns({"c2": F.count("*").over(vw), "first_vw": F.row_number().over(vw.orderBy("u")) == 1})
    return x.withColumns({"total2": F.count("*").over(v), **{f"b{i}": F.sum((F.col("first_vw") & (F.least("c2", F.lit(3)) == i)).cast("int")).over(v) for i in (1, 2, 3)}, "first_v": F.row_number().over(v.orderBy("u", "w")) == 1})


def discounts(counts: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) from the counts of counts; without them a flat 0.75."""
    n = counts.groupBy("lang").agg(*[F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    out = [F.when((F.col("n1") > 0) & (F.col(f"n{i}") > 0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")) for i in (1, 2, 3)]
    return n.select("lang", *[F.greatest(F.lit(0.05), F.least(F.coalesce(x, F.lit(0.75)), F.lit(i - 0.05))).alias(f"d{i}") for i, x in enumerate(out, 1)])


def discount(c: Column, order: str = "") -> Column:
    return F.when(c == 1, F.col(f"{order}d1")).when(c == 2, F.col(f"{order}d2")).otherwise(F.col(f"{order}d3"))


def model(rows: DataFrame) -> dict[str, DataFrame]:
    """one (key, value): weights of the HOT words with the highest counts; more (shard, keys, at): those of all other n-grams, packed; unseen (lang, value); bits: of the shards."""
    base = written(counted(trigrams(rows)))
    c1 = written(base.where("first_vw").groupBy("lang", "w").agg(F.count("*").alias("c")))
    sums = c1.join(F.broadcast(discounts(c1)), "lang")  # one row per language, LANGUAGES + 1 at most
    totals = sums.groupBy("lang").agg(F.sum("c").alias("total"), F.sum(discount(F.col("c"))).alias("held"), F.count("*").alias("kinds"))  # one row per language
    one = sums.join(F.broadcast(totals), "lang").withColumn("unseen", F.col("held") / F.col("total") / (F.col("kinds") + 1))
    p1 = written(one.select("lang", "w", "c", "unseen", ((F.col("c") - discount(F.col("c"))) / F.col("total") + F.col("unseen")).alias("p")))
    unseen = p1.groupBy("lang").agg(F.log10(F.first("unseen")).alias("value"))
    lower = p1.select("w", F.col("p").alias("lower"))  # a word's hash holds its language
    hot = written(p1.orderBy(F.desc("c"), "w").limit(HOT).select("w", F.col("p").alias("lower")))
    own = {n: discounts(x).select("lang", *[F.col(f"d{i}").alias(f"{n}d{i}") for i in (1, 2, 3)]) for n, x in (("t", base.select("lang", "c")), ("s", base.where("first_vw").select("lang", F.col("c2").alias("c"))))}
    sized = base.join(F.broadcast(own["t"]), "lang").join(F.broadcast(own["s"]), "lang")
    weight2 = sum((F.col(f"sd{i}") * F.col(f"b{i}") for i in (2, 3)), F.col("sd1") * F.col("b1")) / F.col("total2")
    weight3 = sum((F.col(f"td{i}") * F.col(f"a{i}") for i in (2, 3)), F.col("td1") * F.col("a1")) / F.col("total3")
    sized = sized.withColumns({"weight2": weight2, "weight3": weight3})
    full = sized.select("u", "v", "w", "c", "c2", "total2", "total3", "weight2", "weight3", "first_vw", "first_uv", *[f"{x}d{i}" for x in "ts" for i in (1, 2, 3)])
    full = full.join(F.broadcast(hot), "w", "left")  # HOT rows
    full = full.where(F.col("lower").isNotNull()).unionByName(full.where(F.col("lower").isNull()).drop("lower").join(lower, "w"))
    full = full.withColumn("p2", (F.col("c2") - discount(F.col("c2"), "s")) / F.col("total2") + F.col("weight2") * F.col("lower"))
    full = full.withColumn("p3", (F.col("c") - discount(F.col("c"), "t")) / F.col("total3") + F.col("weight3") * F.col("p2"))

    def entry(value: Column, *words: str, once: str | None = None) -> Column:
        made = F.struct(F.xxhash64(*words).alias("key"), F.log10(value).alias("value"))
        return F.when(F.col(once), made) if once else made

    entries = F.array(
        entry(F.col("p2") / F.col("weight2") / F.col("lower"), "v", "w", once="first_vw"),
        entry(F.col("weight3"), "u", "v", once="first_uv"),
        entry(F.col("p3") / F.col("weight3") / F.col("p2"), "u", "v", "w"),
    )
    more = full.select(F.explode_outer(entries).alias("e")).where(F.col("e").isNotNull()).select("e.key", "e.value")
    words = p1.select(F.col("w").alias("key"), F.log10(F.col("p") / F.col("unseen")).alias("value"))
    words = words.unionByName(sized.where("first_v").select(F.col("v").alias("key"), F.log10("weight2").alias("value"))).groupBy("key").agg(F.sum("value").alias("value"))
    words = written(words.join(F.broadcast(hot.select(F.col("w").alias("key"), F.lit(True).alias("hot"))), "key", "left"))
    more = more.unionByName(words.where(F.col("hot").isNull()).select("key", "value"))
    n = base.agg(F.count("*"), *[F.count_if(x) for x in ("first_vw", "first_uv")]).first()
    bits = max(SHARD_BITS, (max(sum(n) - 1, 0) // SHARD_KEYS).bit_length())
    tables = {
        "one": written(words.where("hot").select("key", "value")),
        "more": written(more.mapInArrow(lambda it: packed_weights(it, bits), "shard int, keys binary, at binary")),
        "unseen": written(unseen),
        "bits": bits,
    }
    for x in (base, c1, p1, hot, words):
        drop(x)
    return tables


def squeezed(x: np.ndarray) -> bytes:
    """An array as compressed planes of its bytes."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(b: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    raw = pa.decompress(b[8:], n, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def shard_edges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each shard begins among sorted keys, and where the last one ends."""
    starts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    return np.append(starts, len(keys))


def packed_weights(it: Iterator[pa.RecordBatch], bits: int = SHARD_BITS) -> Iterator[pa.RecordBatch]:
    """(key, value) rows as blocks of one shard: ascending keys and their values."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def blocks() -> pa.RecordBatch:
        keys, values = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys)
        keys, values = keys[order], values[order].astype(np.float32)
        edges = shard_edges(keys, bits)
        some = [s for s in range(1 << bits) if edges[s] < edges[s + 1]]
        parts = [slice(edges[s], edges[s + 1]) for s in some]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([keys[p].tobytes() for p in parts], pa.binary()), pa.array([values[p].tobytes() for p in parts], pa.binary())], names=["shard", "keys", "at"])

    for b in it:
        held.append((b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()))
        if sum(len(k) for k, _ in held) >= PAIRS:
            yield blocks()
    if any(len(k) for k, _ in held):
        yield blocks()


class Known:
    """A bitmap of the keys in packed weights; says yes to each of them, and to one in SLOTS of others at most unless it is full."""

    def __init__(self, more: DataFrame) -> None:
        keys = more.agg(F.sum(F.length("keys") / 8)).first()[0] or 0
        self.width = min(MOST_WIDTH, max(16, int(keys * SLOTS - 1).bit_length()))
        size, shift = 1 << self.width, np.uint64(64 - self.width)

        def maps(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(size, bool)
            for b in it:
                for keys in b.column(0).to_pylist():
                    bits[(np.frombuffer(keys, np.uint64) >> shift).astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays([pa.array([squeezed(np.packbits(bits))], pa.binary())], names=["bits"])

        self.bits = np.zeros(size >> 3, np.uint8)
        for row in more.select("keys").mapInArrow(maps, "bits binary").toLocalIterator():
            self.bits |= unsqueezed(bytes(row.bits), np.uint8)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> np.uint64(64 - self.width)).astype(np.int64)
        return (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


class Grams:
    """What travels to the executors: the bitmap, the frequent words' weights and each language's unseen word."""

    def __init__(self, tables: dict[str, DataFrame]) -> None:
        one = tables["one"].toArrow()  # HOT words at most
        keys = one.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], one.column("value").to_numpy()[order]
        self.known = Known(tables["more"])
        self.unseen = {r.lang: r.value for r in tables["unseen"].collect()}  # one row per language

    def __call__(self, langs: list[str | None], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the tokens (0 without words) and the frequent words' share of its log10 probability; the (text, key) of other n-grams that the model may hold."""
        names = [x if x in self.unseen else OTHER for x in (y or "" for y in langs)]
        h, sizes = hashed_words(names, texts)
        tokens = np.maximum(sizes - 2, 0)
        base = tokens * np.array([self.unseen.get(x, UNSEEN) for x in names])
        if not len(h):
            return tokens, base, np.zeros(0, np.int64), np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        second = np.flatnonzero(place >= 1)  # the first start mark is no context of its own
        rare = second
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h[second]), len(self.keys) - 1)
            hit = self.keys[at] == h[second]
            base = base + np.bincount(owner[second], np.where(hit, self.values[at], 0.0), len(sizes))
            rare = second[~hit]
        two = hashed_longs(h[second], hashed_longs(h[second - 1]))
        third = np.flatnonzero(place[second] >= 2)
        three = hashed_longs(h[second[third]], two[third - 1])
        keys, owners = np.concatenate([h[rare], two, three]), np.concatenate([owner[rare], owner[second], owner[second[third]]])
        held = self.known(keys)
        return tokens, base, owners[held], keys[held]


def joined(docs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(chunk, part, docs, sums): of each chunk of documents once their rows with the words' share, and of each shard the sums of its n-grams' weights."""
    spark = docs.sparkSession
    bits = tables["bits"]
    shards = 1 << bits
    grams = spark.sparkContext.broadcast(Grams(tables))  # HOT words and 2 ** MOST_WIDTH bits at most
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    size = size if size < UNKNOWN_BYTES else 0
    salts = max(1, -(-spark.sparkContext.defaultParallelism // shards), -(-(size >> (bits - SHARD_BITS)) // SALT_BYTES))  # tasks for each shard: all cores have work, none reads much more than 100 MB
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    rows_type = f"array<struct<doc_id:{doc_type},lang:string,n_tokens:bigint,base:double>>"
    arrow_docs = docs.select("doc_id", "lang").limit(0).toArrow().schema
    arrow_rows = pa.list_(pa.struct([("doc_id", arrow_docs.field(0).type), ("lang", pa.string()), ("n_tokens", pa.int64()), ("base", pa.float64())]))

    def chunks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        rows: list[dict] = []
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def chunk() -> pa.RecordBatch:
            place, keys = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((place, keys))
            place, keys = place[order], keys[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (place[1:] != place[:-1])
            starts = np.flatnonzero(new)
            times = np.diff(np.append(starts, len(keys)))  # of an n-gram in a document
            place, keys = place[starts].astype(np.uint16), keys[starts]
            edges = shard_edges(keys, bits)
            out = {"shard": [n % shards], "keys": [None], "at": [None], "docs": [rows]}
            for s in range(shards):
                own = slice(edges[s], edges[s + 1])
                if edges[s] < edges[s + 1]:
                    distinct, many = np.unique(keys[own], return_counts=True)
                    steps = np.diff(distinct, prepend=np.uint64(0))
                    parts = [squeezed(x) for x in (steps, many.astype(np.uint32), place[own], times[own].astype(np.uint32))]
                    out["shard"].append(s)
                    out["keys"].append(parts[0])
                    out["at"].append(b"".join(len(p).to_bytes(8, "little") + p for p in parts[1:]))
                    out["docs"].append(None)
            size = len(out["shard"])
            fixed = [pa.array(out["shard"], pa.int32()), pa.array([task % salts] * size, pa.int32()), pa.array([task << 24 | n] * size, pa.int64())]
            return pa.RecordBatch.from_arrays([*fixed, pa.array(out["keys"], pa.binary()), pa.array(out["at"], pa.binary()), pa.array(out["docs"], arrow_rows)], names=["shard", "salt", "chunk", "keys", "at", "docs"])

        for b in it:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids, langs = part.column(0).to_pylist(), part.column(1).to_pylist()
                tokens, base, owners, keys = grams.value(langs, part.column(2).to_pylist())
                found.append((owners + len(rows), keys))
                rows += [{"doc_id": i, "lang": x, "n_tokens": t, "base": v} for i, x, t, v in zip(ids, langs, tokens.tolist(), base.tolist())]
                if sum(len(k) for _, k in found) >= PAIRS or len(rows) > PLACES - 256:
                    yield chunk()
                    rows, n = [], n + 1
                    found.clear()
        if rows:
            yield chunk()

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, blocks, keys, values = None, [], np.zeros(0, np.uint64), np.zeros(0)
        for b in it:
            for own, chunk, packed, at, rows in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), b.column(5)):
                if own != shard:
                    shard, blocks, keys, values = own, [], np.zeros(0, np.uint64), np.zeros(0)
                if chunk < 0:  # weights come first
                    blocks.append((np.frombuffer(packed, np.uint64), np.frombuffer(at, np.float32)))
                    continue
                if blocks:
                    every = np.concatenate([k for k, _ in blocks])
                    keys, where = np.unique(every, return_inverse=True)
                    values = np.bincount(where, np.concatenate([v for _, v in blocks]).astype(np.float64), len(keys))
                    blocks = []
                total = None
                if packed is not None:
                    arrays, left = [], at
                    for kind in (np.uint32, np.uint16, np.uint32):
                        size = int.from_bytes(left[:8], "little")
                        arrays.append(unsqueezed(left[8 : 8 + size], kind))
                        left = left[8 + size :]
                    many, place, times = arrays
                    asked = np.cumsum(unsqueezed(packed, np.uint64), dtype=np.uint64)
                    i = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
                    weight = np.where(keys[i] == asked, values[i], 0.0) if len(keys) else np.zeros(len(asked))
                    total = np.bincount(place, np.repeat(weight, many) * times)
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([own], pa.int32()), pa.array([rows.as_py()], arrow_rows), pa.array([total], pa.list_(pa.float64()))], names=["chunk", "part", "docs", "sums"])

    asked = docs.select("doc_id", "lang", "text").mapInArrow(chunks, f"shard int, salt int, chunk long, keys binary, at binary, docs {rows_type}")
    weights = tables["more"].select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(-1).cast("long").alias("chunk"), "keys", "at", F.lit(None).cast(rows_type).alias("docs"))
    met = asked.unionByName(weights).repartition(shards * salts, "shard", "salt").sortWithinPartitions("shard", "salt", "chunk")
    return met.mapInArrow(sums, f"chunk long, part int, docs {rows_type}, sums array<double>")


def scores(docs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, lang, n_tokens, perplexity) of every row of docs. Sums are added in the order of shards, so they are the same in every run."""
    parts = joined(docs, tables).groupBy("chunk").agg(
        F.first("docs", ignorenulls=True).alias("docs"),
        F.array_sort(F.collect_list(F.when(F.col("sums").isNotNull(), F.struct("part", "sums")))).alias("parts"),  # one for each shard
    )
    total = F.aggregate("parts", F.transform("docs", lambda x: x["base"]), lambda a, p: F.zip_with(a, p["sums"], lambda x, y: x + F.coalesce(y, F.lit(0.0))))
    rows = parts.select("docs", total.alias("totals")).select(F.explode_outer(F.arrays_zip("docs", "totals")).alias("x")).select("x.docs.*", F.col("x.totals").alias("lp"))
    perplexity = F.when(F.col("n_tokens") > 0, F.pow(F.lit(10.0), F.least(-F.col("lp") / F.col("n_tokens"), F.lit(300.0))))
    return rows.select("doc_id", "lang", "n_tokens", perplexity.alias("perplexity"))


def classified(docs: DataFrame, labels: DataFrame, per_language: int | None = None, max_chars: int | None = None, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """(doc_id, lang, n_tokens, perplexity, max_perplexity, kept) of every row."""
    trusted = trusted_rows(docs, labels, per_language, max_chars)
    tables = model(trusted)
    rows = written(scores(docs, tables))
    for x in ("one", "more"):
        drop(tables[x])
    sample = written(trusted.select("doc_id", "lang"))
    good = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id").distinct()
    known = [r.lang for r in sample.select("lang").distinct().collect()]  # LANGUAGES + 1 at most
    name = F.coalesce("lang", F.lit(""))
    rows = rows.withColumn("name", F.when(name.isin(known), name).otherwise(F.lit(OTHER)))
    unseen = rows.where(F.col("perplexity").isNotNull()).join(good, "doc_id", "left_semi").join(sample.select("doc_id").distinct(), "doc_id", "left_anti")
    limit = (F.percentile_approx("perplexity", quantile, 10_000) * slack).alias("own")
    own = unseen.groupBy("name").agg(limit)
    every = unseen.agg(limit.alias("every")).first().every  # one number
    out = rows.join(F.broadcast(own), "name", "left")
    out = out.withColumn("max_perplexity", F.coalesce(F.col("own"), F.lit(every).cast("double")))
    kept = F.col("perplexity").isNotNull() & (F.col("max_perplexity").isNull() | (F.col("perplexity") <= F.col("max_perplexity")))
    return out.select("doc_id", "lang", "n_tokens", "perplexity", "max_perplexity", kept.alias("kept"))


def op9_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
