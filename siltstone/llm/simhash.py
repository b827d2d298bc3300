"""Operator 3: SimHash near-duplicates with pivot distance tables.

Texts are fingerprinted in Arrow batches, each whole. Equal fingerprints form
a class, linked without pairs. Every class gets a pivot table: its Hamming
distances to PREFIXES + RANDOM fixed reference fingerprints. The first PREFIXES
have ones in their first 0, 2, 4, .. bits; the others are random.

Pairs meet by the table alone. A differing bit changes the difference of one
pair of neighbouring prefix distances only, so if these differences are cut into
radius + 3 groups, any two fingerprints within radius agree in three groups at
least: each choice of three groups, with the differences in them, is a join key
(about 29 bits of the table's information for radius 2, so groups stay small
when the corpus grows). By the triangle inequality the distances of two such
fingerprints differ by radius at most at every pivot: a pair with a larger
coordinate difference is discarded by the join condition, and survivors are
verified by the Hamming distance itself. Skewed keys are split by Spark at run
time. No pair within the radius is lost.

Defined cases: null text counts as empty; a text without words has fingerprint
zero and links like any other; very long texts are read whole; a null doc_id
takes part and sorts below all; repeated rows are rows of one component; an
empty table gives an empty result; other columns, whatever their names, are not
read by `near_duplicates` and kept by `deduplicated`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import one_row_each, row_key, table, written
from .components import components

BITS = 64
SHINGLE = 3
SEED = 42
RADIUS = 2
#: Reference fingerprints: with ones in the first 0, 2, .. 64 bits, and random ones.
PREFIXES, RANDOM = 33, 15
#: Groups of neighbouring pivots that a key joins.
AGREE = 3

_SET = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """XXH64 of the runs of k words, repeats included; of the whole sequence where there are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[k - 1 :] - 1).tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)


def bits_over_half(hashes: np.ndarray) -> int:
    """Bit b is 1 if over half of the hashes have it."""
    n = len(hashes)
    lanes = hashes.view(np.uint8).reshape(n, 8)
    out = 0
    for lane in range(8):
        ones = np.bincount(lanes[:, lane], minlength=256) @ _SET
        out |= sum(1 << b for b in range(8) if 2 * ones[b] > n) << (8 * lane)
    return out


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    return bits_over_half(shingle_hashes(text, k))


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = np.array([fingerprint(t.as_py(), k) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {doc_type}, fp long")


def pivots() -> list[int]:
    """Reference fingerprints from a rule, as signed longs."""
    step = BITS // (PREFIXES - 1)
    prefixes = [(1 << (step * i)) - 1 for i in range(PREFIXES)]
    raw = np.array([*prefixes, *(xxhash.xxh64_intdigest(f"pivot-{i}", SEED) for i in range(RANDOM))], np.uint64)
    return [int(x) for x in raw.view(np.int64)]


def hamming(a: Column, b: Column | int) -> Column:
    return F.bit_count(a.bitwiseXOR(b if isinstance(b, Column) else F.lit(b)))


def tabled(classes: DataFrame) -> DataFrame:
    """classes with d: the distances of fp to all pivots."""
    return classes.withColumn("d", F.array(*[hamming(F.col("fp"), p).cast("byte") for p in pivots()]))


def meeting_keys(d: Column, radius: int = RADIUS) -> Column:
    """Hashes of the differences of neighbouring prefix distances in each choice of AGREE groups."""
    groups = radius + AGREE
    edges = [round(i * (PREFIXES - 1) / groups) for i in range(groups + 1)]
    steps = [F.array(*[d[j + 1] - d[j] for j in range(lo, hi)]) for lo, hi in zip(edges, edges[1:])]
    return F.array(*[F.xxhash64(F.lit(i), *[steps[g] for g in chosen]) for i, chosen in enumerate(combinations(range(groups), AGREE))])


def within(a: Column, b: Column, radius: int) -> Column:
    """Whether two tables nowhere differ by more than radius."""
    out = F.lit(True)
    for i in range(PREFIXES + RANDOM):
        out = out & (F.abs(a[i] - b[i]) <= radius)
    return out


def close_pairs(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) of the ids of classes (id, fp) whose distinct fingerprints differ in at most radius bits."""
    keyed = tabled(classes).select("id", "fp", "d", F.explode(meeting_keys(F.col("d"), radius)).alias("k"))
    left = keyed.select(*[F.col(c).alias(f"l_{c}") for c in keyed.columns])
    met = left.join(keyed, (F.col("l_k") == F.col("k")) & (F.col("l_fp") < F.col("fp")) & within(F.col("l_d"), F.col("d"), radius))
    return met.where(hamming(F.col("l_fp"), F.col("fp")) <= radius).select(F.col("l_id").alias("a"), F.col("id").alias("b")).distinct()


def rooted(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, id, nulls, root) of each distinct fingerprint of rows (doc_id, fp): root is the least fingerprint of its component."""
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")))
    # a class is named by its fingerprint, and its component by the least fingerprint; ids come back by one aggregation
    found = components(close_pairs(classes.select(F.col("fp").alias("id"), "fp"), radius))
    return classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "id", "nulls", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    rows = written(fingerprints(docs, k))
    named = rooted(rows, radius)
    roots = named.groupBy("root").agg(F.min("id").alias("least"), F.sum("nulls").alias("nulls"))
    ids = written(named.join(roots.select("root", F.when(F.col("nulls") == 0, F.col("least")).alias("component_id")), "root").select("fp", "component_id"))
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: that of the least doc_id, null first, then of the least hash."""
    rows = written(fingerprints(docs.select(row_key().alias("doc_id"), "text"), k))
    keep = rooted(rows, radius).groupBy("root").agg(F.min("id").alias("key"))
    return one_row_each(docs, keep)


def op3_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
