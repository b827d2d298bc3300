"""Operator 10: shards by a hierarchical weighted hash tree.

Shards hang under racks, racks under regions; a node's weight is the sum of the
weights below it. At each level every child of the chosen node draws an
exponential number from the hash of the document's id and the child's name,
divided by its weight, and the least draw wins: a weighted draw among siblings.
Only the winner's children draw at the next level, so a document costs as many
hashes as its path has siblings, not one for each shard.

A node's draws depend on its own name and weight alone. A changed weight of a
shard changes the weights of its rack and region, so documents move into or out
of these subtrees and nowhere else: between two other regions, racks of an
unchanged region or shards of an unchanged rack, none moves. A shard added under
a new region (as `topology` adds the 41st) takes documents only into itself. A
shard added to a rack that has shards makes its rack and region heavier, so that
documents may also enter these and land beside it.

Defined cases: a null id is a key of its own; a null text counts as empty;
very long texts only count by their size; repeated rows take the same shard and
a slot each; an empty table gives an empty result; a shard of weight 0 gets no
rows; other columns, whatever their names, are kept by `assign` and not read by
`shard_documents`; the column that `assign` adds replaces one of its name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, table, written

N_SHARDS = 40
#: Rows of one shard that one task numbers, about.
BUCKET_ROWS = 50_000


@dataclass(frozen=True)
class Leaf:
    shard: int
    rack: int
    region: int
    weight: float = 1.0


def topology(n_shards: int, per_rack: int = 5, racks_per_region: int = 2, weights: dict[int, float] | None = None) -> list[Leaf]:
    """Shards filled into racks and regions in order."""
    weights = weights or {}
    return [Leaf(s, s // per_rack, s // per_rack // racks_per_region, weights.get(s, 1.0)) for s in range(n_shards)]


def draw(key: Column, name: str, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1) from 53 bits of the hash of key and name."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / F.lit(float(weight))


def drawn(key: Column, level: str, weights: dict[int, float]) -> Column:
    """The number of the child with the least draw. Ties fall to the lower number."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    return F.least(*[F.struct(draw(key, f"{level}-{n}", w).alias("draw"), F.lit(n).alias("n")) for n, w in weights.items()])["n"]


def descend(df: DataFrame, key: Column, leaves: list[Leaf], out: str) -> DataFrame:
    """df with the shard that the descent of key ends in."""
    leaves = [x for x in leaves if x.weight > 0]

    def below(level: str, parent: str | None, at: int | None) -> dict[int, float]:
        found: dict[int, float] = {}
        for x in leaves:
            if parent is None or getattr(x, parent) == at:
                found[getattr(x, level)] = found.get(getattr(x, level), 0.0) + x.weight
        return found

    region, rack = fresh(df, "region"), fresh(df, "rack")
    choice = drawn(key, "region", below("region", None, None))
    df = df.withColumn(region, choice)  # a column for each level, as every branch of the next one asks for it
    for level, parent, column, name in (("rack", "region", region, rack), ("shard", "rack", rack, out)):
        choice = F.lit(None).cast("int")
        for n in sorted({getattr(x, parent) for x in leaves}, reverse=True):
            choice = F.when(F.col(column) == n, drawn(key, level, below(level, parent, n))).otherwise(choice)
        df = df.withColumn(name, choice)
    return df.drop(region, rack)


def assign(df: DataFrame, leaves: list[Leaf], key: str = "doc_id", out: str = "shard") -> DataFrame:
    """df with the shard of each row: a projection, no shuffle."""
    return descend(df, F.coalesce(F.col(key).cast("string"), F.lit("null")), leaves, out)


def numbered(df: DataFrame, group: str, spread: list[str], order: list[str], out: str = "slot", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """df with gapless numbers from 0 in each group, whose rows may be any share of the table.

    Rows of a group are dealt into buckets by the hash of the spread columns;
    each bucket is numbered by itself, after the counts of those before it.
    The number of buckets follows the number of rows.
    """
    n = df.count()
    buckets = max(1, -(-n // bucket_rows))
    dealt = df.withColumn("_b", F.pmod(F.xxhash64(F.lit("slot"), *spread), F.lit(buckets)))
    counts = dealt.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_b").orderBy(*order)
    ranked = dealt.withColumn("_r", F.row_number().over(inside).cast("long") - 1)
    return ranked.join(starts, [group, "_b"]).withColumn(out, F.col("_start") + F.col("_r")).drop("_b", "_r", "_start")


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"))
    rows = assign(rows, topology(n_shards))
    rows = assign(rows, topology(n_shards + 1), out="grown_shard")
    rows = written(rows).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))
    # dealt by their place too, since a third of all rows may be alike
    return numbered(rows, "shard", ["file", "place"], ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), "slot", F.col("grown_shard").cast("int")
    )


def op10_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
