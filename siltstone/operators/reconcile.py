"""Reconciliation of manifests, summaries and settings; hash chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.session import stored


def manifest_status(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status): ok, missing, sha_mismatch, size_mismatch. Both sides: (path, sha256, size)."""
    f = found.select("path", F.col("sha256").alias("_sha"), F.col("size").alias("_size"))
    status = F.when(F.col("_sha").isNull(), "missing").when(F.col("_sha") != F.col("sha256"), "sha_mismatch").when(F.col("_size") != F.col("size"), "size_mismatch").otherwise("ok")
    return manifest.join(f, "path", "left").select("path", status.alias("status"))


def name_difference(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Names whose number differs between both sides."""
    a = left.groupBy(name).agg(F.count("*").alias("left_n"))
    b = right.groupBy(name).agg(F.count("*").alias("right_n"))
    both = a.join(b, name, "full_outer").select(name, F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n"))
    return both.where(F.col("left_n") != F.col("right_n"))


def field_mismatches(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, left, right) of unequal fields, null-safe."""

    def tall(df: DataFrame, side: str) -> DataFrame:
        pairs = ", ".join(f"'{f}', cast(`{f}` as string)" for f in fields)
        return df.selectExpr(key, f"stack({len(fields)}, {pairs}) as (field, {side})")

    both = tall(left, "left").join(tall(right, "right"), [key, "field"], "full_outer")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))


def check_map(checks: Column) -> Column:
    """Array of struct(name, ok) to a map; the last of a name wins, null is false."""
    return F.map_from_entries(F.transform(checks, lambda c: F.struct(c["name"], F.coalesce(c["ok"], F.lit(False)))))


def orphans(previous: DataFrame, live: DataFrame, current: DataFrame, prefix: str, retired: list[str]) -> DataFrame:
    """Paths to prune: managed once, or named as managed, and no longer shipped. An empty current list prunes nothing. All: (path)."""
    name = F.element_at(F.split("path", "/"), -1)
    before = previous.select("path").distinct().withColumn("_before", F.lit(True))
    seen = previous.select("path").unionByName(live.select("path")).distinct().join(before, "path", "left")
    managed = F.col("_before").isNotNull() | name.startswith(prefix) | name.isin(retired)
    if current.isEmpty():
        return seen.select("path").limit(0)
    return seen.where(managed).join(current.select("path"), "path", "left_anti").select("path")


def merged_entries(user: DataFrame, kit: DataFrame, keys: list[str], position: str) -> DataFrame:
    """User entries, then the kit's that no user entry equals on keys; order kept."""
    both = user.withColumn("_side", F.lit(0)).unionByName(kit.withColumn("_side", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy("_side", position)
    return both.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select(*keys, F.col("_side").alias("side"), position)


def ordered_union(current: Column, incoming: Column, retired: Column) -> Column:
    return F.array_distinct(F.concat(F.array_except(current, retired), incoming))


def without_handlers(hooks: Column, command: str) -> Column:
    """map<event, array<struct<matcher, hooks array<struct<command>>>>> without a command, its empty parents gone."""
    kept = F.transform_values(hooks, lambda _, entries: F.filter(F.transform(entries, lambda e: F.struct(e["matcher"].alias("matcher"), F.filter(e["hooks"], lambda h: h["command"] != command).alias("hooks"))), lambda e: F.size(e["hooks"]) > 0))
    return F.map_filter(kept, lambda _, entries: F.size(entries) > 0)


def findings(df: DataFrame, dependencies: str = "dependencies") -> DataFrame:
    """Flat (package, version, id, fix_versions, description) of dependencies and their vulnerabilities."""
    d = df.select(F.explode(dependencies).alias("d")).select("d.name", "d.version", F.explode("d.vulns").alias("v"))
    fixes = F.when(F.size("v.fix_versions") > 0, F.col("v.fix_versions")).otherwise(F.coalesce("v.fixes", F.array().cast("array<string>")))
    return d.select(F.col("name").alias("package"), "version", F.coalesce(F.nullif("v.id", F.lit("")), "v.name").alias("id"), fixes.alias("fix_versions"), F.substring(F.trim(F.translate("v.description", "\n", " ")), 1, 240).alias("description"))


def chain_status(lines: DataFrame, key: str, order: str, content: str, prev: str) -> DataFrame:
    """Each line with ok: prev is null in an unchained prefix, and else the hash of the line before. lines: one chain per key."""
    w = Window.partitionBy(key).orderBy(order)
    chained = F.max(F.col(prev).isNotNull()).over(w.rowsBetween(Window.unboundedPreceding, -1))
    before = F.lag(F.sha2(content, 256)).over(w)
    ok = F.when(F.col(prev).isNull(), ~F.coalesce(chained, F.lit(False))).otherwise(before.isNull() | (F.col(prev) == before))
    return lines.withColumn("ok", ok)


def nearest_ancestor(paths: DataFrame, markers: DataFrame) -> DataFrame:
    """(path, root): the deepest marked folder above each path, or null. markers: (folder)."""
    parts = F.split("path", "/")
    above = paths.select("path", F.explode(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))).alias("depth"))
    above = above.withColumn("folder", F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("depth")), "/"))
    found = above.join(markers.select("folder"), "folder").groupBy("path").agg(F.max_by("folder", "depth").alias("root"))
    return paths.join(found, "path", "left")


def user_scalars(user: DataFrame, kit: DataFrame, key: str = "name", value: str = "value") -> DataFrame:
    """(key, value): single settings, of which the user's own win over the kit's."""
    both = kit.select(key, F.col(value).alias("_kit")).join(user.select(key, F.col(value).alias("_own")), key, "full_outer")
    return both.select(key, F.coalesce("_own", "_kit").alias(value))


def before_each(rows: DataFrame, order: str, value: Column, out: str, parts: int | None = None) -> DataFrame:
    """rows with the value of the row before each in one order over all of them; null at the first. Equal orders follow in no fixed order.

    No task reads all rows: ranges of the order are looked at by themselves, and
    the first row of each takes the value that the last row of the range before
    it left, from a table of one row for each range.
    """
    n = parts or max(2, rows.sparkSession.sparkContext.defaultParallelism)
    dealt = stored(rows.withColumn("_v", F.struct(value.alias("v"))).repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(order)
    own = dealt.withColumn("_before", F.lag("_v").over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    lasts = dealt.groupBy("_part").agg(F.max_by("_v", order).alias("_last"))
    heads = lasts.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_head"))  # a row for each range
    joined = own.join(F.broadcast(heads), "_part")
    return joined.withColumn(out, F.when(F.col("_first"), F.col("_head")).otherwise(F.col("_before"))["v"]).drop("_part", "_v", "_before", "_first", "_head")


def chained(rows: DataFrame, order: str, content: str, parts: int | None = None) -> DataFrame:
    """rows as one chain: prev_sha is the hash of the line before, null at the first."""
    return before_each(rows, order, F.sha2(content, 256), "prev_sha", parts)


def whole_chain_status(lines: DataFrame, order: str, content: str, prev: str, parts: int | None = None) -> DataFrame:
    """As chain_status for one chain of any length: lines with ok. The unchained prefix ends with the first line that has a prev."""
    start = lines.where(F.col(prev).isNotNull()).agg(F.min(order)).first()[0]  # one value
    seen = before_each(lines, order, F.sha2(content, 256), "_sha", parts)
    prefix = F.lit(True) if start is None else F.col(order) < F.lit(start)
    return seen.withColumn("ok", F.when(F.col(prev).isNull(), prefix).otherwise(F.col("_sha").isNull() | (F.col(prev) == F.col("_sha")))).drop("_sha")
