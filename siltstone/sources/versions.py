"""Tables in versions: data first, then one manifest that names it.

A version is a manifest file `manifests/00000007.json`: for each table, the
folder of each of its parts. A change stages its data in a folder of its own,
which no manifest names yet, and then commits: the manifest is written under
another name and renamed to the next number, which a file system does whole or
not at all. So a crash between the phases leaves the old version as it was, a
reader that has opened a version keeps it, and a part that a change does not
touch keeps its files. Two writers that began from one version want the same
number; the rename of the second fails, and it has to begin again.

Rows that a check refuses stand in `quarantine` of the staged folder, with the
reason. A gate limits their share: beyond it nothing is committed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed since the version that this change began from."""


class Refused(RuntimeError):
    """More rows than the gate allows failed their check."""


@dataclass(frozen=True)
class Version:
    number: int = 0
    #: By table and part, the folder of staged data that holds it.
    parts: dict[str, dict[str, str]] = field(default_factory=dict)
    #: Settings that hold for all parts.
    facts: dict[str, float] = field(default_factory=dict)


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def numbers(self) -> list[int]:
        return [int(x.removesuffix(".json")) for x in self._names("manifests") if x.endswith(".json") and x[0] != "."]

    def version(self, number: int | None = None) -> Version:
        """A version, the last one if no number is given; the empty version 0 before the first."""
        number = max(self.numbers(), default=0) if number is None else number
        if not number:
            return Version()
        path = f"{self.root}/manifests/{number:08d}.json"
        text = "".join(r[0] for r in self.spark.read.option("wholetext", True).text(path).collect())
        said = json.loads(text)
        return Version(number, said["parts"], said["facts"])

    def read(self, table: str, version: Version, schema: str) -> DataFrame:
        """A table of a version; later commits don't change it."""
        folders = [f"{self.root}/data/{folder}/{table}/p={part}" for part, folder in sorted(version.parts.get(table, {}).items())]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def stage(self, folder: str | None = None, **tables: DataFrame) -> str:
        """Write tables, each with its parts in a string column `part`, into a folder that no version names yet."""
        folder = folder or uuid.uuid4().hex
        for name, df in tables.items():
            df.withColumn("p", F.col("part")).write.mode("append").partitionBy("p").parquet(f"{self.root}/data/{folder}/{name}")
        return folder

    def staged(self, folder: str, table: str) -> list[str]:
        return [x.removeprefix("p=") for x in self._names(f"data/{folder}/{table}") if x.startswith("p=")]

    def commit(self, base: Version, folder: str, tables: Iterable[str], touched: Iterable[str] | None = None, facts: dict[str, float] | None = None) -> Version:
        """The version after base, in which the touched parts (None: all) of the tables are those staged in the folder."""
        parts = {t: dict(x) for t, x in base.parts.items()}
        touched = None if touched is None else set(touched)
        for table in tables:
            old = parts.get(table, {})
            kept = {} if touched is None else {p: f for p, f in old.items() if p not in touched}
            parts[table] = kept | {p: folder for p in self.staged(folder, table)}
        new = Version(base.number + 1, parts, base.facts if facts is None else facts)
        name = f"{self.root}/manifests/{new.number:08d}.json"
        draft = self._path(f"{self.root}/manifests/.{folder}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps({"parts": new.parts, "facts": new.facts}, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(self._path(name)) or not self._fs.rename(draft, self._path(name)):
            self._fs.delete(draft, False)
            raise Conflict(f"version {new.number} is taken")
        return new

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete manifests but the last few, and staged folders that none of these names; returns the folders."""
        numbers = self.numbers()
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/{n:08d}.json"), False)
        named = {f for n in numbers[-keep:] for parts in self.version(n).parts.values() for f in parts.values()}
        gone = [f for f in self._names("data") if f not in named]
        for f in gone:
            self._fs.delete(self._path(f"{self.root}/data/{f}"), True)
        return gone


def ingested(store: Versions, table: str, rows: DataFrame, reason: Column, part: Column, gate: float = 0.1) -> tuple[Version, str]:
    """Add rows as parts of a table: those with a reason go to quarantine beside it, and more than a share of `gate` of these refuses all.

    Returns the new version and the staged folder, whose quarantine stays for review. The parts that rows go to must be new ones.
    """
    base = store.version()
    judged = rows.withColumn("reason", reason).withColumn("part", part.cast("string"))
    folder = store.stage(quarantine=judged.where(F.col("reason").isNotNull()), **{table: judged.where(F.col("reason").isNull()).drop("reason")})

    def rows_of(name: str) -> int:
        return store.spark.read.parquet(f"{store.root}/data/{folder}/{name}").count() if store.staged(folder, name) else 0

    refused, fine = rows_of("quarantine"), rows_of(table)
    if refused > gate * (refused + fine):
        raise Refused(f"{refused} of {refused + fine} rows were refused; they stand in {folder}/quarantine")
    return store.commit(base, folder, [table], store.staged(folder, table)), folder
