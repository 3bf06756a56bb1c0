"""Tables that readers see change at once: data under paths of their own, and a manifest that names what is current.

A commit writes its tables first, each to a new path, and then one small file: the
rows (table, path, note) of all tables as they now are, under the next version's
number. The file appears by the rename that ends Spark's write, so a reader sees
the version before or the whole new one. A write that dies leaves paths that no
manifest names. A table may have several paths: appending adds one and writes no
old row again.

One writer at a time commits to a folder; any number read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "table string, path string, note string"


@dataclass(frozen=True)
class Snapshot:
    """version: of the folder, 0 before the first commit. paths: of each table. notes: what its writer noted of it."""

    version: int
    paths: dict[str, list[str]]
    notes: dict[str, str | None]


def current(spark: SparkSession, folder: str, version: int | None = None) -> Snapshot:
    """What a folder holds now, or held as of a version."""
    try:
        rows = spark.read.schema(MANIFEST).option("basePath", f"{folder}/manifests").json(f"{folder}/manifests")
    except AnalysisException:
        return Snapshot(0, {}, {})
    if "version" not in rows.columns:
        return Snapshot(0, {}, {})
    if version is not None:
        rows = rows.where(F.col("version") <= version)
    # A row for each path of the latest version.
    latest = rows.agg(F.max("version")).first()[0]
    if latest is None:
        return Snapshot(0, {}, {})
    paths: dict[str, list[str]] = {}
    notes: dict[str, str | None] = {}
    for r in rows.where(F.col("version") == latest).orderBy("table", "path").collect():
        paths.setdefault(r["table"], []).append(f"{folder}/{r['path']}")
        notes[r["table"]] = r["note"]
    return Snapshot(int(latest), paths, notes)


def read(spark: SparkSession, folder: str, name: str, at: Snapshot | None = None) -> DataFrame:
    """A table as of a snapshot, the current one if none is given."""
    at = at or current(spark, folder)
    if name not in at.paths:
        raise ValueError(f"no table {name} in version {at.version}")
    return spark.read.parquet(*at.paths[name])


class Commit:
    """New tables of one version: ``write`` them, read them back while they are not yet seen, then ``publish``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.base = spark, folder, current(spark, folder)
        self.new: dict[str, list[str]] = {}
        self.notes: dict[str, str | None] = {}

    def write(self, name: str, rows: DataFrame, append: bool = False, note: str | None = None) -> DataFrame:
        """Write a table, in the place of the one before or behind it; gives the rows as written."""
        path = f"data/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{path}")
        before = [p.removeprefix(f"{self.folder}/") for p in self.base.paths.get(name, [])] if append else []
        self.new[name] = [*self.new.get(name, before), path] if append else [path]
        self.notes[name] = note
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{path}")

    def publish(self) -> int:
        """Make the new tables current, together with those that were not written."""
        kept = {n: [p.removeprefix(f"{self.folder}/") for p in ps] for n, ps in self.base.paths.items()}
        notes = self.base.notes | self.notes
        rows = [(n, p, notes.get(n)) for n, ps in (kept | self.new).items() for p in ps]
        version = self.base.version + 1
        # One file: it is there by its rename, or it isn't.
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error").json(f"{self.folder}/manifests/version={version}")
        return version
