"""Tables that change together: data is written beside what is there, and one small manifest names what counts.

A manifest lists the parts of every table at a version. Readers follow the newest manifest, so that they see all tables as
of one commit, whatever is being written; a commit that fails leaves its data unnamed, and ``swept`` deletes it later. Two
writers that start from the same version can't both commit."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tallyforge.sinks.files import _paths, exists, write_text

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see, below ``spark.checkpoint.dir``. Without the setting, a local one, on
    a local master only."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="tallyforge-tables-")
        top = _local[app]
    return f"{top.rstrip('/')}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows, worked out once and read again from the shared folder: for what several branches of a plan need, and where a
    plan grows too long. A lost executor loses nothing of it."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class Conflict(RuntimeError):
    """Another commit came first."""


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    #: The parts of each table, oldest first, and what else the commit notes.
    tables: dict[str, list[str]] = field(default_factory=dict)
    info: dict = field(default_factory=dict)


class Tables:
    """The tables of a folder. ``parts`` are folders ``<name>/part=<id>`` of Parquet files; a part never changes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _names(self, path: str) -> list[str]:
        fs, p = _paths(self.spark, path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or that of a version; an empty one before the first commit."""
        if version is None:
            found = [n for n in self._names(f"{self.folder}/manifests") if n.endswith(".json") and not n.startswith(".")]
            if not found:
                return Manifest()
            version = int(found[-1].removesuffix(".json"))
        path = f"{self.folder}/manifests/{version:09d}.json"
        if not exists(self.spark, path):
            raise FileNotFoundError(path)
        text = "\n".join(r.value for r in self.spark.read.text(path, wholetext=True).collect())  # one small file
        return Manifest(**json.loads(text))

    def stage(self, name: str, rows: DataFrame, partition_by: list[str] | None = None) -> str:
        """Writes a part of a table that no manifest names yet."""
        part = uuid.uuid4().hex[:16]
        rows.write.partitionBy(*(partition_by or [])).parquet(f"{self.folder}/{name}/part={part}")
        return part

    def commit(self, tables: dict[str, list[str]], info: dict | None = None, *, over: Manifest) -> Manifest:
        """Names the parts of the given tables; those not given stay as they are in ``over``, the version that the parts were made
        from. If another commit came since, nothing changes and ``Conflict`` is raised."""
        new = Manifest(over.version + 1, over.tables | tables, over.info | (info or {}))
        path = f"{self.folder}/manifests/{new.version:09d}.json"
        if self.manifest().version != over.version:
            raise Conflict(f"version {over.version} isn't the newest")
        try:
            write_text(self.spark, path, json.dumps({"version": new.version, "tables": new.tables, "info": new.info}), replace=False)
        except FileExistsError as e:
            raise Conflict(path) from e
        return new

    def read(self, name: str, schema: StructType | str, at: Manifest | None = None) -> DataFrame:
        """The rows of a table as of a manifest, with their ``part``."""
        parts = (at or self.manifest()).tables.get(name, [])
        kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        full = StructType([*kind.fields]).add("part", "string")
        if not parts:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.folder}/{name}").parquet(*[f"{self.folder}/{name}/part={p}" for p in parts])

    def swept(self, keep: int = 1) -> list[str]:
        """Deletes the parts that none of the newest ``keep`` manifests names, and older manifests. No reader or writer of older
        versions may be at work."""
        versions = [int(n.removesuffix(".json")) for n in self._names(f"{self.folder}/manifests") if n.endswith(".json") and not n.startswith(".")]
        live = {(name, p) for v in versions[-keep:] for name, parts in self.manifest(v).tables.items() for p in parts}
        gone = [f"{name}/{part}" for name in self._names(self.folder) if name != "manifests" for part in self._names(f"{self.folder}/{name}") if (name, part.removeprefix("part=")) not in live]
        for path in gone + [f"manifests/{v:09d}.json" for v in versions[:-keep]]:
            fs, p = _paths(self.spark, f"{self.folder}/{path}")
            fs.delete(p, True)
        return gone
