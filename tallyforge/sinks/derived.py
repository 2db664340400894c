"""Rows that are derived from contents, kept by the hash of the content and the version of the code that derives them.

What has been derived is never derived again: not for an unchanged row, not for another row of the same content, and not after
a run that was killed, which goes on after its last batch. Other code derives everything anew, beside what is there."""

from __future__ import annotations

import hashlib
import inspect
import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.sinks.files import _paths
from tallyforge.sinks.snapshots import Tables

#: Bytes of content that a batch derives from, which is what a killed run loses at most.
BATCH_BYTES = 1 << 30


def code_of(*functions: Callable) -> str:
    """12 hex digits of the functions' source."""
    return hashlib.sha256("\0".join(inspect.getsource(f) for f in functions).encode()).hexdigest()[:12]


class Derived:
    """A store of ``schema`` rows by ``content_key``. ``derive``: a function of ``content_key, content`` (one row a content) to rows
    with ``content_key``, as many for a content as it likes, also none. ``code``: its version; that of its source unless given."""

    def __init__(self, spark: SparkSession, folder: str, derive: Callable[[DataFrame], DataFrame], schema: str, code: str | None = None) -> None:
        self.tables, self.derive, self.schema, self.code = Tables(spark, folder), derive, schema, code or code_of(derive)

    def keyed(self, rows: DataFrame, content: str) -> DataFrame:
        """Rows with ``content_key``; a null content has none and derives nothing."""
        return rows.withColumn("content_key", F.sha2(F.col(content).cast("binary"), 256))

    def _table(self, name: str) -> str:
        return f"{name}-{self.code}"

    def seen(self) -> DataFrame:
        """``content_key`` of what has been derived by this code, in which batch."""
        return self.tables.read(self._table("seen"), "content_key string, batch long")

    def update(self, rows: DataFrame, content: str, batch_bytes: int = BATCH_BYTES) -> int:
        """Derives what is new among the rows, a commit a batch. Returns how many contents were new."""
        keyed = self.keyed(rows, content)
        found = keyed.filter("content_key IS NOT NULL").select("content_key", F.col(content).alias("content"))
        fresh = found.dropDuplicates(["content_key"]).join(self.seen().select("content_key"), "content_key", "left_anti")
        many, size = fresh.agg(F.count("*"), F.sum(F.octet_length(F.col("content").cast("binary")).cast("long"))).first()
        if not many:
            return 0
        batches = math.ceil(size / batch_bytes) or 1
        part = F.pmod(F.conv(F.substring("content_key", 1, 8), 16, 10).cast("long"), F.lit(batches)).cast("int")
        # new contents are laid out by batch once, so that a batch reads its own alone, however many there are
        path = f"{self.tables.folder}/new-{uuid.uuid4().hex[:12]}"
        try:
            fresh.withColumn("batch", part).hint("rebalance", "batch").write.partitionBy("batch").parquet(path)
            laid = self.tables.spark.read.schema(fresh.withColumn("batch", part).schema).parquet(path)
            for batch in range(batches):
                own = laid.filter(F.col("batch") == batch).select("content_key", "content")
                at = self.tables.manifest()
                made = self.tables.stage(self._table("rows"), self.derive(own))
                marks = self.tables.stage(self._table("seen"), own.select("content_key", F.lit(at.version + 1).cast("long").alias("batch")))
                old = at.tables
                self.tables.commit({self._table(n): [*old.get(self._table(n), []), p] for n, p in (("rows", made), ("seen", marks))}, over=at)
        finally:
            fs, p = _paths(self.tables.spark, path)
            fs.delete(p, True)
        return many

    def read(self, rows: DataFrame, content: str) -> DataFrame:
        """Rows with what has been derived from their content; those without any are absent."""
        return self.keyed(rows, content).drop(content).join(self.tables.read(self._table("rows"), self.schema).drop("part"), "content_key")

    def forget_other_code(self) -> list[str]:
        """Drops what other versions of the code have derived."""
        at = self.tables.manifest()
        old = {n: [] for n in at.tables if not n.endswith(f"-{self.code}")}
        if any(at.tables[n] for n in old):
            self.tables.commit(old, over=at)
        return self.tables.swept()
