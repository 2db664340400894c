"""The fact store as one repeatable step: filings, facts, links, and a log of changes, in one commit.

Facts lie in a fixed number of buckets by filing. A round reads the buckets of the filings that it parsed, and writes of
these those in which something changes; the others' parts are named again. Facts are dealt once a round, by slices of
buckets: all that follows is of one filing, and a task writes few buckets. A round that changes nothing commits
nothing. A failure anywhere leaves the store as of the last commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.facts import sync, upsert
from tallyforge.operators.lineage import dependants
from tallyforge.sinks.snapshots import Manifest, Tables
from tallyforge.sizes import dealt_once

FACTS = "filing_id string, concept string, period_start date, period_end date, segment string, unit string, value double, decimals int, tier string, verified_by string"
FILINGS = "filing_id string, sha string, fetched timestamp, broadcast timestamp"
LINKS = "fact_id string, input_id string"
LOG = "filing_id string, change string, n long, round int"
BUCKETS, SLICES = 64, 16


def fact_id() -> Column:
    """One text for a fact: its filing and key."""
    return F.concat_ws("|", "filing_id", "concept", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("period_start", "period_end", "segment", "unit")])


class Store:
    """The fact store of a folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS) -> None:
        self.spark, self.tables = spark, Tables(spark, folder)
        self.buckets = self.tables.manifest().info.get("buckets", buckets)

    def facts(self, at: Manifest | None = None) -> DataFrame:
        return self.tables.read("facts", FACTS + ", bucket int", at).drop("part")

    def filings(self, at: Manifest | None = None) -> DataFrame:
        return self.tables.read("filings", FILINGS, at).drop("part")

    def links(self, at: Manifest | None = None) -> DataFrame:
        return self.tables.read("links", LINKS, at).drop("part")

    def log(self, at: Manifest | None = None) -> DataFrame:
        return self.tables.read("log", LOG, at).drop("part")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("filing_id"), F.lit(self.buckets)).cast("int")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        slice_ = F.pmod(F.shiftright(F.xxhash64("filing_id"), 32), F.lit(SLICES)).cast("int")
        return rows.withColumns({"bucket": self._bucket(), "slice": slice_}).repartition("bucket", "slice")

    def apply(self, listed: DataFrame, parsed: DataFrame, links: DataFrame | None = None, *, fail: str | None = None) -> dict[str, int]:
        """Makes the store equal a round: ``listed`` (``FILINGS``) are upserted, the facts of the filings in ``parsed`` are made equal to
        it, ``links`` are added, and links of facts that rest on changed ones go, at any depth. Returns counts of changes.
        ``fail`` names the step before which to break off, for tests."""
        at = self.tables.manifest()
        parts = {int(p.rpartition("=")[2]): p for p in at.tables.get("facts", [])}
        asked = {r.bucket for r in parsed.select(self._bucket().alias("bucket")).distinct().collect()}  # BUCKETS at most
        held = self.facts(Manifest(tables={"facts": [parts[b] for b in sorted(asked & parts.keys())]}))
        synced = sync(self._dealt(held), self._dealt(parsed), ("bucket", "slice"), rest=True).drop("slice")
        with dealt_once(self.spark):
            changes = self.tables.stage("changes", synced, ["bucket"])
        synced = self.tables.read("changes", synced.schema, Manifest(tables={"changes": [changes]})).drop("part")
        counts = {r.change: r.n for r in synced.filter("change <> 'other'").groupBy("change").agg(F.count("*").alias("n")).collect()}
        filings = self.filings(at)
        # each row with what it was: the same filings with the same columns, or some are new
        row = F.struct(*filings.columns[1:])
        old, new = filings.withColumn("was", row), listed.dropDuplicates(["filing_id"])
        both = upsert(old, new.withColumn("was", F.lit(None).cast(old.schema["was"].dataType)), "filing_id", ["sha", "fetched"], ["broadcast", "was"]).persist()
        now = both.select(*filings.columns)
        news = not both.filter(~row.eqNullSafe(F.col("was"))).isEmpty()
        added = links.select("fact_id", "input_id").distinct().join(self.links(at), ["fact_id", "input_id"], "left_anti") if links is not None else None
        more = added is not None and not added.isEmpty()
        moved = synced.filter("change NOT IN ('kept', 'other')")
        if not (news or more or any(n for c, n in counts.items() if c != "kept")):
            both.unpersist()
            return {"commits": 0, **counts}
        if fail == "facts":
            raise RuntimeError("broken off before the facts")
        out, round_ = {}, at.info.get("round", 0) + 1
        hit = sorted({r.bucket for r in moved.select("bucket").distinct().collect()})  # BUCKETS at most
        if hit:
            written = synced.filter("change <> 'removed'").drop("change").filter(F.col("bucket").isin(hit))
            part = self.tables.stage("facts", written, ["bucket"])
            filled = {r.bucket for r in written.select("bucket").distinct().collect()}
            parts = {b: p for b, p in parts.items() if b not in hit} | {b: f"{part}/bucket={b}" for b in hit if b in filled}
            out["facts"] = [parts[b] for b in sorted(parts)]
            log = moved.groupBy("filing_id", "change").agg(F.count("*").alias("n")).withColumn("round", F.lit(round_))
            out["log"] = [*at.tables.get("log", []), self.tables.stage("log", log)]
        if fail == "filings":
            raise RuntimeError("broken off before the filings")
        if news:
            out["filings"] = [self.tables.stage("filings", now)]
        stale = moved.filter("change IN ('changed', 'removed')").select(fact_id().alias("input_id"))
        old = self.links(at)
        if more or (hit and at.tables.get("links")):
            kept = old.join(dependants(old, stale).select("fact_id"), "fact_id", "left_anti") if hit else old
            out["links"] = [self.tables.stage("links", kept.unionByName(added) if more else kept)]
        if fail == "commit":
            raise RuntimeError("broken off before the commit")
        both.unpersist()
        self.tables.commit(out, {"round": round_, "buckets": self.buckets}, over=at)
        return {"commits": 1, **counts}
