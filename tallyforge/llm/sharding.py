"""Sharding by fixed virtual slots.

A record's hash names one of thousands of slots, and that never changes. Bytes and rows are added up by
slot; a map from slots to shards, of a fixed size, is planned from these sums on the driver and stored
with a version. Rebalancing edits the map: it moves whole slots, as few as it needs, and writes the next
version. Records are dealt by one broadcast join with the map, whose size is the number of slots.

All work on records is DataFrame operations.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm import shared

SLOTS = 4096


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 32 bits of the MD5 of its text. A null key hashes as an empty text."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def slot_sums(records: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of every slot that has records: at most as many rows as there are slots."""
    return [tuple(r) for r in records.groupBy("vslot").agg(F.sum("size"), F.count("*")).collect()]


def plan(sums: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """A first map: slots by falling bytes, each to the shard with the fewest so far."""
    loads = [(0, s) for s in range(shards)]
    chosen = {}
    for slot, size, _ in sorted(sums, key=lambda x: (-x[1], x[0])):
        load, shard = loads[0]
        heapq.heapreplace(loads, (load + size, shard))
        chosen[slot] = shard
    return chosen


def rebalance(previous: dict[int, int], sums: list[tuple[int, int, int]], shards: int, tolerance: float = 0.01) -> dict[int, int]:
    """Edits a map: slots without a shard go to the emptiest; then the fullest shard gives its largest slot that
    narrows the gap to the emptiest, until both are within ``tolerance`` of the mean or no slot helps.
    A new shard number begins empty, so that it only receives."""
    size = {slot: b for slot, b, _ in sums}
    chosen = {slot: shard for slot, shard in previous.items() if shard < shards}
    loads = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in chosen.items():
        loads[shard] += size.get(slot, 0)
    for slot in sorted(size.keys() - chosen.keys(), key=lambda s: (-size[s], s)):
        shard = min(range(shards), key=lambda s: (loads[s], s))
        chosen[slot] = shard
        loads[shard] += size[slot]
    for slot, shard in chosen.items():
        held[shard].append((size.get(slot, 0), slot))
    mean = sum(loads) / shards
    while True:
        full, empty = max(range(shards), key=lambda s: (loads[s], -s)), min(range(shards), key=lambda s: (loads[s], s))
        if loads[full] - mean <= tolerance * mean and mean - loads[empty] <= tolerance * mean:
            return chosen
        gap = loads[full] - loads[empty]
        movable = [x for x in held[full] if 0 < x[0] < gap]
        if not movable:
            return chosen
        moved = max(movable, key=lambda x: (min(x[0], gap - x[0]), -x[1]))
        held[full].remove(moved)
        held[empty].append(moved)
        chosen[moved[1]] = empty
        loads[full] -= moved[0]
        loads[empty] += moved[0]


def save_map(spark: SparkSession, chosen: dict[int, int], folder: str, version: int) -> None:
    """Stores a version of the map. A version that is there is never written over."""
    spark.createDataFrame(sorted(chosen.items()), "vslot int, shard int").coalesce(1).write.parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int) -> dict[int, int]:
    return {r.vslot: r.shard for r in spark.read.parquet(f"{folder}/version={version}").collect()}


def measured(docs: DataFrame, *, text: str = "text", key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """``key, size, text_crc32, vslot`` of each record; the text goes no further. Size: UTF-8 bytes plus 1."""
    rows = shared.cased(docs, key, text)
    whole = F.coalesce(F.col(text), F.lit(""))
    return rows.select(F.col(key), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole).alias("text_crc32"), slot_of(F.col(key), slots).alias("vslot"))


def sharded(docs: DataFrame, *, shards: int = 8, folder: str | None = None, version: int = 1, text: str = "text", key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """Puts every record into a shard: ``key, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version``.

    The law is ``bytes``: shards' bytes differ by less than a slot's. ``slot`` is the record's place in its shard,
    from 0 without gaps: the rows of the shard's virtual slots before its own, and then its place in that
    slot by key, checksum and size (rows alike in all three stand in any order). With ``version`` above 1,
    the map of the version before is edited, else one is planned. A null text has size 1 and checksum 0;
    a null key has a slot like any other; an empty table gives no rows; equal keys share a slot. Equal texts of different keys
    may part: a text that a third of all rows have would fill one shard."""
    spark = docs.sparkSession
    folder = folder or shared.fresh(spark, "slot-map")
    records = shared.materialised(measured(docs, text=text, key=key, slots=slots), "measured")
    sums = slot_sums(records)
    chosen = rebalance(load_map(spark, folder, version - 1), sums, shards) if version > 1 else plan(sums, shards)
    save_map(spark, chosen, folder, version)
    rows = {slot: n for slot, _, n in sums}
    filled, table = [0] * shards, []
    for slot in sorted(chosen):
        table.append((slot, chosen[slot], filled[chosen[slot]]))
        filled[chosen[slot]] += rows.get(slot, 0)
    map_df = spark.createDataFrame(table, "vslot int, shard int, before long")
    place = F.row_number().over(Window.partitionBy("vslot").orderBy(F.col(key), "text_crc32", "size"))
    return (
        records.withColumn("place", place)
        .join(F.broadcast(map_df), "vslot")  # a row for each slot: bounded by the parameter
        .select(key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(version).alias("map_version"))
    )
