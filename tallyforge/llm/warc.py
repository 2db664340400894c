"""WARC archives with a two-level capture index.

Pages are dealt to ranges of their reversed-host URL keys (``com,example,www)/path``) and ids. A task writes its range
as a WARC 1.1 file, one gzip member a record, and beside it its part of the index: lines in key order in compressed
blocks of ``LINES``, behind them a sparse directory with the first key, offset and size of each block, and a footer
that points at the directory. The manifest has a row for each file with its first key. A search bisects the
manifest, then the directory, then one block, and reads the record's range.

Of records with equal payloads of at least ``SHARED_BYTES``, that with the largest page id is the response; others are
revisits without a payload that refer to it.

Files go to the shared folder under names with the task's attempt; only finished attempts are in the manifest.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import shared

SHARED_BYTES = 1000
LINES = 500
FILE_BYTES = 128 << 20
MAGIC = b"TFCDX001"
#: The date of records whose capture time isn't known.
DATE = "1970-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Ranges next to each other are read at once, up to this size.
READ_BYTES = 4 << 20


def url_key(url: Column) -> Column:
    """Host labels in reverse order, port unless it is the scheme's own, and the rest. White space and controls are
    percent-encoded; a null URL has an empty key; what is no URL with a host is its own key."""
    clean = F.coalesce(F.regexp_replace(F.regexp_replace(F.trim(url), r"\s", "%20"), r"[\x00-\x1f\x7f]", "%00"), F.lit(""))
    shape = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d*))?(.*)$"
    part = lambda i: F.regexp_extract(clean, shape, i)
    port = F.when((part(3) == "") | F.concat_ws(":", F.lower(part(1)), part(3)).isin("http:80", "https:443"), "").otherwise(F.concat(F.lit(":"), part(3)))
    key = F.concat(F.array_join(F.reverse(F.split(F.lower(part(2)), r"\.")), ","), port, F.lit(")"), F.when(part(4) == "", "/").otherwise(part(4)))
    return F.when(part(2) == "", clean).otherwise(key)


def record_id(page_id: int | None, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id} {key}')}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, refers_key: str | None) -> bytes:
    """One record with its HTTP head; a revisit has no payload. The id goes in the extension field X-Page-Id."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, url)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url or f"urn:x-page:{page_id}"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, refers_key or "")), ("X-Refers-To-Page-Id", str(refers_to))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def index_line(key: str, page_id: int | None, **where: object) -> str:
    return f"{key} {'' if page_id is None else page_id} {json.dumps(where, separators=(',', ':'))}"


class IndexFile:
    """One part of the index, read by ranges."""

    def __init__(self, uri: str) -> None:
        store, path = fs.FileSystem.from_uri(uri)
        self.f = store.open_input_file(path)
        size = self.f.size()
        at, length, magic = struct.unpack("<QQ8s", self.f.read_at(24, size - 24))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no index file")
        #: [first key, offset, size] of each block, in key order.
        self.directory: list[list] = json.loads(zlib.decompress(self.f.read_at(length, at)))

    def block(self, i: int) -> list[tuple[str, dict]]:
        _, at, length = self.directory[i]
        lines = zlib.decompress(self.f.read_at(length, at)).decode().split("\n")
        return [(key, json.loads(where)) for key, _, where in (x.split(" ", 2) for x in lines)]

    def find(self, key: str) -> list[dict]:
        """Captures of a key: bisects the directory; a key may go on over several blocks."""
        i = max(bisect.bisect_left([x[0] for x in self.directory], key) - 1, 0)
        out = []
        while i < len(self.directory) and self.directory[i][0] <= key:
            out += [where for k, where in self.block(i) if k == key]
            i += 1
        return out


def write_archive(pages: DataFrame, *, folder: str | None = None, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """Writes archives and index; returns the manifest ``first string, warc string, cdx string, n long`` in key order.

    A null html is an empty payload; a null URL has an empty key. Rows with equal ids and payloads are all written. Of
    equal payloads whose ids are all null each is a response. An empty table gives an empty manifest."""
    spark = pages.sparkSession
    shared.small_batches(spark)
    folder = folder or shared.fresh(spark, "warc")
    rows = shared.cased(pages, key, url, html).select(F.col(key).cast("long").alias("id"), url_key(F.col(url)).alias("k"), F.coalesce(F.regexp_replace(F.regexp_replace(F.trim(F.col(url)), r"\s", "%20"), r"[\x00-\x1f\x7f]", "%00"), F.lit("")).alias("u"), F.coalesce(F.col(html), F.lit("")).alias("body"))
    rows = rows.withColumn("digest", F.sha1(F.encode("body", "utf-8"))).withColumn("size", F.octet_length("body"))
    repeated = rows.filter(F.col("size") >= SHARED_BYTES).groupBy("digest", "size").agg(F.max("id").alias("last"), F.max_by("u", F.struct("id", "u")).alias("last_u"), F.count("*").alias("copies")).filter((F.col("copies") > 1) & F.col("last").isNotNull())
    repeated = shared.materialised(repeated, "repeated")
    revisit = F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    rows = shared.joined_by_size(rows, repeated, ["digest", "size"], "copies", "left").select("id", "k", "u", "body", "digest", F.when(revisit, F.col("last")).alias("last"), F.when(revisit, F.col("last_u")).alias("last_u"))
    dealt = rows.repartitionByRange("k", "id", "digest").sortWithinPartitions("k", "id", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        number, out, lines, size = 0, None, [], 0

        def name(kind: str) -> str:
            return f"{task.partitionId():06d}-{number:05d}-{task.taskAttemptId()}.{kind}"

        def close() -> pa.RecordBatch:
            out.close()
            directory = []
            with store.open_output_stream(f"{root}/.{name('cdx')}.{os.getpid()}") as f:
                at = 0
                for i in range(0, len(lines), LINES):
                    data = zlib.compress("\n".join(x for _, x in lines[i : i + LINES]).encode())
                    directory.append([lines[i][0], at, len(data)])
                    f.write(data)
                    at += len(data)
                packed = zlib.compress(json.dumps(directory).encode())
                f.write(packed + struct.pack("<QQ8s", at, len(packed), MAGIC))
            for kind in ("warc.gz", "cdx"):
                store.move(f"{root}/.{name(kind)}.{os.getpid()}", f"{root}/{name(kind)}")
            return pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()]), "number": pa.array([number]), "first": [lines[0][0]], "warc": [f"{folder}/{name('warc.gz')}"], "cdx": [f"{folder}/{name('cdx')}"], "n": pa.array([len(lines)])})

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    out, lines, size = store.open_output_stream(f"{root}/.{name('warc.gz')}.{os.getpid()}"), [], 0
                body = r["body"].encode("utf-8")
                data = gzip.compress(record(r["id"], r["u"], body, r["digest"], r["last"], r["last_u"]), 5, mtime=0)
                out.write(data)
                lines.append((r["k"], index_line(r["k"], r["id"], offset=size, length=len(data))))
                size += len(data)
                if size >= FILE_BYTES:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    written = sorted(dealt.mapInArrow(run, "part long, number long, first string, warc string, cdx string, n long").collect(), key=lambda r: (r["part"], r["number"]))
    return spark.createDataFrame([(r["first"], r["warc"], r["cdx"], r["n"]) for r in written], "first string, warc string, cdx string, n long")


def records(warc: str, wheres: list[dict]) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """Parsed records at the given ranges, neighbours read together."""
    store, path = fs.FileSystem.from_uri(warc)
    with store.open_input_file(path) as f:
        i = 0
        while i < len(wheres):
            start, j = wheres[i]["offset"], i
            while j < len(wheres) and wheres[j]["offset"] + wheres[j]["length"] - start <= READ_BYTES and (j == i or wheres[j]["offset"] == wheres[j - 1]["offset"] + wheres[j - 1]["length"]):
                j += 1
            j = max(j, i + 1)
            data = f.read_at(wheres[j - 1]["offset"] + wheres[j - 1]["length"] - start, start)
            for w in wheres[i:j]:
                yield parse(gzip.decompress(data[w["offset"] - start : w["offset"] - start + w["length"]]))
            i = j


def lookup(spark: SparkSession, manifest: DataFrame, url: str) -> list[tuple[dict[str, str], dict[str, str], bytes]]:
    """All captures of a URL, by bisection at both levels; of the archives only the captures' ranges are read."""
    key = spark.range(1).select(url_key(F.lit(url))).first()[0]
    files = manifest.collect()  # a row for each archive file
    i = max(bisect.bisect_left([f["first"] for f in files], key) - 1, 0)
    out = []
    while i < len(files) and files[i]["first"] <= key:
        out += records(files[i]["warc"], IndexFile(files[i]["cdx"]).find(key))
        i += 1
    return out


def read_archive(spark: SparkSession, manifest: DataFrame, *, key: str = "page_id") -> DataFrame:
    """Every capture, found by the index and read from the archives: ``key, url, payload_bytes, payload_digest,
    record_type, refers_to``. Size and digest of a response are taken from its payload, and those of a revisit from
    the head that it keeps and its digest field."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for row in batch.to_pylist():
                index = IndexFile(row["cdx"])
                last = index.block(len(index.directory) - 1)[-1]
                if last[1] not in index.find(last[0]):  # what bisection finds is what the blocks hold
                    raise ValueError(f"{row['cdx']}: its directory is damaged")
                for i in range(len(index.directory)):
                    out = []
                    for fields, http, payload in records(row["warc"], [w for _, w in index.block(i)]):
                        response = fields["WARC-Type"] == "response"
                        stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        found = hashlib.sha1(payload).hexdigest() if response else stated
                        if found != stated:
                            raise ValueError(f"{row['warc']}: a payload differs from its digest")
                        known = lambda name, fields=fields: int(fields[name]) if name in fields else None
                        out.append((known("X-Page-Id"), fields["WARC-Target-URI"], len(payload) if response else int(http["Content-Length"]), found, fields["WARC-Type"], known("X-Refers-To-Page-Id")))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    n = manifest.count()
    files = manifest.repartition(max(1, min(n, 4096)))
    return files.mapInArrow(run, f"`{key}` long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
