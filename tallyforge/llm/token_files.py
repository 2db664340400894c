"""Token ids as binary files with Elias-Fano coded document borders.

A file holds one run of documents in ascending order: all their ids behind one another, as unsigned
16-bit or 32-bit numbers, and two Elias-Fano sequences: the ends of the documents in the id array and
the documents' keys. A sequence of n numbers below u takes about 2 + log2(u / n) bits a number; a select
directory with the place of every 256th set bit gives any offset without a table of 64-bit offsets.

The files go to the shared folder under a name that holds the task attempt, first under a hidden name.
Only attempts that Spark reports as done are in the manifest, so retries and lost executors leave at most
unlisted files. The manifest has a row for each file, not for each document.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import shared
from tallyforge.llm.bpe import Encoder, Words, flattened, in_parts

MAGIC = b"TFTOKEN1"
STEP = 256
#: Ids that a reader takes into memory at once.
WINDOW = 4_000_000
#: Bytes of ids after which a writer begins a new file, with the next part of texts.
FILE_BYTES = 64 << 20
#: Words that a worker remembers, and letters of text that are encoded together.
ENTRIES, PART = 600_000, 4_000_000


@dataclass
class EliasFano:
    """A non-decreasing sequence of numbers from 0."""

    n: int
    low_bits: int
    low: bytes
    high: bytes
    places: np.ndarray  # of the set bits 0, STEP, 2 * STEP ... of high, 32-bit

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, b"", b"", np.zeros(0, np.uint32))
        if (v[1:] < v[:-1]).any():
            raise ValueError("an Elias-Fano sequence can't decrease")
        bits = max(0, ((int(v[-1]) + 1) // n).bit_length() - 1)
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
        places = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(places[-1]) + 1, np.uint8)
        marks[places] = 1
        return cls(n, bits, low, np.packbits(marks, bitorder="little").tobytes(), places[::STEP].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th number, from the directory entry before it and a scan of at most STEP set bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, skip = int(self.places[i // STEP]), i % STEP
        byte = place // 8
        current = self.high[byte] >> (place % 8) << (place % 8)
        while (count := current.bit_count()) <= skip:
            skip -= count
            byte += 1
            current = self.high[byte]
        for _ in range(skip):
            current &= current - 1
        place = byte * 8 + (current & -current).bit_length() - 1
        at = i * self.low_bits
        span = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 7) // 8], "little") >> (at % 8)
        return (place - i) << self.low_bits | span & ((1 << self.low_bits) - 1)

    def all(self) -> np.ndarray:
        """Every number, as unsigned 64-bit."""
        if not self.n:
            return np.zeros(0, np.uint64)
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        high = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return high | (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def pack(self) -> bytes:
        return struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.places)) + self.low + self.high + self.places.astype("<u4").tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> EliasFano:
        n, bits, low, high, places = struct.unpack_from("<QBQQQ", data)
        at = struct.calcsize("<QBQQQ")
        return cls(n, bits, data[at : at + low], data[at + low : at + low + high], np.frombuffer(data, "<u4", places, at + low + high))


def write_file(uri: str, keys: list[int | None], lengths: list[int], ids: Iterator[bytes], width: int) -> None:
    """One token file. Null keys come first."""
    nulls = sum(k is None for k in keys)
    known = [k for k in keys if k is not None]
    base = known[0] if known else 0
    ends = EliasFano.of(np.cumsum(np.array(lengths, np.uint64))).pack()
    named = EliasFano.of(np.array([k - base for k in known], np.uint64)).pack()
    store, path = fs.FileSystem.from_uri(uri)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(hidden := f"{folder}/.{name}.{os.getpid()}") as f:
        f.write(MAGIC + struct.pack("<BQqQQ", width, nulls, base, len(ends), len(named)) + ends + named)
        for x in ids:
            f.write(x)
    store.move(hidden, path)


class TokenFile:
    """Reads a token file: borders at once, ids by ranges."""

    def __init__(self, uri: str) -> None:
        store, path = fs.FileSystem.from_uri(uri)
        self.f = store.open_input_file(path)
        head = struct.calcsize("<BQqQQ")
        start = self.f.read_at(len(MAGIC) + head, 0)
        if start[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.width, self.nulls, self.base, ends, named = struct.unpack_from("<BQqQQ", start, len(MAGIC))
        at = len(MAGIC) + head
        self.ends = EliasFano.unpack(self.f.read_at(ends, at))
        self.named = EliasFano.unpack(self.f.read_at(named, at + ends))
        self.data = at + ends + named

    def span(self, i: int) -> tuple[int, int]:
        """Offset and end of document i in the id array."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.f.read_at((end - start) * self.width, self.data + start * self.width), f"<u{self.width}")

    def keys(self) -> list[int | None]:
        return [None] * self.nulls + [int(x) + self.base for x in self.named.all().tolist()]


class LibraryEncoder(Encoder):
    """Words by the tokenizers library, which is called for words not yet known, many at a time.

    Texts are normalised and cut into words here: neither the normaliser nor a word reaches across white space, and
    what the library does with a normalised word alone is what it does with it in its text. Where the last piece of a
    word carries a mark of its own, words go in groups with a space between them, and the marks part the ids again."""

    def __init__(self, path: str, end_id: int, entries: int = ENTRIES) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__(path, 0)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        v = self.vocabulary
        self.width = 2 if v.size <= 1 << 16 else 4
        self.last = np.array([p.endswith(v.end) for p in v.pieces]) if v.end else None
        self.memo = Words(self, entries, end_id, PART)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        group = 100 if self.last is not None else 1
        found = self.tokenizer.encode_batch_fast([" ".join(words[i : i + group]) for i in range(0, len(words), group)], add_special_tokens=False)
        sizes, flat = flattened([x.ids for x in found])
        if group > 1:
            stops = np.flatnonzero(self.last[flat]) + 1
            sizes = np.diff(stops, prepend=0)
        if len(sizes) != len(words) or sizes.sum() != len(flat):
            raise ValueError("the library cuts a word that was thought whole")
        return flat, sizes


_encoders: dict[tuple[str, int], LibraryEncoder] = {}


def write_tokens(docs: DataFrame, path: str, *, end_id: int, folder: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes every whole text, appends ``end_id`` to each and writes token files in ascending key order.

    Returns the manifest: ``file string, first long, n_docs long, n_ids long, start long`` (ids in all files
    before it), in file order. A null text counts as empty, so only ``end_id`` is written. Null keys come
    first. Rows with equal keys stand in an order that their texts' hash decides. An empty table gives an
    empty manifest. Only key and text are read.

    One shuffle deals rows to ranges of (key, text hash); a range is one task's files."""
    spark = docs.sparkSession
    shared.small_batches(spark)
    folder = folder or shared.fresh(spark, "tokens")
    rows = shared.cased(docs, key, text).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    rows = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        if (path, end_id) not in _encoders:
            _encoders[path, end_id] = LibraryEncoder(path, end_id)
        encoder = _encoders[path, end_id]
        keys: list[int | None] = []
        lengths: list[int] = []
        held: list[bytes] = []
        size, number = 0, 0

        def close() -> pa.RecordBatch:
            uri = f"{folder}/{task.partitionId():06d}-{number:05d}-{task.taskAttemptId()}.tok"
            write_file(uri, keys, lengths, iter(held), encoder.width)
            return pa.RecordBatch.from_pydict({"file": [uri], "part": pa.array([task.partitionId()], pa.int64()), "number": pa.array([number], pa.int64()), "first": pa.array(keys[:1], pa.int64()), "n_docs": [len(keys)], "n_ids": [sum(lengths)]})

        for batch in batches:
            done, names = 0, batch.column(0).to_pylist()
            for texts in in_parts(batch.column(1).to_pylist(), lambda t: len(t or ""), PART):
                found = encoder.memo.of(texts)
                keys += names[done : done + len(texts)]
                lengths += np.diff(found.borders).tolist()
                held.append(found.ids.astype(f"<u{encoder.width}").tobytes())
                size += len(held[-1])
                done += len(texts)
                if size >= FILE_BYTES:
                    yield close()
                    keys, lengths, held, size, number = [], [], [], 0, number + 1
        if keys:
            yield close()

    written = rows.mapInArrow(run, "file string, part long, number long, first long, n_docs long, n_ids long").collect()
    written.sort(key=lambda r: (r["part"], r["number"]))
    start, manifest = 0, []
    for r in written:
        manifest.append((r["file"], r["first"], r["n_docs"], r["n_ids"], start))
        start += r["n_ids"]
    return spark.createDataFrame(manifest, "file string, first long, n_docs long, n_ids long, start long")


def read_tokens(spark: SparkSession, manifest: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Reads token files back: ``key, start, n_tokens, ids_crc32``. Each file is a task of its own; ids come
    in windows, so that a task holds a few megabytes at a time (or one document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                f = TokenFile(r["file"])
                ends = f.ends.all().astype(np.int64)
                starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
                for i in {0, len(ends) // 2, len(ends) - 1}:  # select gives the same borders without the others
                    if f.span(i) != (starts[i], ends[i]):
                        raise ValueError(f"{r['file']}: its select directory is damaged")
                crcs, at = np.zeros(len(ends), np.int64), 0
                while at < len(ends):
                    stop = max(at + 1, int(np.searchsorted(ends, starts[at] + WINDOW, "right")))
                    ids = f.ids(int(starts[at]), int(ends[stop - 1])).astype("<u4")
                    for i in range(at, stop):
                        crcs[i] = zlib.crc32(ids[starts[i] - starts[at] : ends[i] - starts[at]].tobytes())
                    at = stop
                yield pa.RecordBatch.from_arrays([pa.array(f.keys(), pa.int64()), pa.array(starts + r["start"]), pa.array(ends - starts), pa.array(crcs)], names=[key, "start", "n_tokens", "ids_crc32"])

    n = manifest.count()
    files = manifest.select("file", "start").repartition(max(1, min(n, 4096)))
    return files.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")
