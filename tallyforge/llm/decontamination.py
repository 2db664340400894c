"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is cut into k + 1 pieces; wherever a text holds the item with at most
k edits, one piece stands there unchanged. An Aho-Corasick automaton finds all pieces of all items in one pass
over a text. Around each hit, Myers' bit-parallel method gives the least edit distance between the item and any
part of the text. Both sides are compared in lower case with white space folded.

Items are a query set: they go to the workers in blocks of at most ``BLOCK_BYTES``, each a pass over the texts.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import shared

#: Edits allowed: one in so many characters of the item.
CHARS_PER_EDIT = 14
#: Items with fewer characters count only where they stand unchanged, with no letter, mark or digit on either side.
SHORT = 28
BLOCK_BYTES = 8 << 20


def folded(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, per: int = CHARS_PER_EDIT, short: int = SHORT) -> int:
    return 0 if len(item) < short else len(item) // per


def in_word(char: str) -> bool:
    return unicodedata.category(char)[0] in "LMN"


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """Myers' bit-parallel search for one item; a Python integer is the bit vector, of any length."""

    def __init__(self, item: str) -> None:
        self.size = len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def least(self, text: str) -> tuple[int, int]:
        """The least distance of the item to any part of the text, and where the first such part ends."""
        full, top = (1 << self.size) - 1, 1 << (self.size - 1)
        plus, minus, distance, get = full, 0, self.size, self.masks.get
        best = distance, 0
        for at, c in enumerate(text, 1):
            same = get(c, 0)
            vertical = same | minus
            across = (((same & plus) + plus) ^ plus) | same
            up = minus | ~(across | plus) & full
            down = plus & across
            if up & top:
                distance += 1
            elif down & top:
                distance -= 1
                if distance < best[0]:
                    best = distance, at
            up <<= 1
            plus = (down << 1 | ~(vertical | up)) & full
            minus = up & vertical & full
        return best


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], per: int = CHARS_PER_EDIT, short: int = SHORT) -> None:
        if per < 2:
            raise ValueError(f"an edit in {per} characters leaves no piece of an item")
        self.short = short
        self.items = [(i, f, budget(f, per, short)) for i, t in items if (f := folded(t))]
        owners: dict[str, list[tuple[int, int]]] = {}
        for n, (_, f, k) in enumerate(self.items):
            for offset, piece in pieces(f, k):
                owners.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.automaton.add_word(piece, (len(piece), own))
        if owners:
            self.automaton.make_automaton()
        self.patterns: dict[int, Pattern] = {}

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, distance, end in the folded text) of each item in the text, at its best place."""
        if not self.items or not text:
            return []
        t = folded(text)
        best: dict[int, tuple[int, int]] = {}
        places: dict[int, set[int]] = {}
        for end, (size, own) in self.automaton.iter(f" {t} "):
            start = end - size  # in t, as the padding adds 1 and end is inclusive
            for n, offset in own:
                f = self.items[n][1]
                if len(f) < self.short:
                    if n not in best and not (in_word(t[start - 1 : start] or " ") or in_word(t[end : end + 1] or " ")):
                        best[n] = 0, end
                else:
                    places.setdefault(n, set()).add(start - offset)
        for n, found in places.items():
            _, f, k = self.items[n]
            exact = min((p for p in found if p >= 0 and t.startswith(f, p)), default=None)
            if exact is not None:
                best[n] = 0, exact + len(f)
                continue
            if n not in self.patterns:
                self.patterns[n] = Pattern(f)
            # what surrounds the hits is searched once, however often a piece stands there
            for low, high in merged((max(0, p - k), p + len(f) + k) for p in found):
                distance, at = self.patterns[n].least(t[low:high])
                if distance <= k and (n not in best or distance < best[n][0]):
                    best[n] = distance, low + at
        return sorted((self.items[n][0], d, e) for n, (d, e) in best.items())


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return out


_matchers: dict[str, Matcher] = {}


def matcher_for(name: str, items: list[tuple[int, str]], per: int, short: int) -> Matcher:
    """The matcher of a block, made once for each Python worker; one is kept."""
    if name not in _matchers:
        _matchers.clear()
        _matchers[name] = Matcher(items, per, short)
    return _matchers[name]


def blocks(benchmark: DataFrame, *, text: str = "text", key: str = "item_id") -> Iterator[list[tuple[int, str]]]:
    """Items by blocks of a bounded size. Null texts and keys are no items; equal rows count once."""
    items = shared.cased(benchmark, key, text).filter(F.col(key).isNotNull() & F.col(text).isNotNull()).distinct()
    total = items.agg(F.sum(F.octet_length(text) + 8)).first()[0] or 0
    n = max(1, -(-int(total) // BLOCK_BYTES))
    for i in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i)
        yield [(r[0], r[1]) for r in part.orderBy(key, text).collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id", per: int = CHARS_PER_EDIT, short: int = SHORT) -> DataFrame:
    """A row for each document and item that it holds within one edit in ``per`` characters, items under ``short`` characters
    unchanged: ``key, item_id, distance, end``.

    ``end``: characters of the folded text up to the end of the best place (the first of several as good). Null and
    empty texts hold nothing; an item of several texts has the best of them; repeated document rows give their rows
    again; an empty benchmark gives none. Documents are read once for each block of items, without a shuffle."""
    shared.small_batches(docs.sparkSession)
    rows = shared.spread(shared.cased(docs, key, text))
    kind = rows.schema[key].dataType.simpleString()
    out = None
    for items in blocks(benchmark):

        sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex  # BLOCK_BYTES of texts

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            matcher = matcher_for(name, sent.value, per, short)
            for batch in batches:
                found = []
                for at, t in enumerate(batch.column(1).to_pylist()):
                    one: dict[int, tuple[int, int]] = {}
                    for i, d, e in matcher.find(t):
                        one[i] = min(one.get(i, (d, e)), (d, e))
                    found += [(at, i, d, e) for i, (d, e) in one.items()]
                at, i, d, e = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [], [])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (i, d, e))], names=[key, "item_id", "distance", "end"])

        part = rows.mapInArrow(run, f"`{key}` {kind}, item_id long, distance long, end long")
        out = part if out is None else out.union(part)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", per: int = CHARS_PER_EDIT, short: int = SHORT) -> DataFrame:
    """The rows, with all their columns, whose text holds no item (as ``leaks`` finds them). A pass without a shuffle for each block."""
    shared.small_batches(docs.sparkSession)
    at = docs.columns.index(text)
    for items in blocks(benchmark):

        sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex  # BLOCK_BYTES of texts

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            matcher = matcher_for(name, sent.value, per, short)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = shared.filtered(docs, run)
    return docs
