"""Linear scores of texts that add up over the pieces between white space.

A model that is linear in counts of features which never reach across white space gives each piece a fixed
row of numbers. A worker remembers the rows of pieces it has met (a bounded number), so that a whole text
costs a split, a look-up for each piece and one sum.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from tallyforge.llm.bpe import in_parts


class ChunkScores:
    """``rows_of``: a list of pieces to their rows of ``width`` numbers."""

    def __init__(self, rows_of: Callable[[list[str]], np.ndarray], width: int, entries: int = 200_000) -> None:
        self.rows_of, self.width, self.entries = rows_of, width, entries
        self.at: dict[str, int] = {}
        self.rows = np.zeros((0, width), np.float32)

    def sums(self, texts: list[str | None], distinct: bool = False) -> np.ndarray:
        """The sum over each text's pieces, or over its distinct ones."""
        out = np.zeros((len(texts), self.width))
        done = 0
        for part in in_parts(texts, lambda t: len(t or ""), 1_000_000):
            cut = [list(set((t or "").split())) if distinct else (t or "").split() for t in part]
            new = [c for c in set().union(*cut) if c not in self.at]
            if len(self.at) + len(new) > self.entries:
                self.at.clear()
                self.rows = self.rows[:0]
                new = list(set().union(*cut))
            if new:
                self.at.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
                self.rows = np.concatenate([self.rows, self.rows_of(new).astype(np.float32)])
            sizes = np.array([len(c) for c in cut])
            if sizes.any():
                flat = np.fromiter((i for c in cut for i in map(self.at.__getitem__, c)), np.int64, int(sizes.sum()))
                full = np.flatnonzero(sizes)
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[full]
                out[done + full] = np.add.reduceat(self.rows[flat], starts, axis=0, dtype=np.float64)
            done += len(part)
        return out


def grams(words: list[str], orders: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of every n-gram of bytes of the words, each with a space on both sides. No gram reaches
    from one word into the next, and lone spaces are none."""
    data = [f" {w} ".encode() if w else b"" for w in words]
    sizes = np.array([len(d) for d in data])
    b = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(words)), sizes)
    owners, found = [], []
    h = np.zeros(len(b), np.uint32)
    for n in range(1, max(orders, default=0) + 1):
        if len(b) < n:
            break
        h = (h[: len(b) - n + 1] * np.uint32(0x01000193)) ^ (b[n - 1 :] * np.uint32(0x9E3779B1))
        if n in orders:
            keep = owner[: len(h)] == owner[n - 1 :]
            if n == 1:
                keep &= b != 32
            mixed = h[keep] ^ (h[keep] >> np.uint32(15))
            owners.append(owner[: len(h)][keep])
            found.append((mixed * np.uint32(0x85EBCA6B) >> np.uint32(8)) % np.uint32(buckets))
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *owners]), np.concatenate([empty, *found]).astype(np.int64)
