"""Distinct word shingles of whole texts as 64-bit hashes, many texts at once."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTERS = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
_LETTERS[65:91] = _LETTERS[97:123]  # A-Z counts as a-z
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = x ^ np.uint64(seed * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if n <= 1 << 21:
            _powers[name] = have
    return have[:n]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every word, in order. Words lie between spaces and the controls 9 to 13."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    gap = _GAP[b]
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1))  # starts and ends in turn
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_LETTERS[b] * _power("up", _BASE, len(b)), out=total[1:])
    h = (total[ends] - total[starts]) * _power("down", _UNBASE, len(b))[starts]
    borders = np.cumsum([len(d) + 1 for d in data])
    return np.searchsorted(borders, starts, "right"), mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Of each text its distinct n-word shingles, sorted. With fewer words the whole sequence is the one shingle;
    without words the set is empty."""
    owner, h = words(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    whole = h[: max(len(h) - n + 1, 0)].copy()
    for i in range(1, n):
        whole = mixed(whole) + h[i : len(h) - n + 1 + i]
    whole = mixed(whole, n)
    out = []
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if z - a >= n:
            out.append(np.unique(whole[a : z - n + 1]))
        elif z > a:
            x = h[a : a + 1]
            for i in range(a + 1, z):
                x = mixed(x) + h[i : i + 1]
            out.append(mixed(x, 1000 + z - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed numbers."""
    return int(mixed(s, 11).sum(dtype=np.uint64).astype(np.int64)), int(mixed(s, 13).sum(dtype=np.uint64).astype(np.int64))
