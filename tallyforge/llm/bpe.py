"""BPE encoding and decoding: speculate, verify, and merge exactly only where that fails.

A word is first cut greedily into the longest pieces of the vocabulary. Such a cut is the exact BPE
result if, and only if, no merge crosses a border between two neighbouring pieces, and that depends on
the two pieces alone. So all neighbouring pairs of a batch are tested at once with numpy, by undoing
the merges at the border from the latest to the first. Words with a failing pair are merged exactly.

The vocabulary is read from a tokenizers JSON file (``path`` is a parameter): byte-level BPE with an
end-of-word mark, NFC, lower case, white space dropped. Other kinds are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tallyforge.llm import shared

#: White space as the tokenizer's regular expressions take it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: White space for str.split() alone.
MORE_SPACE = regex.compile("[\x1c-\x1f]")
SPACES = regex.compile(f"[{SPACE}]+")
#: Fixed value: the pattern of words in the vocabulary file.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters whose kind, lower case and composed form are the same in every Unicode table: Latin letters up to U+017F
#: (but for the dotted capital I, whose lower case is two characters), general punctuation and currency signs.
NOT_PLAIN = re.compile("[^\x00-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]")
PLAIN_LETTERS, PLAIN_NUMBERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Words that a worker remembers.
CACHE_ENTRIES = 400_000
#: Letters of text that are encoded together.
PART = 1_000_000
#: Words up to this length are merged in a plain list.
SHORT_WORD = 48
NEVER = (1 << 60, -1)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Vocabulary:
    """Pieces, merges and what the border test needs of them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if model["type"] != "BPE" or model["dropout"] or model["continuing_subword_prefix"] or kinds != ["NFC", "Replace", "Lowercase"] or pre != ["Split", "ByteLevel"]:
            raise ValueError(f"{path}: only byte-level BPE with NFC, white-space folding and lower case is supported")
        self.path, self.library = path, None
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", SPACE))
        plain = {r"\s": SPACE, r"\p{L}": PLAIN_LETTERS, r"\p{N}": PLAIN_NUMBERS}
        self.plain_words = re.compile(re.sub(r"\\s|\\p\{[LN]\}", lambda m: plain[m[0]], pattern))
        self.usual = pattern == WORDS
        #: What every special token begins with; a text that has it isn't plain.
        self.mark = os.path.commonprefix(list(self.specials)) if self.specials else None
        self.words_or_break = regex.compile(rf"\n|{self.words.pattern}")
        size = max([*self.ids.values(), *self.specials.values()]) + 1
        self.pieces = [""] * size
        for piece, i in self.ids.items():
            self.pieces[i] = piece
        for piece, i in self.specials.items():
            self.pieces[i] = piece
        cut = len(self.end)
        self.final = {p[:-cut]: i for p, i in self.ids.items() if p.endswith(self.end)} if cut else self.ids
        self.inner = {p: i for p, i in self.ids.items() if not p.endswith(self.end)} if cut else self.ids
        #: By the first three letters, the length of the longest piece.
        self.reach: dict[str, int] = {}
        for p in [*self.final, *self.inner]:
            self.reach[p[:3]] = max(self.reach.get(p[:3], 1), len(p))
        self.map = {i: c for i, c in enumerate(byte_alphabet())}
        merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        left = np.full(size, -1, np.int64)
        right, born = left.copy(), left.copy()
        pairs = np.empty((len(merges), 3), np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            i, j = self.ids[a], self.ids[b]
            whole = self.ids[(a[: -len(self.end)] if self.end and a.endswith(self.end) else a) + b]
            if born[whole] >= 0 or max(born[i], born[j]) >= rank:
                raise ValueError(f"{path}: a piece has several merges, or parts that come after it")
            left[whole], right[whole], born[whole] = i, j, rank
            pairs[rank] = i * size + j, rank, whole
            self.merge[i, j] = rank, whole
        order = np.argsort(pairs[:, 0])
        self.left, self.right, self.born, self.size = left, right, born, size
        self.keys, self.ranks = pairs[order, 0], pairs[order, 1]
        #: Pieces that exact merging of their own text gives back.
        self.stable = np.ones(size, bool)
        made = pairs[:, 2]
        fine = self.compatible(left[made], right[made], np.arange(len(merges)))
        for whole, ok in zip(made.tolist(), fine.tolist(), strict=True):
            self.stable[whole] = ok and self.stable[left[whole]] and self.stable[right[whole]]

    def is_plain(self, text: str) -> bool:
        """Whether a text has plain characters alone, nothing that may be a special token, and words as ``word_spans`` cuts."""
        return self.usual and (self.mark is None or self.mark not in text) and (text.isascii() or not NOT_PLAIN.search(text))

    def pre_tokenize(self, part: str) -> list[tuple[str, tuple[int, int]]]:
        from tokenizers import Tokenizer

        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        return self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Of each pair of neighbouring pieces, whether no merge crosses the border between them.

        ``until``: only merges before this rank count. At each step the later of the two merges at the
        border is undone; what stood there before it could have merged across only by a pair of lower
        rank. Of equal ranks the left place goes first, hence the right piece is undone first."""
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), 2 * len(self.keys) + 2, np.int64) if until is None else 2 * until
        while len(live):
            key = a * self.size + b
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            crossing = (self.keys[at] == key) & (2 * self.ranks[at] < limit)
            ok[live[crossing]] = False
            of_a, of_b = self.born[a], self.born[b]
            undo_a = of_a > of_b
            keep = ~crossing & (np.maximum(of_a, of_b) >= 0)
            # after undoing on the right, a crossing pair of the same rank stands further left and wins
            limit = np.where(undo_a, 2 * of_a, 2 * of_b + 1)[keep]
            a, b = np.where(undo_a, self.right[a], a)[keep], np.where(undo_a, b, self.left[b])[keep]
            live = live[keep]
        return ok

    def exact(self, word: str) -> list[int]:
        """Merges by rank, then by place: in short words by the least of a list, else with a heap over a linked
        list, which takes n log n steps for any length."""
        parts = [self.ids[c] for c in word[:-1]] + [self.ids[word[-1] + self.end]]
        n = len(parts)
        if n <= SHORT_WORD:
            get = self.merge.get
            ranks = [get(p, NEVER) for p in zip(parts, parts[1:], strict=False)]
            while ranks and (best := min(ranks)) is not NEVER:
                i = ranks.index(best)
                parts[i : i + 2] = [best[1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = get((parts[i - 1], parts[i]), NEVER)
                if i < len(ranks):
                    ranks[i] = get((parts[i], parts[i + 1]), NEVER)
            return parts
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.merge[p], i, parts[i], parts[i + 1]) for i in range(n - 1) if (p := (parts[i], parts[i + 1])) in self.merge]
        heap = [(rank, i, whole, x, y) for rank, whole, i, x, y in heap]
        heapq.heapify(heap)
        while heap:
            _, i, whole, x, y = heapq.heappop(heap)
            j = after[i]
            if parts[i] != x or j >= n or parts[j] != y:
                continue
            parts[i], parts[j] = whole, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k, m in ((before[i], i), (i, after[i])):
                if k >= 0 and m < n and (found := self.merge.get((parts[k], parts[m]))):
                    heapq.heappush(heap, (found[0], k, found[1], parts[k], parts[m]))
        return [x for x in parts if x >= 0]

    def greedy(self, word: str) -> list[int]:
        """The longest piece at each place. ``reach`` bounds the search by how a piece may begin."""
        if (whole := self.ids.get(word + self.end)) is not None:
            return [whole]
        inner, final, reach, n, at, out = self.inner.get, self.final.get, self.reach.get, len(word), 0, []
        while at < n:
            most = reach(word[at : at + 3], 2)
            if at + most >= n:  # the rest may be one piece
                if (piece := final(word[at:])) is not None:
                    out.append(piece)
                    break
                most = n - at - 1
            for stop in range(at + most, at, -1):
                if (piece := inner(word[at:stop])) is not None:
                    out.append(piece)
                    at = stop
                    break
        return out


class Encoder:
    """Encodes distinct words by speculation and proof."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES) -> None:
        self.vocabulary = Vocabulary(path)
        self.memo = Words(self, entries)
        self.proposed = self.failed = 0

    def words_of(self, chunks: list[str]) -> list[list[str | int]]:
        """Normalised words of each chunk, before they are put in byte letters; special tokens as ids. All plain
        chunks go through one normalisation and one search, with a line break between them."""
        v = self.vocabulary
        out: list[list[str | int]] = [[] for _ in chunks]
        plain = []
        for at, c in enumerate(chunks):
            if v.special_cut and "<|" in c or not c.isascii() and max(c) >= "\u0500":
                for part in v.special_cut.split(c) if v.special_cut else [c]:
                    out[at] += [v.specials[part]] if part in v.specials else self.unusual(part)
            else:
                plain.append(at)
        text = "\n".join([chunks[at] for at in plain])
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        here = iter(plain)
        words = out[next(here)] if plain else []
        for w in v.words_or_break.findall(text.lower()):
            if w == "\n":
                words = out[next(here)]
            else:
                words.append(w)
        return out

    def unusual(self, part: str) -> list[str]:
        """Words of a chunk in any script."""
        # lower case goes by single characters, so a capital sigma never becomes a final one
        low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
        if any(unicodedata.category(c) == "Cn" for c in low):
            # characters newer than Python's tables: the file's own normaliser and word pattern decide
            back = {c: i for i, c in self.vocabulary.map.items()}
            return [bytes(back[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in self.vocabulary.pre_tokenize(part)]
        return self.vocabulary.words.findall(low)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Exact ids of the (distinct) words, one behind the other, and how many each has."""
        v = self.vocabulary
        words = [w if w.isascii() and w.isprintable() else w.encode("utf-8", "surrogateescape").decode("latin-1").translate(v.map) for w in words]
        cuts = list(map(v.greedy, words))
        sizes, flat = flattened(cuts)
        owner = np.repeat(np.arange(len(cuts)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] * v.size + flat[inner + 1], return_inverse=True)
        fits = v.compatible(pairs // v.size, pairs % v.size)[back]
        wrong = np.zeros(len(cuts), bool)
        wrong[owner[inner[~fits]]] = True
        wrong[owner[~v.stable[flat]]] = True
        for i in np.flatnonzero(wrong).tolist():
            cuts[i] = v.exact(words[i])
        self.proposed += len(cuts)
        self.failed += int(wrong.sum())
        sizes, flat = flattened(cuts)
        return flat, sizes

    def encode(self, text: str | None) -> list[int]:
        return self.memo.of([text]).ids.tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Pieces joined by one space, special tokens kept: the file names no decoder."""
        return " ".join(map(self.vocabulary.pieces.__getitem__, ids))


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return sizes, np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))


def chunks_of(text: str) -> list[str]:
    """What stands between white space. Neither normalisation nor a word reaches across it."""
    return [c for c in SPACES.split(text) if c] if MORE_SPACE.search(text) else text.split()


class Ids(NamedTuple):
    """Ids of several texts, one behind the other; ``borders`` has one number more than there are texts."""

    ids: np.ndarray
    borders: np.ndarray


#: Kinds of plain characters.
GAP, LETTER, NUMBER, OTHER = range(4)
#: Letters of text that are cut and hashed at once.
SEGMENT = 1_000_000
_BASE = 0x9E3779B97F4A7C15


def _kinds() -> np.ndarray:
    top = 0x20C0
    chars = "".join(map(chr, range(top)))
    out = np.full(top, OTHER, np.uint8)
    for kind, members in ((LETTER, PLAIN_LETTERS), (NUMBER, PLAIN_NUMBERS), (GAP, SPACE)):
        for m in re.finditer(f"[{members}]", chars):
            out[m.start()] = kind
    return out


_KIND = _kinds()
#: For two hashes of 64 bits, a number for each plain character.
_MIX = np.random.default_rng(77).integers(0, 1 << 64, (2, len(_KIND)), dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, up to ``n`` of each, which are kept."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def word_spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of the words of a plain text in lower case, as ``plain_words`` finds them: runs of letters, single
    numbers, runs of other characters, and a few endings after an apostrophe that nothing of the last kind precedes."""
    kind = _KIND[codes]
    before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
    start = (kind != GAP) & ((kind != before) | (kind == NUMBER))
    marks = np.flatnonzero((codes == 39) & start)
    if len(marks):
        padded = np.concatenate([codes, np.zeros(3, codes.dtype)])
        one, two = padded[marks + 1], padded[marks + 2]
        is_ = lambda x, c: x == ord(c)
        double = (is_(two, "e") & (is_(one, "r") | is_(one, "v"))) | (is_(one, "l") & is_(two, "l"))
        single = is_(one, "s") | is_(one, "t") | is_(one, "m") | is_(one, "d")
        for found, size in ((marks[single], 2), (marks[double], 3)):
            start[found + 1] = False
            rest = found + size
            rest = rest[rest < len(codes)]
            start[rest[kind[rest] == LETTER]] = True
    edge = start | ((kind == GAP) & (before != GAP))
    at = np.flatnonzero(edge)
    first = start[at]
    return at[first], np.concatenate([at[1:], [len(codes)]])[first]


def word_hashes(codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each word, from sums over the text before its ends."""
    up, down = powers(len(codes) + 1)
    back, size, out = down[starts], (stops - starts).astype(np.uint64), []
    sums = np.zeros(len(codes) + 1, np.uint64)
    for table in _MIX:
        np.cumsum(table[codes] * up[: len(codes)], out=sums[1:])
        h = (sums[stops] - sums[starts]) * back + size * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        out.append(h)
    return out


def segments(text: str, most: int) -> Iterator[tuple[int, str]]:
    """(place, part) of a text in parts of about ``most`` letters that end at white space."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(" ", at, at + most), text.rfind("\n", at, at + most))
        if cut <= at:
            gap = SPACES.search(text, at + most)
            cut = gap.start() if gap else len(text)
        yield at, text[at:cut]
        at = cut
    yield at, text[at:]


class Words:
    """Ids of the words that were met, in one array, so that those of whole texts are gathered with numpy.

    Plain texts are cut with numpy as well. Their words are known by two hashes, 128 bits in all, and none is made a string
    but when it is new; words of other texts are known by name. ``end_id``: an id that follows every text. When there are
    more than ``entries`` words, the half that the most calls have had stays."""

    def __init__(self, encoder: Encoder, entries: int = CACHE_ENTRIES, end_id: int | None = None, segment: int | None = None) -> None:
        self.encoder, self.entries, self.ends, self.segment = encoder, entries, end_id is not None, segment or SEGMENT
        # a line break is in no word, so names of special tokens begin with it
        fixed = {f"\n{i}": i for i in encoder.vocabulary.specials.values()} | ({"\n": end_id} if self.ends else {})
        self.index = {name: i for i, name in enumerate(fixed)}
        self.hashed: dict[int, int] = {}
        self.fixed = len(fixed)
        self.flat = np.array(list(fixed.values()), np.int32)
        self.size, self.calls = np.ones(self.fixed, np.int32), np.zeros(self.fixed, np.int32)
        self.first, self.second = np.zeros(self.fixed, np.uint64), np.zeros(self.fixed, np.uint64)

    def forget(self) -> None:
        keep = np.zeros(len(self.size), bool)
        keep[np.argsort(-self.calls, kind="stable")[: self.entries // 2]] = True
        keep &= self.calls > 1
        keep[: self.fixed] = True
        self.flat = self.flat[np.repeat(keep, self.size)]
        place = np.cumsum(keep) - 1
        self.index = {w: int(place[i]) for w, i in self.index.items() if keep[i]}
        self.hashed = {h: int(place[i]) for h, i in self.hashed.items() if keep[i]}
        self.size, self.calls, self.first, self.second = self.size[keep], self.calls[keep] // 2, self.first[keep], self.second[keep]

    def learn(self, words: list[str], first: np.ndarray, second: np.ndarray) -> None:
        """Adds new words, with their hashes or none."""
        flat, size = self.encoder.encode_words(words)
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        self.size = np.concatenate([self.size, size.astype(np.int32)])
        self.calls = np.concatenate([self.calls, np.zeros(len(size), np.int32)])
        self.first, self.second = np.concatenate([self.first, first]), np.concatenate([self.second, second])

    def by_name(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            self.index.update(zip(new, range(len(self.size), len(self.size) + len(new)), strict=True))
            self.learn(new, np.zeros(len(new), np.uint64), np.zeros(len(new), np.uint64))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def of_plain(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places of a plain text's words in the store, and where they begin in the text."""
        found, begins = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, part in segments(text, self.segment):
            codes = np.frombuffer(part.encode("utf-32-le"), np.uint32)
            starts, stops = word_spans(codes)
            if not len(starts):
                continue
            one, two = word_hashes(codes, starts, stops)
            order = np.argsort(one)
            one, two = one[order], two[order]
            fresh = np.concatenate([[True], one[1:] != one[:-1]])
            if (~fresh[1:] & (two[1:] != two[:-1])).any():  # different words of one hash: by name
                found.append(self.by_name([part[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]))
                begins.append(starts + at)
                continue
            mine = np.flatnonzero(fresh)
            keys, some = one[mine].tolist(), order[mine]
            get = self.hashed.get
            place = np.fromiter((get(k, -1) for k in keys), np.int64, len(keys))
            new = np.flatnonzero(place < 0)
            if len(new):
                place[new] = np.arange(len(self.size), len(self.size) + len(new))
                self.hashed.update(zip([keys[i] for i in new.tolist()], place[new].tolist(), strict=True))
                a, b = starts[some[new]].tolist(), stops[some[new]].tolist()
                self.learn([part[i:j] for i, j in zip(a, b, strict=True)], one[mine][new], two[mine][new])
            for i in np.flatnonzero(self.second[place] != two[mine]).tolist():  # the hash of another word: by name
                place[i] = self.by_name([part[starts[some[i]] : stops[some[i]]]])[0]
            at_ = np.empty(len(order), np.int64)
            at_[order] = place[np.cumsum(fresh) - 1]
            found.append(at_)
            begins.append(starts + at)
        return np.concatenate(found), np.concatenate(begins)

    def places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Places of all texts' words, and how many each text has."""
        v = self.encoder.vocabulary
        plain: list[int] = []
        odd: dict[int, list[str]] = {}
        for at, t in enumerate(texts):
            if v.is_plain(t or ""):
                plain.append(at)
            else:
                odd[at] = chunks_of(t)
        counts = np.zeros(len(texts), np.int64)
        lengths = np.array([len(texts[i] or "") + 1 for i in plain], np.int64)
        # a line break between texts; lower case has as many letters as before
        found, begins = self.of_plain("\n".join([texts[i] or "" for i in plain]).lower()) if plain else (np.zeros(0, np.int64),) * 2
        borders = np.searchsorted(begins, np.concatenate([[0], np.cumsum(lengths)]))
        counts[plain] = np.diff(borders) if plain else 0
        if odd:
            chunks = list(set().union(*odd.values()))
            cut = {c: [w if isinstance(w, str) else f"\n{w}" for w in ws] for c, ws in zip(chunks, self.encoder.words_of(chunks), strict=True)} if chunks else {}
            parts = dict(zip(plain, np.split(found, borders[1:-1]), strict=True)) if plain else {}
            for i, own in odd.items():
                parts[i] = self.by_name(list(chain.from_iterable(map(cut.__getitem__, own))))
                counts[i] = len(parts[i])
            found = np.concatenate([parts[i] for i in range(len(texts))])
        return found, counts

    def of(self, texts: list[str | None]) -> Ids:
        if len(self.size) > self.entries:
            self.forget()
        at, counts = self.places(texts)
        self.calls += np.bincount(at, minlength=len(self.calls)) > 0
        if self.ends:
            at, counts = np.insert(at, np.cumsum(counts), self.index["\n"]), counts + 1
        starts, size = np.cumsum(self.size, dtype=np.int64) - self.size, self.size[at]
        stops = np.cumsum(size, dtype=np.int64)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.flat[np.repeat(starts[at] - (stops - size), size) + np.arange(total)]
        return Ids(ids, np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(counts)])])


def in_parts(items: list, size, most: int) -> Iterator[list]:
    """Runs of items of about ``most`` in all; an item above it stands alone."""
    part, total = [], 0
    for x in items:
        if part and total + size(x) > most:
            yield part
            part, total = [], 0
        part.append(x)
        total += size(x)
    if part:
        yield part


_encoders: dict[str, Encoder] = {}


def encoder_for(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def joined(names: pa.StringArray, found: Ids) -> pa.StringArray:
    """Of each text, the names of its ids with one space between them."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(found.borders, pa.int32()), names.take(pa.array(found.ids))), " ")


def encoded(docs: DataFrame, path: str, *, text: str = "text", key: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """Encodes and decodes every whole text.

    Returns ``key``, ``ids array<int>``, ``decoded string`` and, with ``keep_text``, ``text``. A null text
    counts as empty and gives no ids and an empty decoded text. Repeated rows stay, in any order; a null
    key stays null; no other column is read, so their names can't clash. One pass without a shuffle."""
    shared.small_batches(docs.sparkSession)
    source = shared.spread(shared.cased(docs, key, text))
    kind = source.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        pieces = pa.array(encoder.vocabulary.pieces, pa.string())
        for batch in batches:
            done = 0
            for texts in in_parts(batch.column(1).to_pylist(), lambda t: len(t or ""), PART):
                found = encoder.memo.of(texts)
                borders = pa.array(found.borders, pa.int32())
                columns = [batch.column(0).slice(done, len(texts)), pa.ListArray.from_arrays(borders, pa.array(found.ids)), joined(pieces, found)]
                columns += [batch.column(1).slice(done, len(texts))] * keep_text
                yield pa.RecordBatch.from_arrays(columns, names=[key, "ids", "decoded"] + ["text"] * keep_text)
                done += len(texts)
        shared.settle()

    return source.mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string" + ", text string" * keep_text)


def digests(docs: DataFrame, path: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """As ``encoded``, but of ids and decoded text only their number and SHA-256."""
    shared.small_batches(docs.sparkSession)
    source = shared.spread(shared.cased(docs, key, text))
    kind = source.schema[key].dataType.simpleString()

    def hashes(texts: pa.StringArray) -> pa.StringArray:
        borders, data = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].tolist(), memoryview(texts.buffers()[2] or b"")
        return pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(borders, borders[1:], strict=False)], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path)
        pieces = pa.array(encoder.vocabulary.pieces, pa.string())
        numbers = pa.array(map(str, range(encoder.vocabulary.size)), pa.string())
        for batch in batches:
            done = 0
            for texts in in_parts(batch.column(1).to_pylist(), lambda t: len(t or ""), PART):
                found = encoder.memo.of(texts)
                columns = [batch.column(0).slice(done, len(texts)), pa.array(np.diff(found.borders)), hashes(joined(numbers, found)), hashes(joined(pieces, found))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])
                done += len(texts)
        shared.settle()

    return source.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
