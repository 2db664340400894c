import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")

from tallyforge.llm import bpe, token_files  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_library(library):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abetinthe THE <|endoftext|>'s 12.é́ßΣ\n") for _ in range(rng.randint(0, 80))) for _ in range(500)]
    texts += ["", " ", "a" * 4000, "".join(rng.choice("abcdefghij") for _ in range(5000)), "x<|startoftext|>y", "\x1c\x85 z"]
    encoder = bpe.Encoder(PATH)
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.encode(t) == e.ids
        assert encoder.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)
    assert 0 < encoder.failed < encoder.proposed


def test_word_spans_equal_the_pattern():
    v = bpe.Vocabulary(PATH)
    rng = random.Random(5)
    for _ in range(5000):
        text = "".join(rng.choice("abstrvemld'’!. \n\t0129²½éßœ×÷€–\x1c\x85\xa0ªº'") for _ in range(rng.randint(1, 30)))
        assert v.is_plain(text)
        starts, stops = bpe.word_spans(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        assert [text[a:b] for a, b in zip(starts, stops, strict=True)] == v.plain_words.findall(text)
    assert not any(v.is_plain(t) for t in ("İ", "e\u0301", "дом", "<|endoftext|>"))


@pytest.mark.parametrize(("one", "two"), [(7, 2**64 - 1), (2**64 - 1, 2**64 - 1), (0, 0xFFFF)])
def test_colliding_hashes_change_nothing(library, monkeypatch, one, two):
    """Words of one hash are told apart by the other, within a text and from call to call."""
    real = bpe.word_hashes
    monkeypatch.setattr(bpe, "word_hashes", lambda *a: [h & np.uint64(m) for h, m in zip(real(*a), (one, two), strict=True)])
    encoder = bpe.Encoder(PATH)
    for text in ("one word", "another", "a third of many words, and more of them", "", "one word again"):
        assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_long_texts_are_cut_at_white_space(library, monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 50)
    encoder = bpe.Encoder(PATH)
    rng = random.Random(2)
    text = " ".join("x" * rng.choice([1, 5, 120]) + rng.choice(["'s", "7,", "\n"]) for _ in range(200))
    assert "".join(p for _, p in bpe.segments(text, 50)) == text
    assert encoder.memo.of([text, None, "é", "дом", text]).ids.tolist() == [i for t in (text, "é", "дом", text) for i in library.encode(t, add_special_tokens=False).ids]


def test_a_full_memo_changes_nothing(library):
    encoder = bpe.Encoder(PATH, entries=50)
    for i in range(5):
        text = " ".join(f"word{i * 40 + j} the same" for j in range(60))
        assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_border_test_equals_exact_merging():
    v = bpe.Vocabulary(PATH)
    rng = np.random.default_rng(1)
    inner, final = np.array(sorted(v.inner.values())), np.array(sorted(v.final.values()))
    a, b = rng.choice(inner, 3000), rng.choice(final, 3000)
    got = v.compatible(a, b)
    for x, y, ok in zip(a.tolist(), b.tolist(), got.tolist(), strict=True):
        assert ok == (v.exact(v.pieces[x] + v.pieces[y][: -len(v.end)]) == [x, y])


def test_digests_and_arrays(spark, odd, library):
    for name, rows in (("digests", bpe.digests(odd, PATH).collect()), ("encoded", bpe.encoded(odd, PATH).collect())):
        texts = [r.text or "" for r in odd.collect()]
        want = sorted((str(r.doc_id), library.encode(t, add_special_tokens=False).ids) for r, t in zip(odd.collect(), texts, strict=True))
        if name == "encoded":
            assert sorted((str(r.doc_id), list(r.ids)) for r in rows) == want
        else:
            assert sorted((str(r.doc_id), r.ids_sha256) for r in rows) == sorted((k, hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest()) for k, i in want)
    assert bpe.digests(odd.limit(0), PATH).count() == 0


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], list(range(0, 3000, 3)), [0, 1 << 40], sorted(random.Random(2).choices(range(10**7), k=1000))])
def test_elias_fano(values):
    f = token_files.EliasFano.unpack(token_files.EliasFano.of(np.array(values, np.uint64)).pack())
    assert f.all().tolist() == values
    assert [f.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        f.select(len(values))


def test_token_files(spark, odd, library):
    manifest = token_files.write_tokens(odd, PATH, end_id=1)
    got = token_files.read_tokens(spark, manifest).orderBy("start").collect()
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    want = sorted((str(r.doc_id), len(i := library.encode(r.text or "", add_special_tokens=False).ids + [1]), zlib.crc32(np.array(i, "<u4").tobytes())) for r in odd.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == want
    empty = token_files.write_tokens(odd.limit(0), PATH, end_id=1)
    assert token_files.read_tokens(spark, empty).count() == 0
    f = token_files.TokenFile(manifest.orderBy("start").first().file)
    assert f.span(0)[0] == 0
