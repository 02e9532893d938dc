"""Near duplicates in scripts with and without spaces between words."""

import re

import numpy as np
import pytest

from tabkit.llm import minhash
from tests.llm.test_operators import plain_groups

HAN = "".join(chr(c) for c in range(0x4E00, 0x4E00 + 3000))
THAI = "".join(chr(c) for c in range(0x0E01, 0x0E2F))


def unspaced(rng, letters, size, every=20, stop="。"):
    signs = rng.choice(list(letters), size).tolist()
    return "".join(c + (stop if i % every == every - 1 else "") for i, c in enumerate(signs))


def same_words(a, b):
    a, b = minhash.word_hashes([a, b])
    return len(a) == len(b) and (a == b).all()


@pytest.mark.parametrize(
    "text, spelled",
    [
        ("Straße—naïve «été» 42", "straße naïve été 42"),
        ("日本語のテキスト。次", "日 本 語 の テ キ ス ト 次"),
        ("abc日本def", "abc 日 本 def"),
        ("한국어 문장은 띄어쓴다", "한국어, 문장은, 띄어쓴다"),
        ("हिन्दी शब्द", "(हिन्दी) शब्द"),
        ("go😀😀now…", "go 😀 😀 now"),
        ("ไทย", "ไ ท ย"),
        ("x y　z​w", "x y z w"),
        ("\ud800a", "a"),
    ],
)
def test_words_by_unicode_class(text, spelled):
    assert same_words(text, spelled)
    assert len(minhash.word_hashes([text])[0]) == len(re.split(r"[ ,()]+", spelled.strip("(,) ")))


@pytest.mark.parametrize("shift", range(4))
def test_blocks_end_between_words_and_characters(monkeypatch, shift):
    """Words do not change where a long text is cut into blocks."""
    rng = np.random.default_rng(shift)
    text = "x" * shift + unspaced(rng, HAN, 400) + " some words after it " * 20 + unspaced(rng, THAI, 100) + "é" * 40 + " end"
    want = minhash.word_hashes([text, "b c"])
    for size in (1 << 7, 1 << 8):
        monkeypatch.setattr(minhash, "BLOCK", size)
        got = minhash.word_hashes([text, "b c"])
        assert all((g == w).all() and len(g) == len(w) for g, w in zip(got, want))


def test_words_are_cut_after_a_megabyte_wherever_they_lie():
    long = "é" * (1 << 20) + "b"
    alone = minhash.word_hashes([long])[0]
    for before in ("", "some words", "日" * 1000):
        assert (minhash.word_hashes([before, long, "c"])[1] == alone).all() and len(alone) == 3


def test_near_copies_without_spaces_are_found(spark):
    rng = np.random.default_rng(11)
    rows = []
    for letters in (HAN, THAI):
        for size in (150, 500):
            base = unspaced(rng, letters, size)
            at = size // 2
            rows += [base, base[:at] + "新" + base[at:], base[: at // 2] + base[at // 2 + 3 :], unspaced(rng, letters, size)]
    rows = [(i + 1, t) for i, t in enumerate(rows)]
    want = plain_groups(rows)
    assert want == {i: i - (i - 1) % 4 if (i - 1) % 4 < 3 else i for i, _ in rows}
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component"] for r in found} == want
    assert all(r["n_shingles"] > 100 for r in found)
