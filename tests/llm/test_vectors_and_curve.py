"""Whitening, hard negatives and packing along a curve, beside plain versions."""

import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabkit.llm import curve_packing, hard_negatives, whitening

WORDS = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(WORDS)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, score double, no string")


def odd_vectors(n=260, d=12, seed=4):
    """Random vectors with repeated rows and ids, ties, and rows that take no part."""
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in rng.normal(size=d).round(1)], 1.0, "x") for i in range(n)]
    rows += [rows[7], rows[100], (100, 2, rows[3][2], None, None), (300, 1, [0.0] * d, None, None)]
    rows += [(400, None, rows[0][2], None, None), (None, 1, rows[0][2], None, None), (401, 1, None, None, None)]
    rows += [(500, 1, [float("nan")] * d, None, None), (501, 1, [None] * d, None, None), (600, 1, [float("inf")] + [0.0] * (d - 1), None, None)]
    return rows


def plain_negatives(rows, anchors, k=5):
    good = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    xs = [[math.floor(256 * float(np.float32(x))) for x in r[2]] for r in good]
    out = []
    for a, r in enumerate(good):
        if not anchors(r[0]):
            continue
        scored = [(-sum(p * q for p, q in zip(xs[a], xs[b])), s[0], b) for b, s in enumerate(good) if b != a and len(xs[a]) == len(xs[b])]
        for sp, pid, _ in sorted(x for x in scored if good[x[2]][1] == r[1])[:k]:
            fit = sorted(x for x in scored if good[x[2]][1] != r[1] and -80 * sp <= -100 * x[0] <= -100 * sp)[:k]
            out += [(r[0], pid, i + 1, nid, -sp, -sn) for i, (sn, nid, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("levels, block", [(1, 4096), (4, 4)])
def test_hard_negatives_are_those_of_all_pairs(spark, levels, block):
    rows = odd_vectors()
    found = hard_negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 10 == 0, levels=levels, anchor_block=block)
    got = sorted(tuple(r) for r in found.collect())
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert got == want and len(got) > 100


def test_hard_negatives_of_odd_tables(spark):
    mixed = [(10, 1, [1.0, 0.5], 0.0, ""), (11, 1, [1.0, 0.25], 0.0, ""), (12, 2, [1.0, 0.125], 0.0, ""), (13, 2, [1.0], 0.0, ""), (20, 1, [], 0.0, ""), (21, 1, [], 0.0, ""), (22, 2, [], 0.0, "")]
    found = hard_negatives.hard_negatives(vectors(spark, mixed), F.col("vec_id") % 10 == 0).collect()
    assert sorted(tuple(r) for r in found) == plain_negatives(mixed, lambda i: i % 10 == 0)
    none = vectors(spark, []).select("vec_id", "label", "embedding")
    assert hard_negatives.hard_negatives(none, F.col("vec_id") == 0).count() == 0
    huge = vectors(spark, [(0, 1, [3e9] * 3, 0.0, ""), (1, 1, [3e9] * 3, 0.0, "")])
    with pytest.raises(Exception, match="64-bit"):
        hard_negatives.hard_negatives(huge, F.col("vec_id") == 0)
    with pytest.raises(Exception, match="2\\^53"):
        hard_negatives.hard_negatives(vectors(spark, [(0, 1, [1e30], 0.0, "")]), F.col("vec_id") == 0)


@pytest.mark.parametrize("size", [3, 64, 100])
def test_estimates_hold_the_true_product(size):
    rng = np.random.default_rng(size)
    rows, anchors = rng.integers(-300, 300, (80, size)), rng.integers(-300, 300, (30, size))
    for levels, bits in ((1, 1), (1, 6), (3, 6)):
        codes, along, rest = hard_negatives.encode(rows, levels)
        asked = hard_negatives.Asked(np.arange(30), np.zeros(30), anchors, levels, bits)
        near, off = asked.estimate(0, 30, codes, along, rest)
        assert (np.abs(near - anchors @ rows.T) <= off + 1e-6).all()
    assert off.max() < 0.35 * np.sqrt((anchors**2).sum(1)).max() * np.sqrt((rows**2).sum(1)).max()


def test_whitening_is_that_of_a_full_decomposition(spark):
    rows = odd_vectors(d=9) + [(900, 1, [0.5] * 3, 0.0, ""), (901, 1, [0.25, 0.5, 1.0], 0.0, ""), (902, 1, [], 0.0, "")]
    found = whitening.whiten(vectors(spark, rows), components=4).collect()
    good = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    by_size = defaultdict(list)
    for r in good:
        by_size[len(r[2])].append((r[0], tuple(math.floor(256 * float(np.float32(x))) for x in r[2])))
    want = defaultdict(list)
    for d, part in ((d, part) for d, part in by_size.items() if d):
        x = np.array(sorted({v for _, v in part}), dtype=float).reshape(-1, d)
        n, s = len(x), [int(t) for t in x.sum(0)]
        v = (x - x.mean(0)).T @ (x - x.mean(0)) / n
        e, u = np.linalg.eigh(v)
        keep = [i for i in range(d)[::-1] if e[i] > 1e-9 * np.trace(v)][:4]
        for name, vec in part:
            far = sum((n * a - b) ** 2 for a, b in zip(vec, s))
            for c, i in enumerate(keep):
                want[name, c + 1].append((n, far, abs((np.array(vec) - x.mean(0)) @ u[:, i]) / math.sqrt(e[i]), e[i] / np.trace(v)))
    got = defaultdict(list)
    for r in found:
        got[r["vec_id"], r["component"]].append((r["n"], r["deviation"], abs(r["whitened"]), r["explained"]))
        assert r["identity_error"] < 1e-9
    assert set(got) == set(want) and len(found) == sum(map(len, want.values()))
    for k, v in want.items():
        for a, b in zip(sorted(got[k]), sorted(v)):
            assert a[:2] == b[:2] and np.allclose(a[2:], b[2:], rtol=1e-9, atol=1e-9)


def test_whitening_of_few_and_no_rows(spark):
    one = vectors(spark, [(1, 1, [0.5, 0.25], 0.0, "")] * 3)
    assert whitening.whiten(one).count() == 0
    assert whitening.whiten(vectors(spark, [])).count() == 0
    two = whitening.whiten(vectors(spark, [(1, 1, [0.5, 0.0], 0.0, ""), (2, 1, [-0.5, 0.0], 0.0, ""), (None, 1, [0.5, 0.0], 0.0, "")])).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["n"], round(abs(r["whitened"]), 9), r["explained"]) for r in two) == [(0, 1, 2, 1.0, 1.0), (1, 1, 2, 1.0, 1.0), (2, 1, 2, 1.0, 1.0)]


@pytest.mark.parametrize("values", [[9, 5, 5, 5, 5, 1], [4, 3, 2, 1], [1, 1, 0, 0], [7, 1e-3, 1e-6]])
def test_contour_integration_finds_equal_and_distant_eigenvalues(values):
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    v = q @ np.diag(values) @ q.T
    for k in range(1, len(values) + 1):
        e, u = whitening.top_components(v, k, per_interval=2)
        want = [x for x in sorted(values, reverse=True) if x > 0][:k]
        assert np.allclose(e, want, rtol=1e-9) and np.allclose(v @ u, u * e, atol=1e-10) and np.allclose(u.T @ u, np.eye(len(e)))
    assert whitening.eigenvalues_above(v, 1.5) == sum(x > 1.5 for x in values)


ODD_TEXTS = [
    None, "", "   ", "a", "Hello, WORLD! it's we'll 12 3", "<|endoftext|> in a text <|startoftext|>", "naïve Ÿ ŝ½²ªº É", "日本語 ภาษาไทย",
    "x\x1cy\x00z\x85w\xa0v", "ΑΣ Σ İ ǅ é", "don't_stop__'S 'x ''s", "word " * 30_000, "tab\tnew\nline", "a" * 5000,
]


def test_curve_packing_is_a_round_trip(spark):
    rng = np.random.default_rng(3)
    names = ["alpha", "beta", "gamma", "delta", "été", "12", "!"]
    rows = [(i, " ".join(rng.choice(names, rng.integers(1, 900)))) for i in range(60)] + list(enumerate(ODD_TEXTS, 100))
    rows += [(None, "same text"), (None, "same text"), (5, "same text"), (5, "same text")]
    docs = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], "doc_id long, text string, no int, n int, key string").repartition(4)
    got = curve_packing.pack(docs, WORDS).collect()
    ids = [(i, [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
    check_pieces(got, ids, 4096)


def check_pieces(got, ids, capacity):
    """Every id in one piece, sequences gapless, and only lengths that need no padding."""
    left = defaultdict(lambda: defaultdict(int))
    for name, tokens in ids:
        left[name][tuple(tokens)] += 1
    held, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        held[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for name, texts in left.items():
        want = defaultdict(int)
        for tokens, times in texts.items():
            starts = {(r["start"], r["length"]) for r in held[name] if r["doc_tokens"] == len(tokens)}
            found = sorted(x for x in starts if any(r["ids_crc32"] == zlib.crc32(np.array(tokens[x[0] : x[0] + x[1]], "<u4").tobytes()) for r in held[name]))
            assert {i for a, n in found for i in range(a, a + n)} == set(range(len(tokens)))
            want[len(tokens)] += len(tokens) * times
        total = defaultdict(int)
        for r in held[name]:
            total[r["doc_tokens"]] += r["length"]
        assert total == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity and at & (at - 1) == 0


def test_curve_packing_of_no_rows(spark):
    assert curve_packing.pack(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0


def test_word_tokens_are_those_of_the_library():
    tokens = curve_packing.WordTokens(WORDS)
    assert tokens.split is not None
    rng = np.random.default_rng(1)
    pools = ["abXY 'sdt019.,!-_\n\t", "éÉÀßſŸŁ²½ªº©'s \xa0\x85 A1", "".join(map(chr, range(0x250))), "日本ภาไΣσςİıǅ한 ́ȩ٣<|endoftext|>"]
    texts = [t or "" for t in ODD_TEXTS]
    texts += ["".join(rng.choice(list(pools[i % 4]), rng.integers(0, 40))) for i in range(4000)]
    texts += [f"a{chr(c)}B" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for t in texts:
        assert np.frombuffer(tokens.whole(t), tokens.kind).tolist() == LIBRARY.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_keys_pass_every_cell_by_steps_of_one(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    keys = curve_packing.hilbert_key(grid, bits)
    assert sorted(keys.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_neighbours_on_the_curve_are_alike(spark):
    """Texts of two topics that alternate in the table share sequences with their own topic."""
    rng = np.random.default_rng(8)
    words = [[f"{a}{b}" for b in "aeiou"] for a in ("mar", "kel")]
    rows = [(i, " ".join(rng.choice(words[i % 2], 400))) for i in range(200)]
    got = curve_packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), WORDS).collect()
    topics = defaultdict(set)
    for r in got:
        topics[r["sequence_id"]].add(r["doc_id"] % 2)
    assert sum(len(t) == 1 for t in topics.values()) > 0.7 * len(topics)
