"""Each operator beside a plain version, on small fixtures with the odd cases, and on the smallest tables."""

import base64
import gzip
import hashlib
import io
import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabkit.llm import (
    common, embed_dedup, lang_id, minhash, mixing, packing, quality, queries, topk, toxicity, url_filter, warc,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, text_ string, id int, label int"
#: columns whose names the operators use inside
CLASH = (0.5, "other", 1, 2)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, x, s, 1, *CLASH) for i, t, x, s in rows], DOCS)


EN = "the cat and the dog were in the house when it rained on the hill near our village"
FR = "le chat et le chien étaient dans la maison quand il pleuvait sur la colline près du village"
ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \n\t ", "en", "a"),
    (4, "1234 !!!", "fr", None),
    (5, "word", "en", "b"),
    (5, "word", "en", "b"),
    (6, EN, "en", "b"),
    (7, EN, "en", "b"),
    (8, FR, "fr", "a"),
    (9, (EN + " ") * 4000, "en", "c"),
    (None, EN, "en", "c"),
]


# ---- 1 WARC


def test_warc_round_trip(spark):
    rows = [(3, "http://a/ b", "same"), (1, None, "same"), (2, "u", "other"), (4, "u", None), (5, "u", ""), (None, "u", "same"),
            (6, "x", "é" * 300_000)]
    pages = spark.createDataFrame([(*r, "id", "digest") for r in rows], "page_id long, url string, html string, id string, digest string")
    from tabkit.session import scratch_path

    parts = warc.write_warc(pages, scratch_path(spark, "w"), segment_bytes=300, archive_bytes=700)
    found = {r["id"]: r for r in warc.read_warc(parts).collect()}
    assert len(found) == 7
    for id_, _, html in rows:
        body = (html or "").encode()
        r = found[id_]
        assert r["payload_bytes"] == len(body)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r["payload"] is None or bytes(r["payload"]) == body
    kinds = {k: (r["record_type"], r["refers_to"]) for k, r in found.items()}
    assert kinds == {1: ("response", None), 3: ("revisit", 1), None: ("revisit", 1), 2: ("response", None),
                     4: ("response", None), 5: ("revisit", 4), 6: ("response", None)}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_damage_is_found():
    record = warc._page_record(1, "u", b"payload" * 50, warc.sha1(b"payload" * 50), None, "2024-01-01T00:00:00Z")
    good = gzip.compress(record)
    assert [p for _, p in warc.records(io.BytesIO(good), len(good))] == [b"payload" * 50]
    for bad in (good[:-20], gzip.compress(record.replace(b"payloadpay", b"PAYLOADpay")), gzip.compress(record[:-30]),
                gzip.compress(record + b"more")):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(io.BytesIO(bad), len(bad)))


# ---- 2 language


def test_codewords_lie_apart():
    for n in (2, 4, 6, 9, 20):
        words = lang_id.codewords(n)
        apart = [(a != b).sum() for a, b in itertools.combinations(words, 2)]
        assert min(apart) >= (1 if n == 2 else words.shape[1] // 4)


def test_gram_counts_do_not_depend_on_blocks():
    text = EN * 7 + FR
    assert np.array_equal(lang_id.gram_counts(text, 50), lang_id.gram_counts(text))


def test_language_odd_rows(spark):
    data = docs(spark, ODD)
    model = lang_id.fit(data, F.lit(True))
    assert model.langs == ["en", "fr"]
    found = {r["doc_id"]: r for r in lang_id.identify(data, model, ["doc_id"]).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 4
    assert [found[i]["lang_pred"] for i in (6, 8, 9, None)] == ["en", "fr", "en", "en"]
    assert all(0 <= r["score"] <= 1 for r in found.values())
    empty = lang_id.fit(data.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in lang_id.identify(data, empty, ["doc_id"]).collect()} == {"und"}
    one = lang_id.fit(data.where("lang = 'en'"), F.lit(True))
    assert {r["lang_pred"] for r in lang_id.identify(data, one, ["doc_id"]).collect()} == {"und", "en"}
    assert lang_id.identify(data.limit(0), model, ["doc_id"]).count() == 0


def test_language_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = queries.op2_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out AND lang IS NOT NULL").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def test_all_languages_are_learned(spark):
    """300 codes, each with words of its own; the rarest are found too."""
    words = lambda i: " ".join(chr(0x4E00 + 20 * i + j) * 2 for j in range(20))
    rows = [(10 * i + j, f"{words(i)} {'!' * j}", f"l{i:03d}", None) for i in range(300) for j in range(3 if i < 280 else 2)]
    data = docs(spark, rows)
    model = lang_id.fit(data, F.lit(True))
    assert len(model.langs) == 300
    found = lang_id.identify(data, model, ["doc_id"]).collect()
    assert np.mean([r["lang_pred"] == f"l{r['doc_id'] // 10:03d}" for r in found if r["doc_id"] >= 2800]) > 0.9


# ---- 3 URL filter


def test_url_rules_and_parts(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://A.Example.COM/de/x?q#f"), (4, "http://example.net/en/1"),
            (5, "http://x.net"), (6, "http://x.org?y=/fr/"), (7, "http://x.org/fr/"), (8, "a://b.com#://net/"), (9, "://net/é")]
    pages = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, host string, n int")
    found = url_filter.filter_urls(pages, F.lit(None).cast("int"), queries.RULES)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found.collect()}
    assert got == {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.example.com", "/de/x", "example.com/de/", "block"),
        4: ("example.net", "/en/1", "example.net/en/", "allow"), 5: ("x.net", "", None, "allow"), 6: ("x.org", "", None, "allow"),
        7: ("x.org", "/fr/", "org/fr/", "allow"), 8: ("b.com", "", None, "allow"), 9: ("net", "/é", "net/", "block"),
    }
    assert url_filter.filter_urls(pages.limit(0), F.lit(1), []).count() == 0


def test_reputation_shrinks_to_its_domain(spark):
    rows = [("a.bad.com", 1)] * 40 + [("b.bad.com", 1)] + [("a.good.com", 0)] * 60 + [("c.good.com", 1)] + [("z.co.uk", 0)] * 3
    frame = spark.createDataFrame(rows, "host string, bad int")
    got = {r["host"]: r for r in url_filter.reputation(frame, "host", "bad").collect()}
    assert got["b.bad.com"]["mean"] > got["c.good.com"]["mean"]  # same counts, other domains
    assert got["a.bad.com"]["bound"] > got["b.bad.com"]["bound"] > got["a.good.com"]["bound"]
    assert all(0 <= r["mean"] <= 1 and r["bound"] <= r["mean"] for r in got.values())


# ---- 4 top k


def test_topk_of_an_empty_vector(spark):
    frame = spark.createDataFrame([(100, []), (1, []), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = topk.top_k(frame, F.col("vec_id") == 100, k=3).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(100, 1, 1, 0)]


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 24)).astype("f4")
    x[50:60] = x[0]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [float("nan")] * 24), (302, [None] * 24), (0, x[5].tolist()),
            (303, [1.0, 2.0]), (310, [2.0, 2.0]), (None, x[1].tolist())]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, id int, score int").repartition(4)
    for options in ({}, {"query_block": 3, "dims": 5, "seed_rows": 7}):
        got = topk.top_k(frame, F.col("vec_id") % 10 == 0, **options).collect()
        usable = [(i, np.floor(1024 * np.array(v, "f4").astype("f8")).astype("i8")) for i, v in rows
                  if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
        want = Counter()
        for i, v in usable:
            if i % 10 == 0 and i:  # id 0 comes twice, with two vectors
                best = sorted((-int(v @ w), j) for j, w in usable if j != i and len(w) == len(v))[:10]
                want.update((i, r + 1, j, -s) for r, (s, j) in enumerate(best))
        assert Counter(tuple(r) for r in got if r["query_id"]) == want
    assert topk.top_k(frame.limit(0), F.lit(True)).count() == 0


# ---- 5 mixing


def test_mixing_targets_and_epochs(spark):
    rows = [(i, "w " * (i % 7), None, s) for i, s in enumerate(["b"] * 80 + ["a"] * 30 + [None] * 20 + ["c"])]
    rows += [(200, "w " * 9, None, "a")] * 3 + [(201, None, None, "d"), (None, "w w", None, "c")]
    data = docs(spark, rows)
    got = mixing.mix(data, [5.0, 2.0, 1.0], slice_rows=10, keep=["source"]).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    target, total = {}, 1.5 * sum(sizes.values())
    full: set = set()
    while True:
        level = (total - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and level * weight[s] >= 2 * sizes[s]}
        if not over:
            break
        full |= over
    target = {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in order}
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] <= 2 * r["size"] and r["taken"] >= r["size"] * int(target[r["source"]] // max(1, sizes[r["source"]]))
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) < 1 for s in order)
    again = mixing.mix(data.repartition(5), [5.0, 2.0, 1.0], slice_rows=10, keep=["source"]).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix(data.limit(0), [1.0]).count() == 0
    whole = mixing.mix(data, [5.0, 2.0, 1.0], border="whole").collect()
    assert all(r["taken"] == r["copies"] * r["size"] for r in whole)


def test_heavier_documents_come_first(spark):
    rows = docs(spark, [(i, "w w", None, "a") for i in range(2000)])
    got = mixing.mix(rows, [1.0], share=0.3, weight=F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.1)).collect()
    even = sum(r["taken"] for r in got if r["doc_id"] % 2 == 0)
    assert even > 4 * sum(r["taken"] for r in got if r["doc_id"] % 2)


# ---- 6 near duplicates


def plain_groups(rows, least=0.8):
    """Components by the definition, over all pairs."""
    sets = {}
    for i, t in rows:
        h, n = minhash.shingles(minhash.word_hashes([t or ""])[0])
        if i is not None and len(h):
            sets[i] = dict(zip(h.tolist(), (1 + np.log(n)).tolist()))
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        every = x.keys() | y.keys()
        index = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in x.keys() & y.keys())
        if index >= least - 1e-9:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    return {i: top(i) if i in sets else i for i, _ in rows}


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3)) for _ in range(60)]
    rows = [(i, t) for i, t, _, _ in ODD[:8]]
    for family in range(6):
        words = [f"{family}{w}" for w in base]
        for k in range(14):
            copy = list(words)
            for at in rng.choice(60, k // 3, replace=False):
                copy[at] = f"z{rng.integers(10**6)}"
            rows.append((100 + 20 * family + k, " ".join(copy + copy[:30] * (family % 2))))
    data = docs(spark, [(i, t, None, None) for i, t in rows] + [(None, EN, None, None)])
    for block in (512, 4):
        got = {r["doc_id"]: r for r in minhash.near_duplicates(data, block=block).collect()}
        want = plain_groups(rows)
        assert {i: r["component"] for i, r in got.items() if i is not None} == want
        assert all(r["kept"] == (r["component"] == i) for i, r in got.items())
        assert got[None]["kept"]
    assert minhash.near_duplicates(data.limit(0)).count() == 0


def test_texts_of_one_id_are_compared_each(spark):
    """An id with a small and a large text: near copies and copies of either find it, and the two stay apart."""
    small, large = (" ".join(f"{c}{i}" for i in range(60)) for c in "az")
    near = large.rsplit(" ", 3)[0] + " x y z"
    rows = [(1, small), (2, small), (2, large), (5, near), (7, near), (8, large), (9, small + " more")]
    got = {(r["id"], r["key"]): r for r in minhash.grouped(docs(spark, [(i, t, None, None) for i, t in rows])).collect()}
    keys = docs(spark, [(i, t, None, None) for i, t in rows]).select("doc_id", "text", minhash.document_key("doc_id", "text").alias("k"))
    named = {(r["doc_id"], r["text"]): got[r["doc_id"], r["k"]] for r in keys.collect()}
    assert {k: r["component"] for k, r in named.items()} == {
        (1, small): 1, (2, small): 1, (9, small + " more"): 1, (2, large): 2, (5, near): 2, (7, near): 2, (8, large): 2
    }
    assert len({r["group"] for r in got.values()}) == 2
    public = minhash.near_duplicates(docs(spark, [(i, t, None, None) for i, t in rows])).where("kept").collect()
    assert sorted(r["doc_id"] for r in public) == [1, 2]


def test_signatures_estimate_the_index():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**62, 300).astype("u8"))
    b = np.unique(np.r_[a[:220], rng.integers(0, 2**62, 60).astype("u8")])
    x, y = rng.uniform(1, 4, len(a)), rng.uniform(1, 4, len(b))
    got = minhash.signatures([a, b], [x, y], 4096)
    exact = minhash.probability_jaccard(a, x, b, y)
    assert abs((got[0] == got[1]).mean() - exact) < 0.035
    p, q = dict(zip(a.tolist(), x)), dict(zip(b.tolist(), y))
    slow = sum(1 / sum(max(p.get(j, 0) / p[i], q.get(j, 0) / q[i]) for j in p.keys() | q.keys()) for i in p.keys() & q.keys())
    assert exact == pytest.approx(slow)


# ---- 7 packing


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    tokens = packing.Tokens(path)
    for t in [EN, FR, "", " ", "a  b", "  a", "a ", "x\n\ny z  ", "a\u00a0 b", "don't I'll  we're", "<|endoftext|>", "日本語 😀 ", "1234 !!! ??"]:
        assert tokens.of(t) == np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_added_tokens_have_their_ids_as_in_the_library(spark):
    from tokenizers import Tokenizer

    path, end = queries.vocabulary(), "<|endoftext|>"
    library = Tokenizer.from_file(path)
    texts = [f"a {end} b", end, end * 3, f"  {end}  x\n\n {end}y", f"{end[:-1]} {end}", EN, "", "a  b"]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    tokens = packing.Tokens(path)
    assert [tokens.whole(t) for t in texts] == want
    got = packing.pack(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]), path).collect()
    closed = [w + np.array([2], "<u4").tobytes() for w in want]
    assert {(r["doc_id"], r["length"], r["ids_crc32"]) for r in got} == {(i, len(w) // 4, zlib.crc32(w)) for i, w in enumerate(closed)}


def test_sum_of_squares_rule():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 12, 200)
    bins, offsets = packing.sum_of_squares(sizes, 12)
    gaps: dict[int, int] = {}
    for size, b, at in zip(sizes, bins, offsets):
        def total(g):
            return sum(c * c for gap, c in Counter(g.values()).items() if gap)

        tries = [total(gaps | {k: g - size}) for k, g in gaps.items() if g >= size] + [total(gaps | {-1: 12 - size})]
        assert 12 - gaps.get(b, 12) == at
        gaps[b] = gaps.get(b, 12) - size
        assert total(gaps) == min(tries)


def test_packing_pieces(spark):
    data = docs(spark, ODD)
    got = packing.pack(data, queries.vocabulary(), group_rows=7).collect()
    tokens = packing.Tokens(queries.vocabulary())
    full = Counter()
    for i, t, _, _ in ODD:
        ids = tokens.of(t or "") + np.array([2], "<u4").tobytes()
        head = (len(ids) // 4 - 1) % 1024 + 1
        edges = [0, *range(head, len(ids) // 4 + 1, 1024)]
        full.update((i, p, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for p, (a, b) in enumerate(zip(edges, edges[1:])))
    assert Counter(tuple(r)[:5] for r in got) == full
    lines = {}
    for r in got:
        lines.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in lines.values():
        ends = 0
        for at, n in sorted(pieces):
            assert at == ends
            ends += n
        assert ends <= 1024
    assert packing.pack(data.limit(0), queries.vocabulary()).count() == 0


# ---- 8 and 9 classifiers


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers_odd_rows(spark, kind):
    op = quality if kind == "quality" else toxicity
    data = docs(spark, ODD + [(i, f"{EN} {i} " + ("you idiot !!! " * 3 if i % 2 else ""), "en", "a") for i in range(20, 140)])
    known = [(i, i % 2, i % 2) for i in range(20, 140)] + [(6, 1, 0), (6, 0, 0), (2, 0, 0), (1, None, None), (None, 1, 1), (9999, 1, 1), (7, 3, 3)]
    model = op.fit(data, labels(spark, known), left_out=9)
    found = op.score(data, model, ["doc_id"]).collect()
    assert len(found) == data.count() and all(0 <= r["score"] <= 1 for r in found)
    by = {r["doc_id"]: r["score"] for r in found}
    assert np.mean([(by[i] > 0.5) == (i % 2 == 1) for i in range(20, 140)]) > 0.95
    for some in ([], [(20, 1, 1), (22, 1, 1)]):
        bare = op.fit(data, labels(spark, some), left_out=9)
        assert all(0 <= r["score"] <= 1 for r in op.score(data, bare, ["doc_id"]).collect())
    assert op.score(data.limit(0), model, ["doc_id"]).count() == 0


@pytest.mark.parametrize("name,label", [("op8_quality", "quality"), ("op9_toxicity", "toxic")])
def test_classifiers_on_held_out_labels(spark, name, label):
    sf = "/root/testdata/sf0.1"
    found = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = found.where("held_out").select(label, "predicted").collect()
    for value in (0, 1):
        assert np.mean([r["predicted"] == value for r in rows if r[label] == value]) > 0.9


def test_quality_votes_are_exact_neighbours():
    rng = np.random.default_rng(4)
    texts = [EN.upper() + "!!" * (i % 5) if i % 2 else f"{EN} {i}. " * (1 + i % 4) for i in range(40)]
    model = quality.fit_rows([(int(i % 2 == 0), 1.0, quality.terms(t)) for i, t in enumerate(texts)], 8, 5, 4.0)
    probe = texts[7] + " more words here"
    v = model.project(quality.terms(probe)[None])[0]
    cosine = v @ model.vectors
    best = np.argsort(-cosine, kind="stable")[:5]
    want = (np.maximum(cosine[best], 0) ** 4.0 * model.votes[1][best]).sum() / (np.maximum(cosine[best], 0) ** 4.0).sum()
    assert model.score([probe])[0] == pytest.approx(want, abs=1e-6)
    assert rng is not None


def test_hidden_insults_are_seen():
    lexicon = toxicity.Lexicon(frozenset({"lowei*"}))
    for word in ("idiot", "Idiot!", "1d1ot", "i.d.i.o.t", "stuuupid", "loweichen", "STUPID"):
        assert lexicon.flags(word) & toxicity.HIT, word
    for word in ("house", "12345", "e-mail", "2024", ""):
        assert not lexicon.flags(word) & toxicity.HIT, word


# ---- 10 vectors


def test_vectors_of_lengths_that_pad_alike_are_not_compared(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=48)
    near = v + 0.001 * rng.normal(size=48)
    rows = [(1, v, "a"), (2, np.r_[v, 0.0, 0.0], "a"), (3, near, "a"), (4, np.r_[near, 0.0, 0.0], "a"), (5, np.r_[v, 0.0, 0.0], "b")]
    frame = spark.createDataFrame([(i, x.tolist(), c) for i, x, c in rows], "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_vectors(frame).collect()}
    assert got == {1: (1, 1), 3: (1, 1), 2: (1, 2), 4: (1, 2), 5: (0, 5)}


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 48))
    x = np.concatenate([c + 0.07 * rng.normal(size=(25, 48)) * np.linalg.norm(c) / 7 for c in centres]).astype("f4")
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    rows += [(600 + i, (2 * x[3]).tolist(), 1) for i in range(4)] + [(610 + i, x[7].tolist(), 1) for i in range(9)]
    rows += [(700, None, 1), (701, [0.0] * 48, 1), (702, [float("inf")] * 48, 1), (703, x[1].tolist(), None), (704, [None] * 48, 0), (705, [1.0], 1), (706, [2.0], 1)]
    frame = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, n int")
    good = [(i, np.array(v, "f4").astype("f8"), c) for i, v, c in rows
            if v and c is not None and all(e is not None and np.isfinite(e) for e in v) and any(v)]
    links, root = Counter(), {r[0]: r[0] for r in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, v, a), (j, w, b) in itertools.combinations(good, 2):
        if a == b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
            links.update((i, j))
            p, q = top(i), top(j)
            root[max(p, q)] = min(p, q)
    for block in (2048, 8):
        got = {r["vec_id"]: r for r in embed_dedup.near_vectors(frame, block=block).collect()}
        assert len(got) == len(rows)
        assert {i: r["n_links"] for i, r in got.items()} == {i: links[i] for i in got}
        assert {i: r["component_id"] for i, r in got.items()} == {i: top(i) for i in got}
        assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert embed_dedup.near_vectors(frame.limit(0)).count() == 0


def test_bucket_recall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    n = rng.normal(size=x.shape)
    n -= (n * x).sum(1)[:, None] * x
    n /= np.linalg.norm(n, axis=1)[:, None]
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * n
    a, b = (embed_dedup.bucket_codes(v, 6, 3, 2) for v in (x, y))
    assert np.mean([(b == a[:, i][:, None]).any(1) for i in range(a.shape[1])], axis=0).astype(bool).mean() > 0.999


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(1, 2), (2, 1), (3, 3)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 300)]} | {1: 1, 2: 1}
    assert got == want
