"""Near-duplicate documents by ProbMinHash.

A document is the weighted set of its five-word shingles; a shingle that occurs c times weighs 1 + ln c. The
similarity is the probability Jaccard index: the sum over shared shingles i of 1 / sum_j max(x_j / x_i, y_j / y_i), the
plain Jaccard index if all weights are equal. Each shingle sends Poisson arrivals at a rate of its weight to random
positions of the signature; a position keeps the shingle that arrives first, and a shingle stops once its next
arrival is later than all positions' (early termination). Two signatures agree at a position with the index as
probability.

Signatures are cut into bands. Documents that share a band become linked only if their exact index is high
enough. Documents with equal shingles are one class from the start, so copies never form pairs. In a band each
class is compared with one centre, a different one per band. Bands whose classes are then still in different
components are cut into blocks; a task multiplies the blocks' shingle matrices, compares all classes of
different components, and returns only the links that join components, so no pair that a band proposes is left
out and no list of pairs is made.

Words are runs of letters, marks and digits of the lower-case text, by Unicode class (cut after a megabyte). In scripts
that put no spaces between words (Han, Kana, Thai, Lao, Khmer, Burmese and others, found by the characters' names)
each character is a word, and so is each pictogram. Everything else separates: spaces, punctuation, controls and other
signs. Texts of one to four words are one shingle. Defined results: null texts, texts without words, and rows with a null id are alone; rows with
equal ids and equal texts are one document, different texts of an id are documents of their own, each in its own
group; n_shingles 0 for texts without words; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.llm.common import components, counted, in_blocks, runs
from tabkit.session import written

_GOLD, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 of each number."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


BLOCK = 1 << 20
# First words of the Unicode names of letters and marks of scripts without spaces between words.
UNSPACED = (
    "CJK", "IDEOGRAPHIC", "HIRAGANA", "KATAKANA", "HALFWIDTH KATAKANA", "HENTAIGANA", "BOPOMOFO", "VERTICAL IDEOGRAPHIC",
    "THAI", "LAO", "KHMER", "MYANMAR", "TAI", "NEW TAI", "JAVANESE", "BALINESE", "YI", "TANGUT", "NUSHU", "KHITAN",
)
_APART, _INSIDE, _SINGLE = range(3)


@functools.cache
def kinds() -> np.ndarray:
    """What each code point is to words: apart from them, inside one, or one of its own."""
    found = np.zeros(0x110000, "u1")
    for code in [*range(0x323B0), *range(0xE0100, 0xE01F0)]:
        sign = chr(code)
        group = unicodedata.category(sign)
        if group[0] in "LMN":
            found[code] = _SINGLE if unicodedata.name(sign, "").startswith(UNSPACED) else _INSIDE
        elif group == "So" and code > 255:
            found[code] = _SINGLE
    found[0xE000:0xF900] = found[0xF0000:] = _INSIDE  # private use
    return found


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, base, "u8")])


_UP = _powers(0x100000001B3, BLOCK)
_DOWN = _powers(pow(0x100000001B3, -1, 1 << 64), BLOCK)


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """64-bit hashes of each text's words, in order. Texts are joined and hashed in blocks of a megabyte."""
    joined, found = [t.lower().encode("utf-8", "surrogatepass") for t in texts], []
    offsets = np.cumsum([0, *(len(t) + 1 for t in joined)])
    data = np.frombuffer(b"\n".join(joined) + b"\n", "u1")
    places, at, kind = [], 0, kinds()
    while at < len(data):
        block = data[at : at + BLOCK]
        more = at + len(block) < len(data)
        if block.max() < 128:
            start_of, inside = np.arange(len(block) + 1), kind[block]
        else:
            if more:  # ends with a whole character
                block = block[: len(block) - 1 - int(np.argmax((block[:-5:-1] & 0xC0) != 0x80))]
            signs = block.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass")
            start_of = np.r_[np.flatnonzero((block & 0xC0) != 0x80), len(block)]
            inside = kind[np.frombuffer(signs, "<u4")]
        if more and not (inside == _INSIDE).all():  # ends between words
            inside = inside[: len(inside) - int(np.argmax(inside[::-1] != _INSIDE))]
            start_of = start_of[: len(inside) + 1]
            block = block[: start_of[-1]]
        # a word lies between two characters where one of them is apart, or of its own
        joins = (inside[:-1] == _INSIDE) & (inside[1:] == _INSIDE)
        word = inside != _APART
        start = start_of[np.flatnonzero(word & np.r_[True, ~joins])]
        stop = start_of[np.flatnonzero(word & np.r_[~joins, True]) + 1]
        sums = np.r_[np.uint64(0), np.cumsum((block.astype("u8") + np.uint64(1)) * _UP[: len(block)], dtype="u8")]
        found.append(mixed((sums[stop] - sums[start]) * _DOWN[start] + (stop - start).astype("u8")))
        places.append(start + at)
        at += len(block)
    hashes, places = np.concatenate(found), np.concatenate(places)
    return np.split(hashes, np.searchsorted(places, offsets[1:-1]))


def shingles(words: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and how often each occurs."""
    if not len(words):
        return words, np.empty(0, "i8")
    size = min(size, len(words))
    h = np.zeros(len(words) - size + 1, "u8")
    for i in range(size):
        h = mixed(h ^ words[i : len(words) - size + 1 + i])
    return np.unique(h, return_counts=True)


def signatures(hashes: list[np.ndarray], weights: list[np.ndarray], length: int) -> np.ndarray:
    """ProbMinHash signatures of many documents at once: (documents x length) shingle hashes."""
    sizes = [len(h) for h in hashes]
    doc, item, rate = np.repeat(np.arange(len(sizes)), sizes), np.concatenate(hashes), np.concatenate(weights)
    first = np.full(len(sizes) * length, np.inf)
    winner = np.zeros(len(sizes) * length, "u8")
    state, time = mixed(item), np.zeros(len(item))
    while len(item):
        state = mixed(state)
        u = ((state >> np.uint64(11)).astype("f8") + 0.5) / 2**53
        time = time - np.log(u) / rate
        state = mixed(state)
        at = doc * length + (state % np.uint64(length)).astype("i8")
        np.minimum.at(first, at, time)
        won = first[at] == time
        winner[at[won]] = item[won]
        live = time < first.reshape(-1, length).max(1)[doc]
        doc, item, rate, state, time = doc[live], item[live], rate[live], state[live], time[live]
    return winner.reshape(-1, length)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact index of two weighted sets given by sorted hashes and weights."""
    shared, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    alone_a, alone_b = x.sum() - x[i].sum(), y.sum() - y[j].sum()
    p, q = x[i], y[j]
    # sum over shared j of max(p_j / p_i, q_j / q_i): ordered by p/q the maximum switches sides once
    order = np.argsort(p / q, kind="stable")
    ratio, p, q = (p / q)[order], p[order], q[order]
    below = np.searchsorted(ratio, ratio, side="left")  # those of a smaller ratio have the larger q side
    sum_q, sum_p = np.r_[0.0, np.cumsum(q)], np.r_[0.0, np.cumsum(p)]
    total = (sum_p[-1] - sum_p[below]) / p + sum_q[below] / q + alone_a / p + alone_b / q
    return float((1 / total).sum())


def document_key(id_: str, text: str) -> Column:
    """A hash of a row's id and text: equal for rows that are one document."""
    return F.xxhash64(F.col(id_).cast("long"), F.col(text))


def signed(docs: DataFrame, id_: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """id, key (of the document), n_shingles, print (of the shingles and their numbers), bands (hashes, with their place mixed in)."""
    length = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, "text"):
                found = [shingles(w, size) for w in word_hashes([t or "" for t in part.column("text").to_pylist()])]
                full = [i for i, (h, _) in enumerate(found) if len(h)]
                marks = [None] * len(found)
                prints = np.zeros(len(found), "u8")
                if full:
                    got = signatures([found[i][0] for i in full], [1 + np.log(found[i][1]) for i in full], length)
                    keys = np.tile(np.arange(bands, dtype="u8"), (len(full), 1))
                    for r in range(rows):
                        keys = mixed(keys ^ got[:, r::rows])
                    for i, k in zip(full, keys):
                        h, n = found[i]
                        marks[i] = k.view("i8")
                        prints[i] = mixed(mixed(h) ^ n.astype("u8")).sum()
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("key"), pa.array([len(h) for h, _ in found], pa.int32()),
                     pa.array(prints.view("i8")), pa.array(marks, pa.list_(pa.int64()))],
                    names=["id", "key", "n_shingles", "print", "bands"],
                )

    texts = docs.select(F.col(id_).cast("long").alias("id"), document_key(id_, text).alias("key"), F.col(text).alias("text"))
    return texts.mapInArrow(sign, "id long, key long, n_shingles int, print long, bands array<long>")


def _portions(batch: pa.RecordBatch, *texts: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a few megabytes of text each."""
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy().astype("i8") for c in texts))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right"))
        stop = max(stop, start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def verified(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) of ids whose texts have an index of `least` or more."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, "text_a", "text_b"):
                both = part.column("text_a").to_pylist() + part.column("text_b").to_pylist()
                sets = [(h, 1 + np.log(n)) for h, n in (shingles(w, size) for w in word_hashes(both))]
                half = part.num_rows
                keep = [probability_jaccard(*sets[i], *sets[half + i]) >= least - 1e-9 for i in range(half)]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


def text_of(source: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text of the ids, which rows with equal texts may repeat. If ids are few, other texts are not shuffled."""
    return source.join(counted(ids), "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))


def shingled(texts: DataFrame, size: int) -> DataFrame:
    """id, hashes, numbers: each text's distinct shingles and how often they occur, as bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, "text"):
                found = [shingles(w, size) for w in word_hashes(part.column("text").to_pylist())]
                columns = [h.tobytes() for h, _ in found], [n.astype("u4").tobytes() for _, n in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array(c, pa.binary()) for c in columns)], names=["id", "hashes", "numbers"]
                )

    return texts.mapInArrow(cut, "id long, hashes binary, numbers binary")


def _overlaps(sets: list[tuple[np.ndarray, np.ndarray]], step: int = 4096) -> np.ndarray:
    """[i, j]: the share of set i's weight that lies on shingles of set j."""
    sizes = [len(h) for h, _ in sets]
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, place, count = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True, return_counts=True)
    weight = np.concatenate([w / w.sum() for _, w in sets]).astype("f4")
    often = count[place] > 1  # others are shared by nobody
    column = np.cumsum(count > 1)[place[often]] - 1
    owner, weight = owner[often], weight[often]
    order = np.argsort(column, kind="stable")
    column, owner, weight = column[order], owner[order], weight[order]
    found = np.zeros((len(sets), len(sets)), "f4")
    for at in range(0, int((count > 1).sum()), step):
        a, b = np.searchsorted(column, (at, at + step))
        there, mass = np.zeros((2, len(sets), step), "f4")
        there[owner[a:b], column[a:b] - at] = 1
        mass[owner[a:b], column[a:b] - at] = weight[a:b]
        found += mass @ there.T
    return found


def _joins(sets: list[tuple[np.ndarray, np.ndarray]], home: np.ndarray, cross: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of sets, of which cross[i, j] may be compared, that are similar and join different homes."""
    shared = _overlaps(sets)
    size = np.array([len(h) for h, _ in sets])
    plain = np.array([float(w.max()) == 1.0 for _, w in sets])
    # no index is larger than either set's shared part
    i, j = np.nonzero(np.triu(np.minimum(shared, shared.T) >= least - 1e-4, 1) & cross & (home[:, None] != home[None]))
    both = np.rint(shared[i, j] * size[i])
    simple = plain[i] & plain[j]
    index = np.where(simple, both / (size[i] + size[j] - both), 1.0)
    root = {h: h for h in home.tolist()}

    def top(h: int) -> int:
        while root[h] != h:
            root[h] = h = root[root[h]]
        return h

    found = []
    for k in np.lexsort((~simple, -index))[: int((index >= least).sum())].tolist():
        a, b = top(int(home[i[k]])), top(int(home[j[k]]))
        if a != b and (simple[k] or probability_jaccard(*sets[i[k]], *sets[j[k]]) >= least - 1e-9):
            root[max(a, b)] = min(a, b)
            found.append((int(i[k]), int(j[k])))
    return found


def joining(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join different components within the groups (key, low, high)."""
    key = ["key", "low", "high"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, key):
            home, side = group.column("component").to_numpy(), group.column("side").to_numpy()
            if (home == home[0]).all():
                continue
            numbers = [np.frombuffer(x, "u4") for x in group.column("numbers").to_pylist()]
            hashes = [np.frombuffer(x, "u8") for x in group.column("hashes").to_pylist()]
            cross = side[:, None] != side[None] if (side != side[0]).any() else np.ones((len(home),) * 2, bool)
            found = _joins([(h, 1 + np.log(n)) for h, n in zip(hashes, numbers)], home, cross, least)
            ids = group.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[p[x]] for p in found], pa.int64()) for x in (0, 1)], names=["a", "b"]
            )

    dealt = members.join(sets, "id").repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(join, "a long, b long")


def grouped(
    docs: DataFrame,
    id_: str = "doc_id",
    text: str = "text",
    size: int = 5,
    least: float = 0.8,
    bands: int = 20,
    rows: int = 4,
    block: int = 512,
) -> DataFrame:
    """id, key (of the document), n_shingles, group (null for rows that are alone), component (smallest id of the group) of every row.

    A pair with an index of 0.8 shares one of 20 bands of 4 with probability 0.99997.
    """
    marked = written(signed(docs, id_, text, size, bands, rows), "signatures")
    some = marked.where("n_shingles > 0 AND id IS NOT NULL")
    # an id may have several texts, so a class goes by the key of its first document
    first = F.min_by(F.struct("key", "bands"), F.struct("id", "key")).alias("first")
    classes = some.groupBy("print", "n_shingles").agg(F.min("id").alias("rep"), first)
    classes = classes.select("print", "n_shingles", "rep", F.col("first.key").alias("name"), F.col("first.bands").alias("bands"))
    classes = written(classes, "classes")
    member = written(classes.select(F.col("name").alias("id"), F.posexplode("bands").alias("band", "key")), "bands")

    # the centre of a band is the class with the smallest hash that depends on the band, so that centres vary
    rank = F.struct(F.xxhash64("key", "id").alias("h"), "id")
    centres = member.groupBy("key").agg(F.min(rank)["id"].alias("a"), F.count("*").alias("n")).where("n > 1")
    shared = written(member.join(centres.select("key", "a"), "key").select("key", "id", "a"), "shared")
    first = shared.where("a <> id").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    first = written(first, "pairs")
    source = docs.where(F.col(id_).isNotNull()).select(document_key(id_, text).alias("id"), F.col(text).alias("text"))
    source = source.where("text IS NOT NULL")

    texts = text_of(source, first.select(F.explode(F.array("a", "b")).alias("id")))
    links = written(verified(first, texts, size, least), "links")
    found = written(components(links, "a", "b"), "components")
    # bands that still hold several components; in those of two classes the pair is already compared
    home = shared.join(found.withColumnRenamed("node", "id"), "id", "left")
    home = written(home.select("key", "id", F.coalesce("component", "id").alias("component")), "homes")
    open_ = home.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d"), F.count("*").alias("n"))
    open_ = home.join(open_.where("c < d AND n > 2").select("key", "n"), "key")
    open_ = written(in_blocks(open_, "n", block, "id", "key").select("key", "low", "high", "side", "id", "component"), "open")
    texts = text_of(source, open_.select("id"))
    links = written(joining(open_, shingled(texts, size), least), "links")
    if not links.isEmpty():
        links = links.union(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        found = written(components(links, "a", "b"), "components")

    linked = written(classes.select("name", "rep").join(found.select(F.col("node").alias("name"), F.col("component").alias("group")), "name"), "linked")
    linked = linked.join(linked.groupBy("group").agg(F.min("rep").alias("component")), "group").select("name", "group", "component")
    groups = classes.select("print", "n_shingles", "name", "rep").join(written(linked, "linked"), "name", "left").select(
        "print", F.col("n_shingles").alias("n"),
        F.coalesce("group", "name").alias("group"), F.coalesce("component", "rep").alias("component"),
    )
    groups = written(groups, "groups")
    rows_ = marked.select("id", "key", "n_shingles", "print").alias("m")
    same = (F.col("m.print") == groups["print"]) & (F.col("n_shingles") == F.col("n")) & F.col("id").isNotNull()
    joined = rows_.join(groups, same, "left")
    return joined.select("id", "key", "n_shingles", "group", F.coalesce("component", "id").alias("component"))


def near_duplicates(docs: DataFrame, id_: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """id, n_shingles, component (smallest id of its group), kept (whether it is that id) for every row."""
    found = grouped(docs, id_, text, **settings)
    return found.select(
        F.col("id").alias(id_), "n_shingles", "component", F.col("component").eqNullSafe(F.col("id")).alias("kept")
    )
