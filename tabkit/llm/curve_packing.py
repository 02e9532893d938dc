"""Packing along a space-filling curve: neighbouring documents share sequences.

Token ids of a document are hashed into buckets; the logarithms of their counts are projected to a few Gaussian
dimensions. Projections are standardised over all documents and cut into cells, whose place on a Hilbert curve is the
document's key. Keys and lengths are sorted by ranges of (key, number), each range adds up its tokens, and the sums of the
ranges before give every document its place on one line of all tokens. The line is cut into sequences; what is left at
its end is cut into lengths that are powers of two, so nothing is padded.

Texts are tokenized once; ids are written (two bytes each, if the vocabulary allows) and joined with their places by the
row's number. That number is also the second part of the range key, so many equal documents are no hot range.

Defined results: a null text is empty, and a document without tokens is one piece with the end id; rows with equal or
null ids are packed each; very long texts are cut like others; an empty table gives no rows; other columns are ignored.
Documents with equal keys follow the order in which they were numbered.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.llm.packing import byte_of_symbol
from tabkit.session import written

PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

# Fixed value: the splitting rule of the vocabulary's pre-tokenizer, for letters L and digits N
WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^\s{L}{N}]+"
PLAIN_MOST = 0x17F  # the last character of texts that are split here: all below are composed, and lower-cased one by one


def plain_rules() -> tuple[re.Pattern, re.Pattern]:
    """What splits plain texts, and what makes a text not plain."""
    kinds = {chr(c): unicodedata.category(chr(c))[0] for c in range(0x20, PLAIN_MOST + 1)}
    letters, digits = ("".join(c for c, k in kinds.items() if k == kind) for kind in "LN")
    other = f"[^\\t\\n\\r\\x20-\\x7e\\xa0-\u012f\u0131-{chr(PLAIN_MOST)}]"
    # letters come first: no other part of the rule can start with one
    rule = f"[{letters}]+|'(?:[std]|re|ve|m|ll)|[{digits}]|[^\\s{letters}{digits}]+"
    return re.compile(rule), re.compile(other)


class WordTokens:
    """Token ids of texts as bytes, those of the `tokenizers` library for a vocabulary file whose pieces are words.

    The ids of a word do not depend on its neighbours, so they are looked up once and kept; up to `most` words. Texts
    are normalized and split by the library; plain texts, of Latin characters, by a pattern with the same result.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.kind = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        self.added = {x["content"]: np.array([x["id"]], self.kind).tobytes() for x in model.get("added_tokens", [])}
        longest = sorted(self.added, key=len, reverse=True)
        self.borders = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None
        rule = re.sub(r"{([LN])}", r"\\p{\1}", WORD_RULE)
        stages = (model.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        same = stages[0].get("pattern") == {"Regex": rule} and "Lowercase" in json.dumps(model.get("normalizer"))
        self.split, self.other = plain_rules() if same else (None, None)
        self.symbol = {b: c for c, b in byte_of_symbol().items()}
        self.known: tuple[dict[str, bytes], ...] = {}, {}
        self.most = most

    def _learn(self, word: str, plain: bool) -> bytes:
        """Ids of a run of a plain text between white space, or of a piece as the library splits it."""
        parts = self.split.findall(word) if plain else [word]
        if len(parts) > 1:
            found = b"".join([self.known[plain].get(p) or self._learn(p, plain) for p in parts])
        else:
            symbols = word if not plain or word.isascii() else word.encode().decode("latin-1").translate(self.symbol)
            found = np.array([t.id for t in self.library.model.tokenize(symbols)], self.kind).tobytes()
        if len(self.known[plain]) < self.most:
            self.known[plain][word] = found
        return found

    def of(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        plain = self.split is not None and not self.other.search(text)
        if plain:
            words = text.lower().split()
        else:
            normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
            words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        known = self.known[plain]
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            return b"".join([known.get(w) or self._learn(w, plain) for w in words])

    def whole(self, text: str) -> bytes:
        if self.borders is None or not self.borders.search(text):
            return self.of(text)
        return b"".join(self.added[p] if i % 2 else self.of(p) for i, p in enumerate(self.borders.split(text)))


_READY: dict[str, WordTokens] = {}


def hashed_counts(ids: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, bucket and logarithm of one plus the count, for every bucket that a document's ids fall into."""
    row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    flat = np.concatenate(ids).astype("u8") if ids else np.empty(0, "u8")
    bucket = (flat * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(buckets)
    pairs, counts = np.unique(row * buckets + bucket.astype("i8"), return_counts=True)
    return pairs // buckets, pairs % buckets, np.log1p(counts)


def projected(ids: list[np.ndarray], dims: int, buckets: int) -> np.ndarray:
    """(documents x dims) projections of the hashed documents, which are scaled to length 1."""
    row, bucket, value = hashed_counts(ids, buckets)
    plane = np.random.default_rng([13, buckets, dims]).normal(size=(buckets, dims))
    size = np.sqrt(np.bincount(row, value**2, len(ids)))
    sums = np.stack([np.bincount(row, value * plane[bucket, k], len(ids)) for k in range(dims)], 1)
    return sums / np.maximum(size, 1e-300)[:, None]


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with whole coordinates below 2^bits (rows x dimensions).

    From the most significant bit down, each point's coordinates are reflected and exchanged so that the sub-cube it
    lies in is passed in the curve's direction (Skilling's transform); the Gray code of the result is then undone.
    """
    x, dims = cells.astype("i8").copy(), cells.shape[1]
    for b in range(bits - 1, 0, -1):
        lower = (1 << b) - 1
        for k in range(dims):
            up = (x[:, k] >> b & 1).astype(bool)
            swap = np.where(up, 0, (x[:, 0] ^ x[:, k]) & lower)
            x[:, 0] = np.where(up, x[:, 0] ^ lower, x[:, 0] ^ swap)
            x[:, k] ^= swap if k else 0
    for k in range(1, dims):
        x[:, k] ^= x[:, k - 1]
    turn = np.zeros(len(x), "i8")
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] >> b & 1, (1 << b) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(len(x), "i8")
    for b in range(bits - 1, -1, -1):
        for k in range(dims):
            key = key << 1 | (x[:, k] >> b & 1)
    return key


def tokenized(docs: DataFrame, path: str, id_: str, text: str, end_id: int, dims: int, buckets: int) -> DataFrame:
    """id, no (of the row), ids, n, at (projections), as a written table."""
    name = path.rsplit("/", 1)[-1]

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if path not in _READY:
            _READY[path] = WordTokens(_place(path, name))
        tokens, no = _READY[path], TaskContext.get().partitionId() << 40
        end = np.array([end_id], tokens.kind).tobytes()
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                ids, size = [], 0
                while start + len(ids) < batch.num_rows and len(ids) < 1000 and size < 4 << 20:
                    ids.append(tokens.whole(batch.column("text")[start + len(ids)].as_py()) + end)
                    size += len(ids[-1])
                arrays = [np.frombuffer(x, tokens.kind) for x in ids]
                at = projected(arrays, dims, buckets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(start, len(ids)), pa.array(np.arange(no, no + len(ids))), pa.array(ids, pa.binary()),
                     pa.array([len(a) for a in arrays], pa.int64()), pa.array(list(at), pa.list_(pa.float64()))],
                    names=["id", "no", "ids", "n", "at"],
                )
                start, no = start + len(ids), no + len(ids)

    rows = docs.select(F.col(id_).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    return written(rows.mapInArrow(tokenize, "id long, no long, ids binary, n long, at array<double>"), "token-ids")


def _place(path: str, name: str) -> str:
    """The vocabulary file on this machine: the path, or else the file of that name among the public tokenizers."""
    import os

    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def sequence_ends(total: int, capacity: int) -> np.ndarray:
    """Ends of the sequences on the line behind the full ones: what is left, as falling powers of two."""
    left, at, ends = total % capacity, total - total % capacity, []
    for b in range(left.bit_length() - 1, -1, -1):
        if left >> b & 1:
            at += 1 << b
            ends.append(at)
    return np.array(ends, "i8")


def cuts(first: int, n: int, total: int, capacity: int, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of a document that lies on the line from `first` on."""
    full, at = total - total % capacity, first
    while at < first + n:
        if at < full:
            sequence = at // capacity
            begin, end = sequence * capacity, (sequence + 1) * capacity
        else:
            place = int(np.searchsorted(ends, at, "right"))
            sequence = full // capacity + place
            begin, end = (int(ends[place - 1]) if place else full), int(ends[place])
        stop = min(end, first + n)
        yield at - first, stop - at, sequence, at - begin
        at = stop


def pack(
    docs: DataFrame,
    path: str,
    id_: str = "doc_id",
    text: str = "text",
    capacity: int = 4096,
    end_id: int = 2,
    dims: int = 4,
    bits: int = 8,
    buckets: int = 1 << 14,
) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece.

    `path` is a vocabulary file of the `tokenizers` library; executors open it, or the public file of its name.
    """
    spark = docs.sparkSession
    rows = tokenized(docs, path, id_, text, end_id, dims, buckets)
    each = [F.col("at")[k] for k in range(dims)]
    about = rows.agg(*[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    middle = np.array([x or 0.0 for x in about[:dims]])
    width = np.array([x or 1.0 for x in about[dims:]])
    wide = "<u2" if rows.where(F.octet_length("ids") != 2 * F.col("n")).isEmpty() else "<u4"

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array(batch.column("at").to_pylist(), "f8").reshape(-1, dims)
            share = 1 / (1 + np.exp(-1.702 * (at - middle) / width))  # close to the normal distribution function
            cells = np.minimum((share * (1 << bits)).astype("i8"), (1 << bits) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(hilbert_key(cells, bits)), batch.column("no"), batch.column("n")], names=["key", "no", "n"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            ends = before + np.cumsum(n)
            columns = [batch.column("no"), pa.array(np.full(len(n), part, "i4")), pa.array(ends - n), batch.column("n")]
            before = int(ends[-1]) if len(n) else before
            yield pa.RecordBatch.from_arrays(columns, names=["no", "part", "first", "n"])

    # only keys and lengths are sorted; the ids join their places afterwards
    line = rows.select("no", "n", "at").mapInArrow(keyed, "key long, no long, n long")
    line = line.repartitionByRange("key", "no").sortWithinPartitions("key", "no")
    line = written(line.mapInArrow(placed, "no long, part int, first long, n long"), "token-line")
    sizes = sorted((r["part"], r["n"]) for r in line.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts = dict(zip((p for p, _ in sizes), np.cumsum([0, *[n for _, n in sizes]]).tolist()))
    total = sum(n for _, n in sizes)
    ends = sequence_ends(total, capacity)
    sent = spark.sparkContext.broadcast(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            parts, firsts, names = (batch.column(c).to_pylist() for c in ("part", "first", "id"))
            for part, first, name, ids in zip(parts, firsts, names, batch.column("ids")):
                ids = np.frombuffer(ids.as_buffer(), wide).astype("<u4")
                for start, length, sequence, offset in cuts(sent.value[part] + first, len(ids), total, capacity, ends):
                    crc = zlib.crc32(ids[start : start + length])
                    found.append((name, start, length, crc, len(ids), sequence, offset))
            if found:
                names = PIECES.replace(",", "").split()[::2]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=names)

    full = rows.select("no", "id", "ids").join(line.select("no", "part", "first"), "no")
    return full.mapInArrow(cut, PIECES).withColumnRenamed("id", id_)
