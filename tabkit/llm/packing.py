"""Best-fit packing of token sequences by the sum-of-squares rule.

Documents become token ids with an end id; longer ones than a sequence are cut into full pieces, the first
piece holding what is left over. Pieces of full length are sequences of their own. The others are packed, longest
first: a piece goes into the gap, or a new bin, that makes the sum over gaps of squared numbers of open bins
smallest, which keeps a varied stock of gaps that later pieces can fill exactly.

Pieces are dealt by a hash into groups of about `group_rows`; each task packs its groups alone and wastes a few bins
per group. Only lengths and checksums are kept between the passes; texts are tokenized once, in the tasks
that read them.

Defined results: a null text is empty, and a document without tokens is one piece with the end id; rows with
equal ids are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.session import written

PIECES = "id long, piece int, start long, length long, ids_crc32 long"


# Fixed value: the splitting rule of byte-level BPE, and how it treats runs of white space
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|"
RUNS = r"\s+(?!\S)|\s+"


def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as symbols from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokens:
    """Token ids of texts, as bytes of little-endian unsigned 32-bit numbers.

    The ids are those of the `tokenizers` library for the vocabulary file; tiktoken's merging loop, fed with the
    file's own ranks, finds them several times faster. The rule's look-ahead only matters where white-space
    characters meet, so texts without such runs are split by a pattern that needs none. `of` takes the file's added
    tokens for ordinary text; `whole` gives them their own ids, as the library does by default.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        added = model.get("added_tokens", [])
        special = {x["content"] for x in added}  # ordinary text in `of`
        byte = byte_of_symbol()
        ranks = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        made = lambda rule: tiktoken.Encoding("file", pat_str=rule, mergeable_ranks=ranks, special_tokens={})
        self.plain, self.full = made(SPLIT + r"\s").encode_ordinary, made(SPLIT + RUNS).encode_ordinary
        self.runs = re.compile(r"\s\s").search
        self.added = {x["content"]: np.array([x["id"]], "<u4").tobytes() for x in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.borders = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None
        self.library = None
        if any(x.get("single_word") or x.get("lstrip") or x.get("rstrip") for x in added):
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)  # tokens that depend on their neighbours are left to it

    def of(self, text: str) -> bytes:
        return array("I", (self.full if self.runs(text) else self.plain)(text)).tobytes()

    def whole(self, text: str) -> bytes:
        if self.borders is None or not self.borders.search(text):
            return self.of(text)
        if self.library is not None:
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(self.added[p] if i % 2 else self.of(p) for i, p in enumerate(self.borders.split(text)))


_READY: dict[str, Tokens] = {}


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of a document's pieces."""
    n = len(ids) // 4
    head = (n - 1) % capacity + 1
    edges = [0, *range(head, n + 1, capacity)]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(edges, edges[1:])]


def pieces(docs: DataFrame, path: str, id_: str, text: str, capacity: int, end_id: int) -> DataFrame:
    end = np.array([end_id], "<u4").tobytes()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _READY:
            _READY[path] = Tokens(path)
        tokens = _READY[path]
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part, rows = batch.slice(i, 1000), []
                for id_, text in zip(part.column("id").to_pylist(), part.column("text")):
                    rows += [(id_, p, *x) for p, x in enumerate(cut(tokens.whole(text.as_py()) + end, capacity))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), *[pa.int64()] * 3))],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col(id_).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    # numbers of rows, stored so that they stay when a task runs again
    return written(rows.mapInArrow(tokenize, PIECES).withColumn("row", F.monotonically_increasing_id()), "pieces")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, taken in the given order."""
    counts = np.zeros(capacity + 1, "i8")  # open bins by gap; gap 0 and a new bin's gap do not count
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, used = np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8"), 0
    for i, size in enumerate(lengths.tolist()):
        if size >= capacity:
            gap = capacity
        else:
            # change of the sum when a bin of gap g turns into one of gap g - size
            after = 2 * counts[: capacity - size + 1] + 1
            after[0] = 0
            change = after - 2 * counts[size:] + 1
            change[counts[size:] == 0] = 1 << 40
            change[-1] = after[-1]  # a new bin takes none away
            gap = size + int(change.argmin())
        if gap == capacity:
            b, used = used, used + 1
        else:
            b = stock[gap].pop()
            counts[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > size:
            stock[gap - size].append(b)
            counts[gap - size] += 1
    return bins, offsets


def pack(
    docs: DataFrame,
    path: str,
    id_: str = "doc_id",
    text: str = "text",
    capacity: int = 1024,
    end_id: int = 2,
    group_rows: int = 50_000,
) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset for every piece.

    `path` is a vocabulary file of byte-level BPE for the `tokenizers` library, readable on every executor.
    """
    rows = pieces(docs, path, id_, text, capacity, end_id)
    groups = max(1, -(-rows.count() // group_rows))
    schema = f"{PIECES}, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks().sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending")])
        bins, offsets = sum_of_squares(rows.column("length").to_numpy(), capacity)
        bins += TaskContext.get().partitionId() << 40
        rows = rows.append_column("sequence_id", pa.array(bins)).append_column("offset", pa.array(offsets))
        yield from rows.to_batches(max_chunksize=50_000)

    dealt = rows.repartition(groups, F.xxhash64("row")).drop("row")  # repeated rows go to all groups
    return dealt.mapInArrow(place, schema).withColumnRenamed("id", id_)
