"""Quality classifier: nearest labelled neighbours in a latent-semantic space.

A text's terms are the shapes it is made of, whatever its language: n-grams of character classes (lower, upper, digit,
space, line end, each punctuation mark; runs of equal classes count once), shares of repeated words, and word and line
lengths. Their weighted rates on a bounded sample of labelled texts are reduced by a truncated singular value decomposition. The
labelled latent vectors, at most twice `sample_rows` of them, are broadcast. Every text is projected into the
space; blocks of texts are multiplied with all labelled vectors, which gives the exact cosines, and the `near` most
similar ones vote with their similarity, raised to a power, times the weight that restores the classes' shares.

Defined results: null and empty texts are scored like a text without terms, by the labelled texts' share of good ones;
without labelled texts the score is 0.5. Whole texts count, long ones in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabkit.llm.common import labelled

HASHED = 2048
_SPACE, _LINE, _LOWER, _UPPER, _DIGIT, _OTHER, _MARK = range(7)


def _classes() -> np.ndarray:
    """Class of each code point below 592, and one for all above; each ASCII mark has its own."""
    found, marks = [], 0
    for c in map(chr, range(592)):
        if c in "\n\r":
            found.append(_LINE)
        elif c.isspace() or not c.isprintable():
            found.append(_SPACE)
        elif c.isalpha():
            found.append(_UPPER if c.isupper() else _LOWER)
        elif c.isdigit():
            found.append(_DIGIT)
        elif c < "\x80":
            found.append(_MARK + marks)
            marks += 1
        else:
            found.append(_OTHER)
    return np.array([*found, _OTHER], "u4")


CLASS = _classes()
KINDS = int(CLASS.max()) + 1
PAIRS = KINDS * KINDS
REPEATS = 8
SIZE = KINDS + PAIRS + HASHED + REPEATS


def terms(text: str, block: int = 1 << 20) -> np.ndarray:
    """Square roots of the rates of a text's terms."""
    found = np.zeros(SIZE, "f4")
    for i in range(0, len(text), block):
        points = np.frombuffer(text[i : i + block].encode("utf-32-le", "surrogatepass"), "u4")
        c = CLASS[np.minimum(points, 592)]
        c = c[np.r_[True, (c[1:] != c[:-1]) | (c[1:] >= _OTHER)]]
        found[:KINDS] += np.bincount(c, minlength=KINDS)
        two = c[:-1] * np.uint32(KINDS) + c[1:]
        found[KINDS : KINDS + PAIRS] += np.bincount(two, minlength=PAIRS)
        three = (two[:-1] * np.uint32(KINDS) + c[2:]) * np.uint32(2654435761) >> np.uint32(21)
        found[KINDS + PAIRS : -REPEATS] += np.bincount(three, minlength=HASHED)
    total = found[:KINDS].sum()
    if total:
        found /= total
    words = text.split()
    if words:
        n, lines = len(words), text.split("\n")
        twice = sum(a == b for a, b in zip(words, words[1:])) / n
        again = 1 - len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2) if n > 2 else 0.0
        found[-REPEATS:] = [
            twice, again, 1 - len(set(words)) / n if n < 100 else 0.0, sum(map(str.isupper, words)) / n,
            min(1, len(text) / n / 40), min(1, n / len(lines) / 200), 1 - len(set(lines)) / len(lines), 1 / (1 + n / 50),
        ]
    return np.sqrt(np.maximum(found, 0))


@dataclass
class QualityModel:
    weight: np.ndarray  # terms
    space: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # dimensions x labelled texts, of length 1
    votes: np.ndarray  # 2 x labelled texts: weight, weight * label
    near: int
    power: float

    def project(self, rows: np.ndarray) -> np.ndarray:
        found = (rows * self.weight) @ self.space
        return found / np.maximum(np.sqrt((found**2).sum(1, keepdims=True)), 1e-9)

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.votes.shape[1]:
            return np.full(len(texts), 0.5)
        cosine = self.project(np.stack([terms(t) for t in texts])) @ self.vectors
        k = min(self.near, cosine.shape[1])
        # ties at the last place: the earlier labelled text, in an order that is fixed
        at = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < cosine.shape[1] else np.tile(np.arange(k), (len(texts), 1))
        weight = np.maximum(np.take_along_axis(cosine, at, 1), 0).astype("f8") ** self.power
        total = (weight * self.votes[0][at]).sum(1)
        prior = self.votes[1].sum() / self.votes[0].sum()
        return np.where(total > 0, (weight * self.votes[1][at]).sum(1) / np.maximum(total, 1e-300), prior).clip(0, 1)


def fit_rows(rows: list[tuple[int, float, np.ndarray]], dims: int, near: int, power: float) -> QualityModel:
    """From (label, weight, terms) of the labelled sample."""
    if not rows:
        return QualityModel(np.ones(SIZE), np.zeros((SIZE, 1)), np.zeros((1, 0)), np.zeros((2, 0)), near, power)
    x = np.stack([r[2] for r in rows])
    seen = (x > 0).sum(0)
    weight = np.where(seen > 0, np.log(1 + len(x) / np.maximum(seen, 1)), 0).astype("f4")
    weight[-REPEATS:] = 1.0
    x_, basis = x * weight, np.random.default_rng(0).normal(size=(SIZE, dims + 10)).astype("f4")
    for _ in range(6):  # leading right singular vectors by subspace iteration
        basis = np.linalg.qr(x_.T @ (x_ @ basis))[0]
    space = np.ascontiguousarray(basis @ np.linalg.svd(x_ @ basis, full_matrices=False)[2].T[:, :dims])
    model = QualityModel(weight, space, np.zeros((dims, 0), "f4"), np.zeros((2, 0)), near, power)
    model.vectors = np.ascontiguousarray(model.project(x).T)
    y, w = np.array([r[0] for r in rows], "f8"), np.array([r[1] for r in rows], "f8")
    model.votes = np.stack([w, w * y])
    return model


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    folds: int = 5,
    left_out: int = 0,
    sample_rows: int = 2500,
    dims: int = 48,
    near: int = 15,
    power: float = 8.0,
) -> QualityModel:
    """Learn from at most about `sample_rows` labelled texts of each class; their terms, of fixed size, are collected."""
    sample = labelled(docs, labels, label, sample_rows, folds, left_out)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [terms(t.as_py()).tobytes() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("label"), part.column("weight"), pa.array(found, pa.binary())],
                    names=["key", "label", "weight", "terms"],
                )

    rows = sample.repartition(8).mapInArrow(read, "key long, label int, weight double, terms binary").collect()
    rows = sorted(rows, key=lambda r: r["key"])
    return fit_rows([(r["label"], r["weight"], np.frombuffer(r["terms"], "f4")) for r in rows], dims, near, power)


def score(docs: DataFrame, model: QualityModel, keep: list[str], text: str = "text", block: int = 128) -> DataFrame:
    """Columns `keep` of every row, and its score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text).alias("text_"))
    schema = rows.select(*keep).schema.add("score", "double")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: QualityModel = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                part = batch.slice(i, block)
                found = model.score([t or "" for t in part.column("text_").to_pylist()])
                names = [c for c in part.schema.names if c != "text_"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found)], names=[*names, "score"])

    return rows.mapInArrow(vote, schema)
