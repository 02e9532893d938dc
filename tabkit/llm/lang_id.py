"""Language identification by error-correcting output codes.

Every learned language gets a codeword of bits. For each bit a binary n-gram classifier (log ratio of the n-gram
rates of the languages with bit 1 and with bit 0, over hashed character 1- to 3-grams) predicts the bit; its mean per
n-gram is the bit's margin. Decoding adds up a loss for each language: -log of the probability of its bits, each
weighted by how often the classifier is right about that bit for that language on the training sample. The
smallest loss wins, and a close second marks the text as ambiguous.

The model is fitted on a sample of at most about `sample_rows` rows per language; it is a table of n-gram weights of
fixed size, sent to the tasks. Whole texts are scored, long ones in blocks.

Defined results: null texts and texts without a letter get `und`, score 0 and ambiguous; without labelled rows all
get `und`; with one learned language every text with a letter gets it, with score 1. Equal losses go to the
smaller language code. Scores do not depend on any other column.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.llm.common import stratified
from tabkit.session import written

BUCKETS = 1 << 14
UNKNOWN = "und"
_maybe = re.compile(r"[^\W\d_]").finditer  # also superscripts, fractions and circled digits
_MIX = np.array([2654435761, 2246822519, 3266489917], "u4")


def has_letter(text: str) -> bool:
    """Whether a character of the Unicode classes L occurs."""
    return any(m.group().isalpha() for m in _maybe(text))


def gram_counts(text: str, block: int = 1 << 20) -> np.ndarray:
    """How often each hashed 1-, 2- and 3-gram of the lower-case text occurs."""
    counts = np.zeros(BUCKETS, "f4")
    text = " " + text.lower() + " "
    for i in range(0, max(1, len(text) - 2), block):
        points = np.frombuffer(text[i : i + block + 2].encode("utf-32-le", "surrogatepass"), "u4")
        one = points * _MIX[0]
        two = one[:-1] ^ (points[1:] * _MIX[1])
        three = (two[:-1] * _MIX[2]) ^ one[2:]
        last = i + block + 2 >= len(text)
        own = (one, two, three) if last else (one[:-2], two[:-1], three)  # the next block has the others
        grams = np.concatenate([(g ^ (g >> np.uint32(15))) * _MIX[1] >> np.uint32(18) for g in own])
        counts += np.bincount(grams, minlength=BUCKETS)
    return counts


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n codewords of +1 and -1: all splits of the languages up to 6 of them, else random ones that lie far apart."""
    if n < 2:
        return np.ones((n, 1), "f4")
    if n <= 6:
        splits = [(1, *x) for x in itertools.product((1, -1), repeat=n - 1) if -1 in x]
        return np.array(splits, "f4").T
    bits, rng = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(200):
        words = rng.choice((1.0, -1.0), (n, bits)).astype("f4")
        words = words[:, np.abs(words.sum(0)) < n]  # a bit that all share says nothing
        near = int(np.min((words.shape[1] - (words @ words.T)) / 2 + 1e6 * np.eye(n)))
        if near > far:
            best, far = words, near
    return best


@dataclass
class LangModel:
    langs: list[str]
    words: np.ndarray  # languages x bits
    weights: np.ndarray  # n-grams x bits
    scale: np.ndarray  # bits
    trust: np.ndarray  # languages x bits, each row adds up to 1

    def margins(self, texts: list[str]) -> np.ndarray:
        counts = np.stack([gram_counts(t) for t in texts])
        return (counts @ self.weights) / counts.sum(1, keepdims=True)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        agree = self.words[None] * (margins * self.scale)[:, None, :]
        return (self.trust[None] * np.logaddexp(0, -agree)).sum(2)


def _counted(rows: DataFrame) -> list:
    """Sums of n-gram rates per language and task, few tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                sums[lang] = sums.get(lang, 0) + gram_counts(text.as_py())
        yield pa.RecordBatch.from_pylist(
            [{"lang": k, "counts": v.astype("f8").tobytes()} for k, v in sums.items()],
            pa.schema([("lang", pa.string()), ("counts", pa.binary())]),
        )

    return rows.mapInArrow(count, "lang string, counts binary").collect()


def fit(
    docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", sample_rows: int = 4000, tasks: int = 8
) -> LangModel:
    """Learn from a sample of the rows where `learn` holds and text and language are there."""
    rows = docs.where(learn).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).withColumn("key", F.xxhash64("text"))
    sample = stratified(rows, "lang", "key", sample_rows).dropDuplicates(["lang", "key"])
    sample = written(sample.select("lang", "text").repartition(tasks), "lang-sample")
    sums: dict[str, np.ndarray] = {}
    many = sample.select("lang").distinct().count() > 32  # then each language's sums come from one task
    for r in _counted(sample.repartition(tasks, "lang") if many else sample):
        sums[r["lang"]] = sums.get(r["lang"], 0) + np.frombuffer(r["counts"], "f8")
    langs = sorted(sums)
    words = codewords(len(langs))
    if len(langs) < 2:
        return LangModel(langs, words, np.zeros((BUCKETS, words.shape[1]), "f4"), np.ones(words.shape[1]), np.ones(words.shape))
    rates = np.stack([(sums[x] + 0.1) / (sums[x] + 0.1).sum() for x in langs])
    side = lambda sign: np.stack([rates[words[:, b] == sign].mean(0) for b in range(words.shape[1])], 1)
    weights = np.log(side(1) / side(-1)).astype("f4")
    model = LangModel(langs, words, weights, np.ones(words.shape[1]), np.ones(words.shape))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, part in _by_lang(batches):
            m = model.margins(part) * model.words[model.langs.index(lang)]
            yield pa.RecordBatch.from_pylist(
                [{"lang": lang, "n": len(m), "right": (m > 0).sum(0).tolist(), "size": np.abs(m).sum(0).tolist()}],
                pa.schema([("lang", pa.string()), ("n", pa.int64()), ("right", pa.list_(pa.float64())), ("size", pa.list_(pa.float64()))]),
            )

    found = sample.mapInArrow(measure, "lang string, n long, right array<double>, size array<double>")
    found = found.select("lang", "n", F.posexplode(F.arrays_zip("right", "size")).alias("bit", "x"))
    found = found.groupBy("lang", "bit").agg(F.sum("n").alias("n"), F.sum("x.right").alias("right"), F.sum("x.size").alias("size"))
    right, size, n = np.zeros(words.shape), np.zeros(words.shape), np.zeros(words.shape)
    for r in found.collect():
        at = langs.index(r["lang"]), r["bit"]
        right[at], size[at], n[at] = r["right"], r["size"], r["n"]
    trust = np.maximum(right / n - 0.5, 1e-3)
    model.trust = trust / trust.sum(1, keepdims=True)
    model.scale = 4 / np.maximum((size / n).mean(0), 1e-9)  # a usual text gives each bit odds of e^4
    return model


def _by_lang(batches: Iterator[pa.RecordBatch], size: int = 64) -> Iterator[tuple[str, list[str]]]:
    held: dict[str, list[str]] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            held.setdefault(lang, []).append(text.as_py())
            if len(held[lang]) == size:
                yield lang, held.pop(lang)
    yield from held.items()


def identify(docs: DataFrame, model: LangModel, keep: list[str], text: str = "text", close: float = 0.25) -> DataFrame:
    """Columns `keep` of each row with lang_pred, score and ambiguous.

    score: softmax of the losses, counted once per bit. ambiguous: the second loss is within `close` of the best,
    as a share of a usual text's gap.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text).alias("text_"))
    schema = rows.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LangModel = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = [t or "" for t in part.column("text_").to_pylist()]
                known = np.array([has_letter(t) for t in texts]) & bool(model.langs)
                pred, share, second = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                at = np.flatnonzero(known)
                if len(at):
                    losses = model.losses(model.margins([texts[j] for j in at]))
                    order = np.argsort(losses, axis=1, kind="stable")
                    best = order[:, 0]
                    for j, b in zip(at, best):
                        pred[j] = model.langs[b]
                    power = np.exp(-(losses - losses.min(1, keepdims=True)) * model.words.shape[1])
                    share[at] = 1 / power.sum(1)
                    gap = np.sort(losses, axis=1)
                    second[at] = gap[:, 1] - gap[:, 0] < close if len(model.langs) > 1 else False
                columns = [part.column(c) for c in part.schema.names if c != "text_"]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(pred), pa.array(share), pa.array(second)],
                    names=[*(c for c in part.schema.names if c != "text_"), "lang_pred", "score", "ambiguous"],
                )

    return rows.mapInArrow(score, schema)
