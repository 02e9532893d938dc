"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon comes from a list kept here and from labelled texts: words, and beginnings of words, that are far more
frequent in toxic texts than in others. The labelled sample is dealt by a hash into three parts, so that no part sees what
it has helped to make: one finds the lexicon, one grows the trees, one calibrates them.

Features of a text: hits of the lexicon (number, share, different ones, most within 50 words), hits of the kept list, hits
within `REACH` words of a second-person word, share of second-person words, shares of capitals, of words in capitals,
of exclamation and question marks, of words that hide letters behind signs, digits or repeats, hits among
those, and the length.

Defined results: null and empty texts are scored like texts without words; if a part of the sample
lacks a class, both parts grow trees and their probability is the score; if both together do, the score is
the share of toxic texts among the labelled, 0 without labels. Whole texts count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tabkit.llm.common import labelled, uniform
from tabkit.session import written

# Insults, and words that address the reader, in the languages of the texts
INSULTS = frozenset(
    """idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting dumb clown imbecile
    filth vermin garbage retard bastard idiote imbécile crétin connard salaud débile ordure dummkopf trottel depp
    abschaum arschloch blödmann versager estúpido imbécil tonto basura escoria inútil asqueroso""".split()
)
SECOND_PERSON = frozenset(
    """you your yours yourself u ur tu toi ton ta tes vous votre vos du dich dir dein deine deinen euch euer ihr tú ti
    tus usted ustedes vosotros vuestro""".split()
)
ENDS = ".,;:!?\"'()[]{}<>*#%$&|-_/\\"
LEET = [str.maketrans("430157@$!|", x) for x in ("aeolstasll", "aeoistasii")]
REACH, WINDOW = 5, 50
PREFIXES = (3, 4, 5, 6, 7, 8)
FEATURES = 13
HIT, KEPT, SECOND, HIDDEN, CAPITAL = 1, 2, 4, 8, 16
_hides = re.compile(r"[^\W\d_][\d@$!|*._\-+#]+[^\W_]|\d[^\W\d_]|(.)\1\1")


def word_terms(word: str) -> list[str]:
    """A word, and its beginnings marked by a star."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


@dataclass
class Lexicon:
    terms: frozenset[str] = frozenset()
    room: int = 300_000
    known: dict[str, int] = field(default_factory=dict)

    def _match(self, bare: str) -> int:
        kept = KEPT if bare in INSULTS else 0
        return HIT | kept if kept or any(t in self.terms for t in word_terms(bare)) else 0

    def flags(self, word: str) -> int:
        """What a word as written is; remembered."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > self.room:
                self.known.clear()
            bare = word.lower().strip(ENDS)
            found = self._match(bare) | (SECOND if bare in SECOND_PERSON else 0)
            if len(word) > 1 and word.isupper():
                found |= CAPITAL
            if _hides.search(bare):
                found |= HIDDEN
                for signs in LEET:
                    plain = re.sub(r"(.)\1\1+", r"\1", bare.translate(signs))
                    found |= self._match(re.sub(r"[\W\d_]", "", plain))
            self.known[word] = found
        return found

    def features(self, text: str) -> list[float]:
        words = text.split()
        n = max(1, len(words))
        counts = Counter(words)
        flags = {w: self.flags(w) for w in counts}
        total = lambda flag: sum(c for w, c in counts.items() if flags[w] & flag)
        hits, near, dense = total(HIT), 0, 0
        if hits:
            at = [i for i, w in enumerate(words) if flags[w] & HIT]
            start = 0
            for stop in range(len(at)):
                while at[stop] - at[start] >= WINDOW:
                    start += 1
                dense = max(dense, stop - start + 1)
            near = sum(any(flags[w] & SECOND for w in words[max(0, i - REACH) : i + REACH + 1]) for i in at)
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1")
        upper = int(((data >= 65) & (data <= 90)).sum())
        letters = max(1, upper + int(((data >= 97) & (data <= 122)).sum()))
        marks = int(((data == 33) | (data == 63)).sum())
        hidden = [w for w in counts if flags[w] & HIDDEN]
        return [
            float(hits), hits / n, float(len({w.lower().strip(ENDS) for w in counts if flags[w] & HIT})), float(dense),
            float(total(KEPT)), float(near), total(SECOND) / n, upper / letters, total(CAPITAL) / n, marks / max(1, len(text)),
            sum(counts[w] for w in hidden) / n, float(sum(counts[w] for w in hidden if flags[w] & HIT)), float(np.log1p(len(words))),
        ]


def learn_lexicon(rows: DataFrame, most: int = 5000, least_texts: int = 3, lift: float = 10.0) -> frozenset[str]:
    """The `most` best terms that are in `least_texts` toxic texts or more, and `lift` times as often as in others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text")):
                words = {w.strip(ENDS) for w in text.as_py().lower().split()}
                seen[label].update({t for w in words if w for t in word_terms(w)})
        for label, found in enumerate(seen):
            items = list(found.items())
            for i in range(0, len(items), 50_000):
                part = items[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t for t, _ in part]), pa.array([label] * len(part), pa.int32()), pa.array([c for _, c in part])],
                    names=["term", "label", "n"],
                )

    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not totals.get(1) or not totals.get(0):
        return frozenset()
    found = rows.select("label", "text").mapInArrow(count, "term string, label int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("other"),
    )
    ratio = (F.col("toxic") / totals[1]) / ((F.col("other") + 0.5) / totals[0])
    found = found.where(F.col("toxic") >= least_texts).withColumn("ratio", ratio).where(F.col("ratio") >= lift)
    best = found.orderBy(F.desc(F.col("ratio") * F.sqrt("toxic")), "term").limit(most)
    return frozenset(r["term"] for r in best.select("term").collect())


@dataclass
class ToxicityModel:
    terms: frozenset[str]
    trees: GBTClassificationModel | None
    scale: IsotonicRegressionModel | None
    share: float


def featured(rows: DataFrame, terms: frozenset[str], keep: list[str], text: str) -> DataFrame:
    """Columns `keep` and the features of each text."""
    sent = rows.sparkSession.sparkContext.broadcast(terms)
    rows = rows.select(*keep, F.col(text).alias("text_"))
    schema = rows.select(*keep).schema.add("features_", ArrayType(DoubleType()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(sent.value)
        for batch in batches:
            found = [lexicon.features(t.as_py() or "") for t in batch.column("text_")]
            names = [c for c in batch.schema.names if c != "text_"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(found, pa.list_(pa.float64()))], names=[*names, "features_"]
            )

    found = rows.mapInArrow(read, schema)
    return found.withColumn("features_", array_to_vector("features_"))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, left_out: int = 0, sample_rows: int = 4000
) -> ToxicityModel:
    """Learn from at most about `sample_rows` labelled texts of each class."""
    sample = labelled(docs, labels, label, sample_rows, folds, left_out)
    sample = sample.withColumn("u", uniform(29, F.col("key")))
    terms = learn_lexicon(sample.where("u < 0.6").repartition(8))
    rows = featured(sample.where("u >= 0.6").repartition(8), terms, ["label", "weight", "u"], "text")
    rows = written(rows.withColumn("label", F.col("label").cast("double")), "toxic-features")
    grow, tune = rows.where("u < 0.86"), rows.where("u >= 0.86")
    sums = sample.agg(F.sum(F.col("weight") * F.col("label")).alias("toxic"), F.sum("weight").alias("all")).first()
    share = sums["toxic"] / sums["all"] if sums["all"] else 0.0
    both = lambda part: part.select("label").distinct().count() == 2
    calibrated = both(grow) and both(tune)
    if not calibrated:
        grow = rows
        if not both(grow):
            return ToxicityModel(terms, None, None, share)
    trees = GBTClassifier(
        featuresCol="features_", labelCol="label", weightCol="weight", predictionCol="class_", maxIter=15, maxDepth=3,
        stepSize=0.3, seed=7, cacheNodeIds=False, minInstancesPerNode=2,
    ).fit(grow)
    if not calibrated:
        return ToxicityModel(terms, trees, None, share)
    raw = _raw(trees.transform(tune)).select("label", "weight", "raw_")
    scale = IsotonicRegression(featuresCol="raw_", labelCol="label", weightCol="weight", predictionCol="score").fit(raw)
    return ToxicityModel(terms, trees, scale, share)


def _raw(rows: DataFrame) -> DataFrame:
    return rows.withColumn("raw_", vector_to_array("probability")[1])


def score(docs: DataFrame, model: ToxicityModel, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` of every row, and its score."""
    if model.trees is None:
        return docs.select(*keep).withColumn("score", F.lit(float(model.share)))
    rows = _raw(model.trees.transform(featured(docs, model.terms, keep, text)).select(*keep, "probability"))
    if model.scale is None:
        return rows.select(*keep, F.col("raw_").alias("score"))
    return model.scale.transform(rows.select(*keep, "raw_")).select(*keep, F.col("score").cast("double"))
