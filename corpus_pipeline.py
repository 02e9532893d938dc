"""From raw documents to packed sequences: five stages, each one operator of tabkit.llm.

Every stage works on all rows that the one before kept, and all but the last return the columns of documents, whatever
these are called. Rows may repeat and ids may be null. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.llm import lang_id, minhash, mixing, packing, quality
from tabkit.llm.common import counted
from tabkit.llm.queries import MIX, lang_model, vocabulary
from tabkit.session import written

MIN_LANG_SCORE = 0.5
MIN_QUALITY = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go: no letter, or no language that is likelier than all others together."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text_to_read"))
    found = lang_id.identify(rows, lang_model(docs), ["row"], text="text_to_read")
    good = (F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= MIN_LANG_SCORE)
    return found.where(good).select("row.*")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier holds for bad ones go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text_to_read"))
    found = quality.score(rows, model, ["row"], text="text_to_read")
    return found.where(F.col("score") >= MIN_QUALITY).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Different texts of an id are different documents. Rows with equal ids and equal texts are one.
    """
    found = written(minhash.grouped(docs), "near-duplicates").where("id IS NOT NULL")
    rows = docs.select(F.struct(*docs.columns).alias("row"), minhash.document_key("doc_id", "text").alias("key"))
    rows = rows.withColumn("id", F.col("row.doc_id").cast("long"))
    gone = counted(found.where("id <> component").select("key"))
    rest = rows.join(gone, "key", "left_anti")
    first = found.where("id = component")
    repeated = counted(first.groupBy("id").count().where("count > 1").select("id"))
    once = rest.join(repeated, "id", "left_anti").select("row.*")
    often = rest.join(repeated, "id", "left_semi")
    # of texts in one group under the smallest id, the one with the smallest key stays; texts without words are alone
    chosen = first.join(repeated, "id", "left_semi").groupBy("id", F.coalesce("group", "key").alias("group")).agg(F.min("key").alias("key"))
    often = often.join(chosen.select("id", "key"), ["id", "key"], "left_semi").groupBy("id", "key").agg(F.first("row").alias("row"))
    return once.unionByName(often.select("row.*")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, kept or dropped whole, so that each source comes near its target."""
    rows = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))
    found = mixing.mix(rows, MIX, border="whole", keep=["row"]).where("copies > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("quality", classify_quality),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs


# Classifiers, hashes of texts and tokenizers are beyond SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
