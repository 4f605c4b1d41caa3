"""The corpus pipeline: five stages over documents, each written and reread by its runner.

quality        documents that the classifier rejects go
deduplicate    one document of each component of near copies stays: five-word shingles, similarity 0.8 or more
pseudonymise   personal data in texts becomes pseudonyms; n_chars follows
mix            each document is repeated as often as the source weights take it (perhaps not at all)
encode         ids of each text that is left, counted and hashed, and decoded again

A stage works on all rows that the one before kept. Null texts and ids, empty tables and repeated
rows are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, near_copies, pii_feistel, quality_cnn
from tessera.llm.common import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_cnn.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_cnn.drop_low_quality(docs.select(*COLUMNS), model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_near_copies(docs.select(*COLUMNS))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = pii_feistel.pseudonymise(docs.select(*COLUMNS), pii_feistel.EXAMPLE_KEY)
    return done.withColumn("n_chars", F.when(F.col("n_pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_to_weights(docs.select(*COLUMNS), F.array("source"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(docs, "byte_bpe_50k.json", keep=False)


STAGES = [("quality", quality), ("deduplicate", deduplicate), ("pseudonymise", pseudonymise), ("mix", mix), ("encode", encode)]
#: A learned score, fingerprints and a tokenizer aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
