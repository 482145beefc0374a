"""The corpus pipeline: documents go through the stages in order; each stage's rows are written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import bpe, exact_dedup, mixing, quality, shared, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bits of 64 that near copies differ in at most, over five-word shingles; 0.8 alike are 9.7 on average, 0.9 are 6.6.
NEAR_BITS = 8
#: Poor text has no target here: the quality rules leave next to none, and a share for it would repeat that many hundred times.
MIX = {"good": 0.94, "toxic": 0.06}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the line labelling rejects go."""
    return quality.keep_good(docs, quality.model_for(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays."""
    return simhash.keep_one(docs, words_per_shingle=5, max_bits=NEAR_BITS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn at the fitted rates; the rows of a rate above one repeat."""
    return mixing.draw(docs, shared.load(spark, sf_dir, "labels"), MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their count, and whether decoding gives the text again."""
    return bpe.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing to target weights", mix),
    ("BPE encoding", encode),
]

#: The line-labelling model, SimHash and BPE are beyond SQL; tests compare the rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what lies between stages is in the folder that the cluster shares."""
    shared.shared_folder(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = shared.load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
