"""A corpus made ready for training: each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eddyline.llm import exact_dedup, jaccard, mixing, packing, quality
from eddyline.llm.common import tune, written
from eddyline.llm.queries import WEIGHTS, tokenizer_path
from eddyline.sources.scratch import latest, only_last, release


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    tune(spark)
    return quality.good_documents(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the one with the smallest doc_id stays."""
    return jaccard.drop_near_duplicates(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources' blocks are due."""
    return mixing.mixed(docs, WEIGHTS)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces of token sequences, which follow the mixture by sequence_id.

    Tables have no order of rows, so positions are derived from the documents again: they are those of the stage before.
    """
    return packing.pack_documents(docs, tokenizer_path(), weights=WEIGHTS)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("jaccard_join", near_stage),
    ("pfair_mix", mix_stage),
    ("pack", pack_stage),
]

#: The classifier, the components and the packing aren't SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. A stage's scratch tables, and its predecessor's result, go when its own result is stored; the last one's stay until ``release``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with only_last(spark):
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            release(spark, before)
        before = latest()
    return STAGES[-1][1](spark, docs, sf_dir)
