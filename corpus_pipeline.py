"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Quality rules, SimHash near-duplicates, benchmark decontamination, mixing to source weights, token ids. Every stage but the
last returns the columns of ``documents``; a document that the mix takes twice is two rows. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontaminate, mixing, quality, simhash, tokens
from veilspark.llm.common import materialize, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.judge(docs, read(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return simhash.keep_one(docs).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.remove_leaking(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is taken as often as its weight asks for: a document becomes none, one or two rows."""
    return mixing.apply(docs).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, written as grammar-compressed shards; one row per document from the files."""
    return tokens.write_tokens(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("simhash near-duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to weights", mixing_stage),
    ("token ids", token_stage),
]

#: SQL can't express the stages (exact binomial cutoffs, components, token ids); tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir).select(F.col("doc_id"), "start", "n_tokens", "ids_crc32")
