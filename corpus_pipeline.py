"""The corpus pipeline: quality classifier, Jaccard join, substring dedup, benchmark decontamination, BPE encoding.

Each stage takes what its predecessor kept and returns a DataFrame, which is written as Parquet and read again.

Defined cases, for all stages: an empty table stays empty; other columns, whatever their names, pass by; rows that repeat are kept or
dropped alike.  A null text counts as empty: the classifier scores it, it links with nothing, stays null in the substring dedup, is
not contaminated and has no tokens.  A null doc_id is a row like others; see jaccard.representatives for which copy stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm import bpe, decontaminate, jaccard, quality, substrings
from quillspark.llm.common import Scratch, table
from quillspark.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by Jaccard similarity 0.8 the one of the smallest doc_id."""
    return jaccard.representatives(docs)


def take_out_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand in earlier ones; a whole-number n_chars follows, columns that the operator names itself come back."""
    marks = [c for c in ("removed_chars", "n_spans") if c in docs.columns]
    renamed = docs.withColumnsRenamed({c: f"{c} of the input" for c in marks})
    out = substrings.deduplicate(renamed)
    if dict(docs.dtypes).get("n_chars") in ("int", "bigint"):
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("n_spans") > 0, length).otherwise(F.col("n_chars")))
    return out.drop("removed_chars", "n_spans").withColumnsRenamed({f"{c} of the input": c for c in marks}).select(docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item: one passage is enough to spoil a test."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), items=1)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of each document."""
    return bpe.encode_ids(docs, vocabulary())


STAGES = [
    ("quality_classifier", keep_quality),
    ("jaccard_join", keep_one_of_each_group),
    ("substring_dedup", take_out_repeats),
    ("decontaminate", keep_uncontaminated),
    ("bpe", encode),
]

#: Trained scores and content-defined chunks are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
