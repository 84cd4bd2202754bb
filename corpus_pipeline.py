"""A training corpus from ``documents``: toxicity, exact and near copies, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. The
first four return the columns of ``documents``; the last one returns the packed pieces.

In every stage a null text is the empty text, a very long one is read as a whole, a null id is an id of its own, an empty table
gives an empty one, and further columns, whatever their names, stay as they are until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from doseloom.llm import decontaminate, exact, neardup, packing, queries, toxicity
from doseloom.llm.tables import saved


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go; labels come from ``labels``. Rows of one text stay or go together."""
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays, a null id only where there is no other; of repeated rows one."""
    return exact.without_duplicates(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at a similarity of 0.8 or more the least id stays.

    Texts without words and rows without an id are linked with nothing and stay; an id with several texts is a document for each.
    """
    return neardup.without_near_copies(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 10 consecutive words of a benchmark item, or a whole shorter item, go; those without words stay."""
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids along the curve; a text without tokens is its end id."""
    return packing.pieces(docs, queries.tokenizer_file("word_bpe_49k.json"))


STAGES = [("toxicity", toxic_out), ("exact dedup", copies_out), ("near dedup", near_copies_out),
          ("benchmark decontamination", benchmark_out), ("packing", packed)]

#: A trained model, near-duplicate components and a tokenizer are beyond SQL; the tests hold each
#: stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
