"""The operators as queries on the given tables, and what SQL can say of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doseloom.llm import (decontaminate, exact, merkle, neardup, negatives, packing, pii, quality, rangecoder, repeats, sharding,
                          sql, toxicity, urlfilter)
from doseloom.plans.storage import new_folder

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def op1_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classified(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file; the files are on every executor, beside the libraries."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op2_curve_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pieces(_table(spark, sf, "documents"), tokenizer_file("word_bpe_49k.json"))


def op3_range_coder(spark: SparkSession, sf: str) -> DataFrame:
    uri = new_folder(spark, "token-ids")
    rangecoder.write_ids(_table(spark, sf, "documents"), uri, tokenizer_file("byte_bpe_50k.json"))
    return rangecoder.read_ids(spark, uri, with_ids=False).drop("ids")


def op4_block_naming(spark: SparkSession, sf: str) -> DataFrame:
    return exact.duplicates(_table(spark, sf, "documents"))


def op5_hash_tree(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.assign(_table(spark, sf, "documents"), sharding.tree_of(40), sharding.tree_of(40, grown=1))
    return placed.withColumn("law", F.lit("key"))


def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.digests(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op7_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.digests(_table(spark, sf, "documents"))


def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.classified(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op9_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.classes(_table(spark, sf, "documents"))


def op10_contextual_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digests(_table(spark, sf, "documents"))


def op11_octopus_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.proved(_table(spark, sf, "documents"))


#: The rules of the query.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op12_redirect_filter(spark: SparkSession, sf: str) -> DataFrame:
    found = urlfilter.judged(_table(spark, sf, "pages"), urlfilter.rule_table(spark, URL_RULES))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op13_slot_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return negatives.mined(_table(spark, sf, "embeddings"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_quality, op2_curve_packing, op3_range_coder, op4_block_naming, op5_hash_tree, op6_decontamination, op7_repeats,
    op8_toxicity, op9_near_duplicates, op10_contextual_pii, op11_octopus_manifest,
    op12_redirect_filter, op13_slot_negatives)}

SQL: dict[str, str] = {
    "op4_block_naming": sql.EXACT,
    "op6_decontamination": sql.DECONTAMINATION,
    "op7_repeats": sql.REPEATS,
    "op9_near_duplicates": sql.NEAR_DUPLICATES,
    "op11_octopus_manifest": sql.MERKLE,
    "op12_redirect_filter": sql.url_filter(URL_RULES),
    "op13_slot_negatives": sql.NEGATIVES,
}
