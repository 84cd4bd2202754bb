"""Weighted effect-allele dosage per sample from a sparse call table.

An absent call means homozygous reference, so a dense score would visit
samples x variants cells. With ``miss(v)`` the dosage of an absent cell,

    total(s) = sum_v miss(v) w(v) + sum over stored calls (dosage - miss) w

the first term is one number for all samples and the second one touches only
stored calls. The variant count is the number of matched variants for everyone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseloom.functions import genotype as g
from doseloom.operators.guards import conforms
from doseloom.plans.sizing import BROADCAST_ROWS
from doseloom.plans.storage import cut_lineage
from doseloom.sources.readers import Genotypes

LOCUS = ["contig", "position"]
SALTS = 16
ONE_IN = 64  # of the values that rows are salted by, those in the sample for hot loci
RISK_LABELS: Sequence[str] = ("Very Low", "Low", "Average", "High", "Very High")


def one_weight_per_locus(weights: DataFrame) -> DataFrame:
    """Keep one weight per locus by a fixed order, and count what it replaced.

    The locus lookup returns a single row; the smallest (effect allele, weight)
    is taken so that reruns agree. NULL loci match nothing and are dropped.
    """
    conforms(weights, "weight void, contig void, position void, effect_allele void")
    return (weights.where(F.col("contig").isNotNull() & F.col("position").isNotNull())
            .groupBy(*LOCUS)
            .agg(F.min(F.struct("effect_allele", "weight")).alias("w"),
                 F.count(F.lit(1)).alias("locus_weights"))
            .select(*LOCUS, "w.effect_allele", "w.weight", "locus_weights"))


def few_weights(weights: DataFrame, max_broadcast: int = BROADCAST_ROWS) -> bool:
    """Whether the weights may be broadcast. The raw table bounds the chosen
    rows and is counted without an aggregation."""
    return weights.count() <= max_broadcast


def hot_loci(rows: DataFrame, salt_by: str, one_in: int = ONE_IN) -> DataFrame:
    """Loci that hold so many rows that they would fill a shuffle task, with their rows in a hash sample.

    The rows of one in ``one_in`` values of ``salt_by`` are counted by locus; a locus is hot with more than a quarter of the rows
    that a shuffle task gets on average. At most four times as many loci as tasks can be hot, however many rows there are.
    The choice by that column alone reaches below joins and aggregates that make the rows, so these are not made twice as a
    whole; rows that share its value could not be spread by it anyway.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sampled = rows.where(F.pmod(F.xxhash64(salt_by), F.lit(one_in)) == 0).groupBy(*LOCUS).agg(F.count(F.lit(1)).alias("sampled"))
    total = sampled.agg(F.sum("sampled")).scalar()
    return sampled.where((F.col("sampled") * (4 * tasks) > total) & (F.col("sampled") > 1))


def with_weights(rows: DataFrame, weights: DataFrame, how: str = "inner", salt_by: str | None = None,
                 few: bool | None = None, sampled: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Rows met with the one weight at their locus.

    Few weights are broadcast. Otherwise both sides are shuffled and merged; with
    ``salt_by`` the rows of each hot locus go to ``SALTS`` tasks by that column,
    each with its copy of the weight, and all other weights are sent once. ``sampled`` makes the rows of
    ``hot_loci``'s sample, where there is a cheaper way to them than through ``rows``.
    """
    chosen = one_weight_per_locus(weights)
    if few_weights(weights) if few is None else few:
        return rows.join(F.broadcast(chosen), LOCUS, how)
    if salt_by is None:
        return rows.join(chosen.hint("merge"), LOCUS, how)
    hot = F.broadcast(cut_lineage(hot_loci(sampled() if sampled else rows, salt_by).select(*LOCUS, F.lit(True).alias("_hot"))))
    copies = chosen.join(hot, LOCUS, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_hot"), SALTS - 1).otherwise(0)))).drop("_hot")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int")).otherwise(0)
    salted = rows.join(hot, LOCUS, "left").withColumn("_salt", salt).drop("_hot")
    return salted.join(copies.hint("merge"), [*LOCUS, "_salt"], how).drop("_salt")


def annotate_variants(variants: DataFrame, weights: DataFrame) -> DataFrame:
    """Every variant row with the weight at its locus, NULL where there is none."""
    return with_weights(variants, weights, how="left")


def found_variants(variants: DataFrame, weights: DataFrame) -> DataFrame:
    """Variant rows that have a weight, with the weight's columns."""
    return with_weights(variants, weights).select(*LOCUS, "alleles", "effect_allele", "weight")


def _placed(weighted: DataFrame) -> DataFrame:
    """Weighted rows with the place of the effect allele."""
    return weighted.withColumn("_place", g.effect_place(F.col("alleles"), F.col("effect_allele")))


def _slim(calls: DataFrame) -> DataFrame:
    """Calls with all that a dosage needs in short columns as well; the arrays stay out of a shuffle unless they are read after it.

    Alleles are a list joined by commas; only an array that such a list can't say (a comma, a null, no allele) is kept as it is.
    The two indices of a call are the halves of one number.
    """
    one, two = (F.get("gt", F.lit(i)).cast("long") for i in (0, 1))
    plain = (F.size("alleles") > 0) & ~F.exists("alleles", lambda a: a.isNull() | a.contains(","))
    return calls.withColumns({"_listed": F.when(plain, F.array_join("alleles", ",")),
                              "_odd": F.when(plain, F.lit(None)).otherwise(F.col("alleles")),
                              "_pair": F.shiftleft(one, 32).bitwiseOR(two.bitwiseAND(F.lit(0xFFFFFFFF)))})


def _placed_calls(calls: DataFrame, weights: DataFrame, few: bool | None = None,
                  sampled: Callable[[], DataFrame] | None = None) -> tuple[DataFrame, Column]:
    """Weighted calls with the place of the effect allele, and their genotype."""
    few = few_weights(weights) if few is None else few
    if few:
        return _placed(with_weights(calls, weights, salt_by="s", few=True)), F.col("gt")
    met = with_weights(_slim(calls), weights, salt_by="s", few=False, sampled=sampled)
    place = F.coalesce(g.effect_place(F.col("_odd"), F.col("effect_allele")), F.find_in_set("effect_allele", "_listed"))
    one, two = F.shiftright("_pair", 32), F.shiftright(F.shiftleft("_pair", 32), 32)
    return met.withColumn("_place", place).drop("_listed", "_odd"), F.array(one.cast("int"), two.cast("int"))


def call_dosages(calls: DataFrame, weights: DataFrame, allele_specific: bool = False) -> DataFrame:
    """Stored calls at weighted loci with dosage and contribution."""
    met, gt = _placed_calls(calls, weights)
    return (met.withColumn("dosage", g.effect_dosage(gt, F.col("_place"), allele_specific))
            .withColumn("contribution", F.col("dosage") * F.col("weight")).drop("_place", "_pair"))


def prune_calls(data: Genotypes, weights: DataFrame, max_broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """Calls whose (contig, block) holds a weight; all calls where they are not stored in blocks.

    The block size is the stored one. Blocks that are counted as few are broadcast, which makes them a partition
    filter of the scan as well: folders without a weight are not read. Beyond that a shuffled semi join drops their calls.
    A folder of several blocks is read if one of them holds a weight, and the calls of its other blocks are dropped.
    """
    if not data.block_size:
        return data.calls
    # Positions count from 1; a comparison, unlike a null test, lets Spark expect that the blocks prune folders.
    blocks = (weights.where(F.col("contig").isNotNull() & (F.col("position") > 0))
              .select("contig", F.floor(F.col("position") / data.block_size).alias("block")).distinct())
    by = ["contig", "block"]
    if data.folder_blocks > 1:
        blocks, by = blocks.withColumn("span", F.floor(F.col("block") / data.folder_blocks)), [*by, "span"]
    return data.calls.join(F.broadcast(blocks) if blocks.count() <= max_broadcast else blocks, by, "left_semi")


def calls_of(calls: DataFrame, samples: DataFrame, max_broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """Calls of the wanted samples. The samples are broadcast when they are counted as few;
    beyond that both sides are shuffled."""
    wanted = samples.select("s").distinct()
    return calls.join(F.broadcast(wanted) if samples.count() <= max_broadcast else wanted, "s", "left_semi")


def score_samples(samples: DataFrame, variants: DataFrame, calls: DataFrame, weights: DataFrame,
                  allele_specific: bool = False, max_broadcast: int = BROADCAST_ROWS,
                  sampled: Callable[[], DataFrame] | None = None) -> DataFrame:
    """``s, total_score, variant_count, normalized_score`` for every sample.

    ``variants`` is one row per (contig, position, alleles); ``calls`` holds the
    stored entries only, with ``alleles`` and ``gt``. Partial sums per sample
    are made before the shuffle, so a sample with very many calls is one row
    per task by then. ``sampled``: see ``with_weights``.
    """
    few = few_weights(weights, max_broadcast)
    place, weight = F.col("_place"), F.col("weight")
    miss = g.missing_dosage(place)
    base = (_placed(with_weights(variants, weights, few=few))
            .agg(F.struct(F.coalesce(F.sum(miss * weight), F.lit(0.0)).alias("total"),
                          F.count("weight").alias("n")).alias("base")).scalar())
    met, gt = _placed_calls(calls, weights, few, sampled)
    delta = g.effect_dosage(gt, place, allele_specific) - miss
    moved = met.groupBy("s").agg(F.sum(delta * weight).alias("delta"))
    return (samples.select("s").join(moved, "s", "left")
            .select("s", (base["total"] + F.coalesce("delta", F.lit(0.0))).alias("total_score"),
                    base["n"].alias("variant_count"))
            .withColumn("normalized_score",
                        F.try_divide("total_score", F.col("variant_count").cast("double"))))
