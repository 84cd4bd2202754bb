"""Scores against a phenotype: prevalence by bin, totals, tails, odds ratio."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseloom.operators import ranking

DECILE_LABELS: Sequence[str] = [f"D{i}" for i in range(1, 11)]
QUINTILE_LABELS: Sequence[str] = [f"Q{i}" for i in range(1, 6)]


def merge_phenotype(scores: DataFrame, phenotype: DataFrame, status: str = "status",
                    keep_unrecorded: bool = False) -> DataFrame:
    """Scores with a phenotype. Persons without any condition record drop out,
    unless ``keep_unrecorded`` counts them as non-cases."""
    if not keep_unrecorded:
        return scores.join(phenotype, "s")
    return scores.join(phenotype, "s", "left").withColumn(status, F.coalesce(status, F.lit(0)))


def prevalence_by_bin(merged: DataFrame, score: str, status: str, bins: int,
                      labels: Sequence[str], percent: bool = False) -> DataFrame:
    """Count and mean status per quantile bin of the score."""
    cut = ranking.quantile_cut(merged, score, bins, "bin", labels, "label")
    scale = 100.0 if percent else 1.0
    return cut.groupBy("bin", "label").agg(
        F.count(status).alias("count"), (F.avg(status) * scale).alias("prevalence"))


def cohort_totals(merged: DataFrame, status: str) -> DataFrame:
    return merged.agg(F.count(F.lit(1)).alias("participants"),
                      F.coalesce(F.sum(status), F.lit(0)).alias("cases"),
                      (F.avg(status) * 100.0).alias("prevalence_percent"))


def _tail(name: str, inside: Column, status: str) -> list[Column]:
    return [F.count_if(inside).alias(f"{name}_count"),
            F.coalesce(F.sum(F.when(inside, F.col(status))), F.lit(0)).alias(f"{name}_cases"),
            (F.avg(F.when(inside, F.col(status))) * 100.0).alias(f"{name}_prevalence")]


def tail_odds_ratio(merged: DataFrame, score: str, status: str,
                    low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Both tails (inclusive thresholds) in one row, with their odds ratio.

    The ratio is NULL when a tail has no cases or only cases.
    """
    tails = ranking.percentile_tails(merged, score, low, high)
    row = tails.agg(*_tail("bottom", F.col("in_bottom"), status), *_tail("top", F.col("in_top"), status))

    def odds(name: str) -> Column:
        cases = F.col(f"{name}_cases").cast("double")
        return F.try_divide(cases, F.col(f"{name}_count") - cases)

    return (row.withColumn("top_odds", odds("top")).withColumn("bottom_odds", odds("bottom"))
            .withColumn("odds_ratio", F.try_divide("top_odds", "bottom_odds")))


def tail_groups(merged: DataFrame, score: str, status: str,
                low: float = 0.05, high: float = 0.95) -> DataFrame:
    """The two tails as rows, with the case label of each."""
    row = tail_odds_ratio(merged, score, status, low, high)
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(label).alias("group_label"), F.col(f"{name}_count").alias("count"),
                 F.col(f"{name}_cases").alias("cases"), F.col(f"{name}_prevalence").alias("prevalence"))
        for name, label in (("bottom", "Bottom 5%"), ("top", "Top 5%"))]))) \
        .withColumn("case_label", F.concat(F.lit("Cases="), F.col("cases").cast("string")))
