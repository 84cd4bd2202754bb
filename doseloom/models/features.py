"""Scaling and per-feature statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseloom.functions.tails import t_p_value


def scaling_facts(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature, from one aggregate row."""
    row = df.agg(*[F.avg(f).alias(f"m_{f}") for f in features],
                 *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    return {f: (row[f"m_{f}"], row[f"s_{f}"]) for f in features}


def scale(df: DataFrame, facts: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / deviation; a constant feature is only centred."""
    return df.withColumns({f: (F.col(f) - F.lit(m)) / F.lit(s if s else 1.0) for f, (m, s) in facts.items()})


def feature_effects(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Per feature: group means and variances, pooled t and Cohen's d.

    All features in one pass over the long form.
    """
    long = df.unpivot([label], list(features), "feature", "value")
    one, zero = F.col(label) == 1, F.col(label) == 0

    def side(name: str, which) -> list:
        x = F.when(which, F.col("value"))
        return [F.count(x).alias(f"n{name}"), F.avg(x).alias(f"mean{name}"), F.var_samp(x).alias(f"var{name}")]

    facts = long.groupBy("feature").agg(*side("1", one), *side("0", zero))
    n1, n0 = F.col("n1"), F.col("n0")
    degrees = (n1 + n0 - 2).cast("double")
    pooled = F.try_divide((n1 - 1) * F.col("var1") + (n0 - 1) * F.col("var0"), degrees)
    gap = F.col("mean1") - F.col("mean0")
    error = F.sqrt(pooled * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n0)))
    return facts.select(
        "feature", "n1", "n0", "mean1", "mean0", "var1", "var0",
        F.try_divide(gap, error).alias("t_stat"), degrees.alias("degrees"),
        F.try_divide(gap, F.sqrt((F.col("var1") + F.col("var0")) / 2)).alias("cohens_d"))


def with_p_values(effects: DataFrame) -> DataFrame:
    """Two-sided p-value per feature row, smallest first."""
    return effects.withColumn("p_value", t_p_value(F.col("t_stat"), F.col("degrees"))) \
        .orderBy("p_value", "feature")
