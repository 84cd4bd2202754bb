"""The numbers behind each chart."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseloom.operators import association, ranking


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between the extremes, empty ones too; the last one is closed.

    ``bin, left_edge, right_edge, count``; no rows without values.
    """
    kept = ranking.present(df, value).select(value)
    extremes = kept.agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))
    span = extremes.select(F.struct("low", "high").alias("s")).scalar()
    spanned = kept.withColumn("_s", span)
    low, high = F.col("_s.low"), F.col("_s.high")
    width = (high - low) / bins
    guess = F.least(F.floor(F.coalesce(F.try_divide((F.col(value) - low) * bins, high - low), F.lit(0.0))),
                    F.lit(bins - 1)).cast("int")
    # The edges decide: a value on one may be a bit off after the division.
    number = (F.when(F.col(value) < low + guess * width, guess - 1)
              .when((F.col(value) >= low + (guess + 1) * width) & (guess < bins - 1) & (width > 0), guess + 1)
              .otherwise(guess))
    counts = spanned.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    step = (F.col("high") - F.col("low")) / bins
    grid = extremes.where("low is not null").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return (grid.join(counts, "bin", "left")
            .select("bin", (F.col("low") + F.col("bin") * step).alias("left_edge"),
                    (F.col("low") + (F.col("bin") + 1) * step).alias("right_edge"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("count")))


def box_stats(df: DataFrame, value: str, group: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers inside ``reach`` x IQR and outlier count per group."""
    cuts = ranking.quantiles(df, value, [0.25, 0.5, 0.75], [group]).select(
        group, *[F.get("quantiles", F.lit(i)).alias(f"q{i + 1}") for i in range(3)])
    spread = reach * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - spread, F.col("q3") + spread)
    # Distinct values with their counts meet the quartiles, not the rows.
    return (ranking.distinct_counts(df, value, [group]).join(cuts, group).groupBy(group, "q1", "q2", "q3")
            .agg(F.min(F.when(inside, F.col(value))).cast("double").alias("whisker_low"),
                 F.max(F.when(inside, F.col(value))).cast("double").alias("whisker_high"),
                 F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
                 F.sum("n").alias("count")))


def density(df: DataFrame, value: str, grid: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density on an even grid, Scott bandwidth, exact sum.

    A task adds up the kernels of its distinct values in one array of ``grid`` numbers and returns that array; the
    arrays are added element by element. Values that do not differ have no density: no rows.
    """
    kept = ranking.present(df, value)
    facts = kept.agg(
        F.count(F.lit(1)).alias("n"), F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"),
        (F.stddev_samp(value) * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))).alias("h")).where("h > 0") \
        .select("n", "h", (F.col("low") - cut * F.col("h")).alias("low"),
                ((F.col("high") - F.col("low") + 2 * cut * F.col("h")) / (grid - 1)).alias("step"))
    one = facts.agg(F.first(F.struct("n", "h", "low", "step"))).scalar()
    counts = kept.groupBy(F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = counts.withColumn("f", one).where("f is not null").select("value", "n", "f.h", "f.low", "f.step")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(grid)
        for batch in batches:
            x, n, h, low, step = (c.to_numpy() for c in batch.columns)
            for a in range(0, len(x), 1024):
                at = low[0] + np.arange(grid) * step[0]
                distance = (at[None, :] - x[a:a + 1024, None]) / h[0]
                total += n[a:a + 1024] @ np.exp(-0.5 * distance * distance)
        yield pa.RecordBatch.from_pydict({"kernels": [total.tolist()]})

    parts = rows.mapInArrow(summed, "kernels array<double>").select(F.posexplode("kernels").alias("point", "part"))
    scale = F.col("f.n") * F.col("f.h") * F.sqrt(F.lit(2.0) * F.pi())
    return (parts.groupBy("point").agg(F.sum("part").alias("total")).withColumn("f", one).where("f is not null")
            .select("point", (F.col("f.low") + F.col("point") * F.col("f.step")).alias("x"), (F.col("total") / scale).alias("density")))


def score_percentile_points(scores: DataFrame, id_column: str, value: str) -> DataFrame:
    """z-score against percentile for every row."""
    z = ranking.z_scores(scores, value, "zscore")
    return ranking.percentile_ranks(z, value, "percentile").select(id_column, "zscore", "percentile")


def prevalence_bars(merged: DataFrame, score: str, status: str,
                    bins: int = 10, labels: Sequence[str] = association.DECILE_LABELS) -> DataFrame:
    """Prevalence per bin in percent, with the bar's text."""
    return association.prevalence_by_bin(merged, score, status, bins, labels, percent=True) \
        .withColumn("bar_label", F.format_string("%.2f%%", "prevalence"))
