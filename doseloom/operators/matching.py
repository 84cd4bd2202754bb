"""Weights against a variant list: exact, nearest within a window, or none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EXACT, APPROXIMATE, NONE = "Exact Match", "Approximate Match", "No Match"
_WINDOWS_PER_BLOCK = 20


def exact_positions(weights: DataFrame, variants: DataFrame) -> DataFrame:
    """Distinct (chrom, pos) present in both."""
    return weights.select("chrom", "pos").intersect(variants.select("chrom", "pos"))


def nearest_positions(weights: DataFrame, variants: DataFrame, window: int) -> DataFrame:
    """Distinct weight positions with the nearest variant position in the window.

    An as-of match in both directions, without pairs. Both sides are reduced to
    distinct positions and laid out in blocks of many windows; variant positions
    near a border are copied to the neighbouring block. Inside a block the last
    variant position before and the first one after are carried along in one
    sort each way. A block holds at most its own width in distinct positions.
    On equal distance the lower position is taken.
    """
    width = max(1, window) * _WINDOWS_PER_BLOCK
    asked = (weights.select("chrom", F.col("pos").cast("long").alias("pos"))
             .where(F.col("chrom").isNotNull() & F.col("pos").isNotNull()).distinct()
             .select("chrom", F.floor(F.col("pos") / width).alias("block"), "pos",
                     F.lit(True).alias("asked"), F.lit(None).cast("long").alias("known")))
    listed = (variants.select("chrom", F.col("pos").cast("long").alias("pos"))
              .where(F.col("chrom").isNotNull() & F.col("pos").isNotNull()).distinct()
              .withColumn("block", F.explode(F.sequence(F.floor((F.col("pos") - window) / width),
                                                        F.floor((F.col("pos") + window) / width))))
              .select("chrom", "block", "pos", F.lit(False).alias("asked"),
                      F.col("pos").alias("known")))
    # One row per position and block, so a position on both sides is one row.
    both = (asked.unionByName(listed).groupBy("chrom", "block", "pos")
            .agg(F.max("asked").alias("asked"), F.max("known").alias("known")))
    block = Window.partitionBy("chrom", "block")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    below = F.last("known", ignorenulls=True).over(block.orderBy("pos").rowsBetween(*so_far))
    above = F.last("known", ignorenulls=True).over(block.orderBy(F.desc("pos")).rowsBetween(*so_far))
    near = (both.withColumn("below", below).withColumn("above", above).where("asked")
            .withColumn("down", F.col("pos") - F.col("below"))
            .withColumn("up", F.col("above") - F.col("pos"))
            .withColumn("distance", F.least("down", "up"))
            .where(F.col("distance") <= window))
    return near.select("chrom", "pos",
                       F.when(F.col("distance") == F.col("down"), F.col("below"))
                       .otherwise(F.col("above")).alias("nearest_pos"), "distance")


def match_weights(weights: DataFrame, variants: DataFrame, window: int) -> DataFrame:
    """Every weight row with ``match_type``, ``nearest_pos`` and ``distance``."""
    near = nearest_positions(weights, variants, window)
    kind = (F.when(F.col("distance") == 0, EXACT)
            .when(F.col("distance").isNotNull(), APPROXIMATE).otherwise(NONE))
    return (weights.join(near, ["chrom", "pos"], "left").withColumn("match_type", kind))


def coverage_summary(weights: DataFrame, variants: DataFrame, window: int) -> DataFrame:
    """One row: distinct matched positions, their share of all weight rows, and
    the mean distance over approximate rows (0 when there is none).

    Weight rows are counted per position first, so nothing is joined back.
    """
    near = nearest_positions(weights, variants, window)
    per_position = weights.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("n"))
    counted = per_position.join(near, ["chrom", "pos"], "left")
    exact, approx = F.col("distance") == 0, F.col("distance") > 0
    total = F.sum("n")

    def percent(part):
        return F.coalesce(F.try_divide(part * 100.0, total), F.lit(0.0))

    return counted.agg(
        F.coalesce(total, F.lit(0)).alias("weight_rows"),
        F.count_if(exact).alias("exact_positions"),
        percent(F.count_if(exact)).alias("exact_percent"),
        F.count_if(approx).alias("approximate_positions"),
        percent(F.count_if(approx)).alias("approximate_percent"),
        F.coalesce(F.try_divide(F.sum(F.when(approx, F.col("distance") * F.col("n"))).cast("double"),
                                F.sum(F.when(approx, F.col("n")))), F.lit(0.0)).alias("mean_distance"),
        percent(F.coalesce(F.sum(F.when(exact, F.col("n"))), F.lit(0))).alias("exact_row_percent"),
        percent(F.coalesce(F.sum(F.when(approx, F.col("n"))), F.lit(0))).alias("approximate_row_percent"))


def match_examples(matched: DataFrame, order_by: list[str], limit: int = 5) -> DataFrame:
    """The first rows of each match type by key; the report keeps ``limit``.

    Spark applies the rank limit inside each task before it shuffles, so the
    biggest match type never lands in one task as a whole.
    """
    first = Window.partitionBy("match_type").orderBy(*order_by)
    return matched.withColumn("example", F.row_number().over(first)).where(F.col("example") <= limit)
