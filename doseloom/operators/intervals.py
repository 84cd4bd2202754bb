"""Position filters: region literals, point intervals and wide intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doseloom.functions.text import parse_region

BLOCK = 1_000_000


def in_region(region: str, end_inclusive: bool, contig: str = "contig", position: str = "position") -> Column:
    """Predicate for ``contig:start-end``; three literals, pushed to Parquet."""
    name, start, end = parse_region(region)
    last = end if end_inclusive else end - 1
    return (F.col(contig) == name) & (F.col(position) >= start) & (F.col(position) <= last)


def point_intervals(weights: DataFrame) -> DataFrame:
    """One closed interval per weight, start = end = position."""
    return weights.select("contig", F.col("position").alias("start"), F.col("position").alias("end"))


def valid_intervals(intervals: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """Skip intervals with a missing part, start after end, or an unknown contig."""
    kept = intervals.where(F.col("contig").isNotNull() & F.col("start").isNotNull()
                           & F.col("end").isNotNull() & (F.col("start") <= F.col("end")))
    return kept if contigs is None else kept.join(contigs.select("contig"), "contig", "left_semi")


def at_points(variants: DataFrame, intervals: DataFrame) -> DataFrame:
    """Variants at point intervals: a semi join on (contig, position)."""
    points = intervals.select("contig", F.col("start").alias("position"))
    return variants.join(points, ["contig", "position"], "left_semi")


def covered_positions(positions: DataFrame, intervals: DataFrame, end_inclusive: bool = True,
                      block: int = BLOCK) -> DataFrame:
    """Distinct (contig, position) that lie in any interval.

    A sweep instead of a range join: intervals are cut at block borders and
    become +1 / -1 steps, positions become steps of 0, and a running sum inside
    the block says how many intervals are open. Steps are added up per position
    first, so overlapping or repeated intervals never multiply rows, and a
    block holds at most ``block`` positions.
    """
    last = F.col("end") if end_inclusive else F.col("end") - 1
    cut = (intervals.select("contig", F.col("start").cast("long").alias("start"),
                            last.cast("long").alias("last"))
           .where(F.col("start") <= F.col("last")).distinct()
           .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block),
                                                     F.floor(F.col("last") / block)))))
    opened = cut.select("contig", "block",
                        F.greatest("start", F.col("block") * block).alias("at"),
                        F.lit(1).alias("step"), F.lit(0).alias("asked"))
    closed = (cut.where(F.floor((F.col("last") + 1) / block) == F.col("block"))
              .select("contig", "block", (F.col("last") + 1).alias("at"),
                      F.lit(-1).alias("step"), F.lit(0).alias("asked")))
    asked = (positions.select("contig", F.col("position").cast("long").alias("at")).distinct()
             .select("contig", F.floor(F.col("at") / block).alias("block"), "at",
                     F.lit(0).alias("step"), F.lit(1).alias("asked")))
    steps = (opened.unionByName(closed).unionByName(asked)
             .groupBy("contig", "block", "at")
             .agg(F.sum("step").alias("step"), F.max("asked").alias("asked")))
    sweep = Window.partitionBy("contig", "block").orderBy("at") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (steps.withColumn("open", F.sum("step").over(sweep))
            .where((F.col("asked") == 1) & (F.col("open") > 0))
            .select("contig", F.col("at").cast("int").alias("position")))


def in_intervals(variants: DataFrame, intervals: DataFrame, end_inclusive: bool = True,
                 block: int = BLOCK) -> DataFrame:
    """Variants inside any interval, each kept once."""
    inside = covered_positions(variants, intervals, end_inclusive, block)
    return variants.join(inside, ["contig", "position"], "left_semi")
