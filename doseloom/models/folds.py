"""Stratified splits with exact class sizes and no task that holds a class."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doseloom.operators.ranking import hash_order


def class_test_sizes(df: DataFrame, label: str, test_fraction: float) -> DataFrame:
    """Test rows per class: ceil(fraction x rows) shared by largest remainder."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    # Rounded, so that equal remainders are equal and whole shares are whole.
    want = F.round(F.col("n") * F.lit(test_fraction), 9)
    # One row per class, so these windows are over a handful of rows.
    everything = Window.partitionBy(F.lit(0))
    by_rest = everything.orderBy(F.desc(F.round(want - F.floor(want), 9)), label)
    total = F.round(F.sum("n").over(everything) * F.lit(test_fraction), 9)
    spare = F.ceil(total) - F.sum(F.floor(want)).over(everything)
    return counts.select(label, (F.floor(want) + (F.row_number().over(by_rest) <= spare).cast("int"))
                         .alias("n_test"))


def stratified_split(df: DataFrame, id_column: str, label: str, test_fraction: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Add ``is_test``; class shares are kept, sizes are exact, reruns agree."""
    placed = hash_order(df, [id_column], [label], seed, "_place", "_class_size")
    sizes = F.broadcast(class_test_sizes(df, label, test_fraction))  # one row a class
    return (placed.join(sizes, label).withColumn("is_test", F.col("_place") <= F.col("n_test"))
            .select(*df.columns, "is_test"))


def stratified_folds(df: DataFrame, id_column: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` (0..folds-1): each class dealt out in shuffled order."""
    placed = hash_order(df, [id_column], [label], seed, "_place", "_class_size")
    return placed.select(*df.columns, ((F.col("_place") - 1) % folds).cast("int").alias("fold"))
