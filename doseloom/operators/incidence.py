"""Participant-by-node incidence from alignment records.

The long table of distinct (name, node_id) pairs is the result; lists and wide
matrices are made from it only at a sink, in bounded pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseloom.operators import ranking

BLOCK_COLUMNS = 5_000  # columns of one block of a wide matrix


def node_pairs(records: DataFrame) -> DataFrame:
    """Distinct (name, node_id) of records with a name, a path and node ids."""
    named = records.where(F.col("name").isNotNull() & (F.col("name") != ""))
    return (named.select("name", F.explode("path.mapping.position.node_id").alias("node_id"))
            .where(F.col("node_id").isNotNull()).distinct())


def names_with_mapping(records: DataFrame) -> DataFrame:
    """Names that have any mapping, also those whose mapping holds no node id."""
    return records.where(F.col("name").isNotNull() & (F.col("name") != "")
                         & (F.size("path.mapping") > 0)).select("name").distinct()


def node_lists(pairs: DataFrame, piece: int = 10_000) -> DataFrame:
    """Sorted node lists per name, in pieces of at most ``piece`` nodes.

    The place of a node inside its name comes from a distributed order, so a
    name with very many nodes is several rows and never one huge value.
    """
    counts = pairs.groupBy("name", "node_id").agg(F.lit(1).alias("n"))
    placed = ranking.running_totals(counts, "node_id", ["n"], ["name"])
    return (placed.withColumn("part", F.floor(F.col("before_n") / piece).cast("int"))
            .groupBy("name", "part").agg(F.sort_array(F.collect_list("node_id")).alias("nodes")))


def matrix_axes(pairs: DataFrame, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Numbered rows (names) and columns (nodes), both in string order."""
    rows = ranking.number_keys(names if names is not None else pairs, "name", "row_id")
    return rows, ranking.number_keys(pairs, "node_id", "col_id")


def sparse_matrix(pairs: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """The ones of the matrix as (row_id, col_id)."""
    return (pairs.select("name", "node_id").distinct().join(rows, "name").join(columns, "node_id")
            .select("row_id", "col_id"))


def _numbered(pairs: DataFrame, width: int) -> DataFrame:
    columns = ranking.number_keys(pairs, "node_id", "col_id")
    return columns.select("node_id", F.floor(F.col("col_id") / width).cast("int").alias("block"),
                          (F.col("col_id") % width).cast("int").alias("place"))


def matrix_columns(pairs: DataFrame, width: int = BLOCK_COLUMNS) -> DataFrame:
    """``block, nodes``: the nodes of each block of columns, in string order."""
    return (_numbered(pairs, width).groupBy("block")
            .agg(F.sort_array(F.collect_list(F.struct("place", "node_id"))).alias("n"))
            .select("block", F.col("n.node_id").alias("nodes")))


def matrix_blocks(pairs: DataFrame, names: DataFrame | None = None, width: int = BLOCK_COLUMNS) -> DataFrame:
    """The 0/1 matrix as ``name, block, cells``: one row per name and block of columns.

    Any number of nodes: a row holds ``width`` cells at most, and no list of nodes
    leaves the executors.
    """
    columns = _numbered(pairs, width)
    widths = columns.groupBy("block").agg(F.count(F.lit(1)).cast("int").alias("width"))
    ones = (pairs.select("name", "node_id").distinct().join(columns, "node_id")
            .groupBy("name", "block").agg(F.collect_list("place").alias("on")))
    last = widths.agg(F.max("block")).scalar()
    rows = (names if names is not None else pairs).select("name").distinct() \
        .withColumn("block", F.explode(F.sequence(F.lit(0), last)))
    on = F.map_from_arrays("on", F.array_repeat(F.lit(1), F.size("on")))
    cells = F.transform(F.sequence(F.lit(0), F.col("width") - 1),
                        lambda i: F.coalesce(F.when(F.col("on").isNotNull(), F.try_element_at(on, i)), F.lit(0)))
    return (rows.join(widths, "block").join(ones, ["name", "block"], "left")
            .select("name", "block", cells.alias("cells")))


def block_row_homogeneity(blocks: DataFrame) -> DataFrame:
    """Ones, zeros and the distinct values of each name's row, over its blocks."""
    ones = F.size(F.filter("cells", lambda v: v == 1))
    out = blocks.groupBy("name").agg(F.sum(ones).alias("ones"), F.sum(F.size("cells") - ones).alias("zeros"))
    values = F.filter(F.array(F.when(F.col("zeros") > 0, 0), F.when(F.col("ones") > 0, 1)), lambda v: v.isNotNull())
    return out.withColumn("row_values", values).withColumn("mixed", F.size("row_values") > 1)


def row_homogeneity(pairs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Zeros and ones of each name's matrix row, and whether it holds both.

    Zeros are counted as columns minus ones, so the matrix is never built.
    """
    width = pairs.agg(F.count_distinct("node_id").alias("n")).scalar()
    ones = pairs.groupBy("name").agg(F.count_distinct("node_id").alias("ones"))
    if names is not None:
        ones = names.select("name").distinct().join(ones, "name", "left") \
            .withColumn("ones", F.coalesce("ones", F.lit(0)))
    return (ones.withColumn("zeros", width - F.col("ones"))
            .withColumn("mixed", (F.col("ones") > 0) & (F.col("zeros") > 0)))


def wide_row_homogeneity(matrix: DataFrame, participant: str = "participant") -> DataFrame:
    """The same check on a wide matrix that was read back."""
    cells = F.array(*[F.col(f"`{c}`") for c in matrix.columns if c != participant])
    return matrix.select(
        F.col(participant).alias("name"),
        F.size(F.filter(cells, lambda v: v == 1)).alias("ones"),
        F.size(F.filter(cells, lambda v: v == 0)).alias("zeros"),
        F.sort_array(F.array_distinct(cells)).alias("row_values")) \
        .withColumn("mixed", F.size("row_values") > 1)


def distinct_cells(pairs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Distinct values over all cells, from counts: a matrix with fewer ones than cells has a 0."""
    ones = pairs.agg(F.count_distinct("name", "node_id").alias("ones"), F.count_distinct("node_id").alias("width"))
    size = (names if names is not None else pairs).agg(F.count_distinct("name").alias("n")).scalar()
    cells = ones.withColumn("cells", size * F.col("width"))
    values = F.array(F.when(F.col("cells") > F.col("ones"), 0), F.when(F.col("ones") > 0, 1))
    return cells.select(F.explode(F.filter(values, lambda v: v.isNotNull())).alias("value"))


def column_types(matrix: DataFrame, participant: str = "participant") -> dict[str, int]:
    """How many columns there are of each type; read from the schema."""
    counts: dict[str, int] = {}
    for name, kind in matrix.dtypes:
        if name != participant:
            counts[kind] = counts.get(kind, 0) + 1
    return counts


def node_summary(pairs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """count, mean, std and quartiles of each 0/1 column, from its ones alone.

    The share of ones decides the quartiles: with ``n - ones`` zeros first, the
    interpolated value at place p (n - 1) is 0, 1 or the part in between.
    """
    size = (names if names is not None else pairs).agg(F.count_distinct("name").alias("n")).scalar()
    ones = (pairs.groupBy("node_id").agg(F.count_distinct("name").alias("ones"))
            .withColumn("count", size))
    mean = F.col("ones") / F.col("count")
    zeros = F.col("count") - F.col("ones")

    def at(p: float):
        place = (F.col("count") - 1) * F.lit(p)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), place - zeros + 1))

    deviation = F.sqrt(F.try_divide(F.col("count") * mean * (1 - mean), F.col("count") - 1))
    return ones.select("node_id", "count", mean.alias("mean"), deviation.alias("std"),
                       F.when(zeros > 0, 0.0).otherwise(1.0).alias("min"),
                       at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"),
                       F.when(F.col("ones") > 0, 1.0).otherwise(0.0).alias("max"))
