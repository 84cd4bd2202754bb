"""Order statistics over a whole frame without a one-partition window.

All of them rest on ``running_totals``: rows are first collapsed to one row per
distinct value, distinct values are spread over buckets of similar size by
split points, and the totals before a value are the totals before its bucket
plus a running sum inside the bucket. No task ever sees more than one bucket,
however many rows share a value or a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "_bucket"
_SPLITS = "_splits"


def _levels(df: DataFrame) -> int:
    """Bucket count as a power of two: about four buckets a shuffle task."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, (4 * tasks - 1).bit_length())


def _split_points(groups: DataFrame, value: str, totals: Sequence[str], levels: int) -> Column:
    """Sorted split points over the distinct values, as a one-row subquery.

    They decide only how even the buckets are, never the result: every fourth of a
    hash sample of some four values a bucket, whatever the number of rows.
    """
    count = 2 ** levels
    # The filter holds for every row; it keeps the totals in the plan, so that
    # this branch and the main one share the same shuffled aggregate.
    same_plan = groups.where(sum((F.col(t) for t in totals), F.lit(0)) >= 0)
    rows = same_plan.agg(F.count(F.lit(1)).alias("n")).scalar()
    one_in = F.greatest(F.lit(1), F.floor(rows / (4 * count)))
    sample = same_plan.where(F.pmod(F.xxhash64(value), one_in) == 0).agg(
        F.sort_array(F.collect_set(value)).alias(_SPLITS))
    return sample.select(F.filter(_SPLITS, lambda _, i: i % 4 == 3).alias(_SPLITS)).scalar()


def _bucketed(groups: DataFrame, value: str, totals: Sequence[str]) -> DataFrame:
    """Add the bucket of each value, found by binary search in split points."""
    levels = _levels(groups)
    # One step more than the split points need, in case a sample came out larger.
    steps = F.array(*[F.lit(2 ** k) for k in reversed(range(levels + 1))])
    found = F.aggregate(steps, F.lit(0), lambda low, step: F.when(
        F.get(F.col(_SPLITS), low + step - 1) < F.col(value), low + step).otherwise(low))
    # Never NULL, and declared so: the join on the bucket then adds no null test
    # that would be pushed below the aggregate and run the search on every row.
    return (groups.withColumn(_SPLITS, _split_points(groups, value, totals, levels))
            .withColumn(_BUCKET, F.coalesce(found, F.lit(0))).drop(_SPLITS))


def running_totals(groups: DataFrame, value: str, totals: Sequence[str], by: Sequence[str] = (),
                   descending: bool = False) -> DataFrame:
    """``before_<t>``: the sum of a total over the values ordered earlier, and
    ``all_<t>``: its sum over the whole group.

    ``groups`` has one row per (``by``, ``value``) with non-null keys.
    """
    framed = _bucketed(groups, value, totals)
    by = list(by)

    def order(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    earlier = (Window.unboundedPreceding, -1)
    in_bucket = Window.partitionBy(*by, _BUCKET).orderBy(order(value)).rowsBetween(*earlier)
    # One row per (group, bucket): the one place where a window spans a group.
    over_buckets = Window.partitionBy(*by).orderBy(order(_BUCKET)).rowsBetween(*earlier)
    bucket_totals = framed.groupBy(*by, _BUCKET).agg(*[F.sum(t).alias(t) for t in totals])
    offsets = bucket_totals.select(
        *by, _BUCKET,
        *[F.coalesce(F.sum(t).over(over_buckets), F.lit(0)).alias(f"_offset_{t}") for t in totals],
        *[F.sum(t).over(Window.partitionBy(*by)).alias(f"all_{t}") for t in totals])
    if not by:
        offsets = F.broadcast(offsets)  # some buckets for each shuffle task
    inside = framed.select(
        "*", *[F.coalesce(F.sum(t).over(in_bucket), F.lit(0)).alias(f"_inside_{t}") for t in totals])
    return inside.join(offsets, [*by, _BUCKET]).select(
        *groups.columns,
        *[(F.col(f"_offset_{t}") + F.col(f"_inside_{t}")).alias(f"before_{t}") for t in totals],
        *[f"all_{t}" for t in totals])


def present(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows whose value is neither NULL nor NaN and whose group is known."""
    keep = F.col(value).isNotNull()
    if dict(df.dtypes)[value] in ("double", "float"):
        keep = keep & ~F.isnan(value)
    for column in by:
        keep = keep & F.col(column).isNotNull()
    return df.where(keep)


def distinct_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct present value, with its count ``n``."""
    return present(df, value, by).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their rank, ties sharing the average rank."""
    return running_totals(distinct_counts(df, value, by), value, ["n"], by).select(
        *by, value, "n", "all_n", (F.col("before_n") + (F.col("n") + 1) / 2.0).alias("avg_rank"))


def percentile_ranks(df: DataFrame, value: str, into: str = "percentile") -> DataFrame:
    """Every row with 100 x average rank / count; rows without a value keep NULL."""
    ranks = average_ranks(df, value).select(
        value, (F.col("avg_rank") / F.col("all_n") * 100.0).alias(into))
    return df.join(ranks, value, "left")


def z_scores(df: DataFrame, value: str, into: str = "zscore") -> DataFrame:
    """(value - mean) / sample deviation; NULL when the deviation is zero."""
    moments = present(df, value).agg(
        F.struct(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).alias("m")).scalar()
    return df.withColumn(into, F.try_divide(F.col(value) - moments["mean"], moments["sd"]))


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles: an array column ``quantiles``."""
    by = list(by)
    totals = running_totals(distinct_counts(df, value, by), value, ["n"], by)

    def at(index: Column) -> Column:
        holds = (F.col("before_n") <= index) & (index < F.col("before_n") + F.col("n"))
        return F.max(F.when(holds, F.col(value).cast("double")))

    picks, edges = [], []
    for i, p in enumerate(probs):
        place = (F.col("all_n") - 1) * F.lit(float(p))
        picks += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}"),
                  F.max(place - F.floor(place)).alias(f"_part{i}")]
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        edges.append(low + (high - low) * F.col(f"_part{i}"))
    return totals.groupBy(*by).agg(*picks).select(*by, F.array(*edges).alias("quantiles"))


def quantile_edges(df: DataFrame, value: str, bins: int) -> DataFrame:
    return quantiles(df, value, [i / bins for i in range(bins + 1)])


def quantile_cut(df: DataFrame, value: str, bins: int, into: str = "bin",
                 labels: Sequence[str] | None = None, label_into: str = "label") -> DataFrame:
    """Right-closed quantile bins 1..bins, the lowest value in bin 1.

    Equal edges raise, since a bin would be empty by construction. Rows without
    a value keep a NULL bin.
    """
    edges = quantile_edges(df, value, bins).scalar()
    out = df.withColumn("_edges", edges)
    distinct = F.size(F.array_distinct("_edges")) == bins + 1
    number = F.when(F.isnull(value), None).when(
        ~distinct, F.raise_error(F.lit(f"quantile edges of {value} are not unique")).cast("int"))
    for i in range(1, bins + 1):
        number = number.when(F.col(value) <= F.get("_edges", F.lit(i)), i)
    out = out.withColumn(into, number).drop("_edges")
    if labels is not None:
        out = out.withColumn(label_into, F.get(F.array(*map(F.lit, labels)), F.col(into) - 1))
    return out


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std (n-1), min, 25 %, 50 %, 75 %, max with exact quartiles."""
    by = list(by)
    basic = present(df, value, by).groupBy(*by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"))
    cuts = quantiles(df, value, [0.25, 0.5, 0.75], by)
    if by:
        both = basic.join(cuts, by)
    else:
        both = basic.withColumn("quantiles", cuts.scalar())
    return both.select(*by, "count", "mean", "std", "min",
                       F.get("quantiles", F.lit(0)).alias("p25"),
                       F.get("quantiles", F.lit(1)).alias("p50"),
                       F.get("quantiles", F.lit(2)).alias("p75"), "max")


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per distinct value, most frequent first, then by key."""
    return (df.groupBy(*columns).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), *columns))


def percentile_tails(df: DataFrame, value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Rows at or beyond the two percentiles, with a flag for each tail.

    Heavy ties can put a row in both tails, so the flags are separate.
    """
    cuts = quantiles(df, value, [low, high]).scalar()
    flagged = df.withColumn("_cuts", cuts)
    return (flagged.withColumn("in_bottom", F.col(value) <= F.get("_cuts", F.lit(0)))
            .withColumn("in_top", F.col(value) >= F.get("_cuts", F.lit(1)))
            .drop("_cuts").where(F.col("in_bottom") | F.col("in_top")))


def hash_order(df: DataFrame, id_columns: Sequence[str], by: Sequence[str], seed: int,
               into: str = "ordinal", size_into: str = "group_size") -> DataFrame:
    """Exact shuffled position (from 1) of every row inside its group.

    The order is that of a seeded hash (the first 60 bits of md5 of seed and ids, joined by ``:``), so it is repeatable on any
    cluster, in any engine and after lost tasks. ``id_columns`` must identify a row: then hash values are
    spread evenly, and plain ranges of the hash are even buckets, also inside a
    group that holds most rows. The rows are shuffled once.
    """
    keys = [*by, _BUCKET]
    levels = _levels(df)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_columns]).cast("binary"))
    hashed = df.withColumn("_hash", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")) \
        .withColumn(_BUCKET, F.shiftright("_hash", 60 - levels).cast("int")).repartition(*keys)
    counts = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
                            F.sum("_n").over(Window.partitionBy(*by)).alias(size_into))
    inside = Window.partitionBy(*keys).orderBy("_hash", *id_columns)
    return (hashed.withColumn("_in_bucket", F.row_number().over(inside)).join(offsets, keys)
            .withColumn(into, F.col("_offset") + F.col("_in_bucket"))
            .drop("_hash", _BUCKET, "_in_bucket", "_offset"))


def number_keys(df: DataFrame, key: str, into: str) -> DataFrame:
    """Distinct non-null keys with a dense number from 0 in key order."""
    distinct = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.lit(1).alias("n"))
    return running_totals(distinct, key, ["n"]).select(key, F.col("before_n").cast("long").alias(into))
