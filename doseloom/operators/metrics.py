"""Exact binary-classification curves and metrics.

Each distinct score is one row with its cases and controls; the running sums
over descending scores come from ``ranking.running_totals``, so curves over any
number of rows need no global sort in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseloom.operators import ranking


def _ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 when undefined."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def _cumulative(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """Per threshold: tp and fp among scores at or above it, and the totals."""
    by = list(by)
    one = F.col(label) == 1
    counts = (ranking.present(df, score, by).where(F.col(label).isNotNull())
              .groupBy(*by, F.col(score).cast("double").alias("threshold"))
              .agg(F.count_if(one).alias("pos"), F.count_if(~one).alias("neg")))
    run = ranking.running_totals(counts, "threshold", ["pos", "neg"], by, descending=True)
    return (run.withColumn("tp", F.col("before_pos") + F.col("pos"))
            .withColumn("fp", F.col("before_neg") + F.col("neg")))


def _with_start(run: DataFrame, by: Sequence[str], point: dict[str, Column], start: dict[str, float]) -> DataFrame:
    """One row per threshold, and the curve's start beside the highest one."""
    def row(values: dict[str, Column]) -> Column:
        return F.struct(*[v.cast("double").alias(c) for c, v in values.items()])

    first = F.col("before_pos") + F.col("before_neg") == 0
    own, edge = row(point), row({c: F.lit(v) for c, v in start.items()})
    return run.select(*by, F.inline(F.when(first, F.array(edge, own)).otherwise(F.array(own))))


def roc_points(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``threshold, fpr, tpr`` per distinct score, from the highest down.

    The curve starts at (0, 0) under an infinite threshold; collinear points are kept.
    """
    return _with_start(_cumulative(df, label, score, by), by, {
        "threshold": F.col("threshold"), "fpr": F.try_divide(F.col("fp").cast("double"), F.col("all_neg")),
        "tpr": F.try_divide(F.col("tp").cast("double"), F.col("all_pos"))},
        {"threshold": float("inf"), "fpr": 0.0, "tpr": 0.0})


def precision_recall_points(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``threshold, precision, recall`` per distinct score, and the end: recall 0 at precision 1
    under an infinite threshold."""
    return _with_start(_cumulative(df, label, score, by), by, {
        "threshold": F.col("threshold"), "precision": F.col("tp").cast("double") / (F.col("tp") + F.col("fp")),
        "recall": F.try_divide(F.col("tp").cast("double"), F.col("all_pos"))},
        {"threshold": float("inf"), "precision": 1.0, "recall": 0.0})


def ranking_metrics(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``roc_auc`` (ties count half), ``average_precision`` (step sum) and counts.

    The area is taken over pairs: cases above a control, ties half.
    """
    run = _cumulative(df, label, score, by)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    pairs = F.sum(neg * (F.col("before_pos") + pos / 2.0))
    steps = F.sum(pos * F.col("tp") / (F.col("tp") + F.col("fp")))
    return run.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
        F.try_divide(pairs, F.sum(pos) * F.sum(neg)).alias("roc_auc"),
        F.try_divide(steps, F.sum(pos)).alias("average_precision"))


def youden_threshold(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Threshold with the largest tpr - fpr; the highest one wins ties.

    Compared as tp * negatives - fp * positives, a whole number, so that equal
    points are equal. When no point is above 0 the curve's start wins: no
    threshold is low enough, and the value is infinite.
    """
    run = _cumulative(df, label, score, by)
    gain = F.col("tp") * F.col("all_neg") - F.col("fp") * F.col("all_pos")
    best = run.withColumn("gain", gain.cast("double")).groupBy(*by).agg(
        F.max(F.struct("gain", "threshold", "tp", "fp", "all_pos", "all_neg")).alias("b"))
    start = F.col("b.gain") <= 0
    return best.select(
        *by, F.when(start, F.lit(float("inf"))).otherwise(F.col("b.threshold")).alias("threshold"),
        F.when(start, 0.0).otherwise(F.try_divide(F.col("b.tp").cast("double"), F.col("b.all_pos"))).alias("tpr"),
        F.when(start, 0.0).otherwise(F.try_divide(F.col("b.fp").cast("double"), F.col("b.all_neg"))).alias("fpr"))


def label_above(df: DataFrame, score: str, threshold: Column | float, into: str = "called") -> DataFrame:
    """1 at or above the threshold, else 0."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return df.withColumn("_cut", cut).withColumn(
        into, F.when(F.col(score) >= F.col("_cut"), 1).otherwise(0)).drop("_cut")


def confusion(df: DataFrame, label: str, called: str, by: Sequence[str] = ()) -> DataFrame:
    """``tn, fp, fn, tp`` in one pass."""
    y, p = F.col(label) == 1, F.col(called) == 1
    return df.groupBy(*by).agg(
        F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(y & p).alias("tp"))


def threshold_metrics(df: DataFrame, label: str, called: str, by: Sequence[str] = ()) -> DataFrame:
    """Metrics of hard calls; undefined ones are 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    recall, specificity = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    return confusion(df, label, called, by).select(
        *by, "tn", "fp", "fn", "tp",
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        recall.alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((recall + specificity) / 2).alias("balanced_accuracy"),
        specificity.alias("specificity"),
        _ratio(tp, tp + fp).alias("ppv"),
        _ratio(tn, tn + fn).alias("npv"))


def class_report(df: DataFrame, label: str, called: str, by: Sequence[str] = (),
                 names: Sequence[str] = ("0", "1")) -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy, macro and
    weighted rows, all from the four counts."""
    by = list(by)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    total = (tn + fp + fn + tp)
    zero = (_ratio(tn, tn + fn), _ratio(tn, tn + fp), _ratio(2 * tn, 2 * tn + fp + fn), tn + fp)
    one = (_ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(2 * tp, 2 * tp + fp + fn), tp + fn)
    accuracy = _ratio(tp + tn, total)

    def row(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
                        f1.alias("f1"), support.cast("long").alias("support"))

    macro = [(a + b) / 2 for a, b in zip(zero[:3], one[:3])]
    weighted = [_ratio(a * zero[3] + b * one[3], total) for a, b in zip(zero[:3], one[:3])]
    rows = F.array(row(names[0], *zero), row(names[1], *one),
                   row("accuracy", accuracy, accuracy, accuracy, total),
                   row("macro avg", *macro, total), row("weighted avg", *weighted, total))
    return confusion(df, label, called, by).select(*by, F.inline(rows))
