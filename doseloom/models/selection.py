"""Grid search and cross-validation with exact scorers.

Folds are a column of a saved table, written by fold. Logistic candidates are fitted together by Newton steps
(``newton``), boosted ones together as well (``boosting``), and forests on many rows (``forests``). Other models are fitted one by one in a pool over folds and
candidates: each fit reads its training folders only, scores its validation folder and writes these rows on their own. All
scores come from one aggregate. Candidates that differ only in the number of trees share one fit of the most trees: a smaller
one is its first trees.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseloom.models import boosting, classifiers, forests, newton
from doseloom.models.features import scale, scaling_facts
from doseloom.models.folds import stratified_folds
from doseloom.operators import metrics
from doseloom.plans.storage import new_folder

Fit = Callable[..., Any]
_PART_BYTES = 64 << 20

# The parameter grids.
LOGISTIC_GRID = {"class_weight": ["balanced", {0: 1, 1: 5}, {0: 1, 1: 10}, {0: 1, 1: 15}],
                 "C": [0.001, 0.01, 0.1, 1.0, 10.0]}
FOREST_GRID = {"n_estimators": [100, 300], "max_depth": [None, 10], "min_samples_split": [2, 5]}
BOOSTING_GRID = {"n_estimators": [100, 300], "learning_rate": [0.05, 0.1], "max_depth": [3, 5]}
BOOSTED_TREE_GRID = {"max_depth": [3, 4, 5], "min_child_weight": [1, 3, 5]}
BOOSTED_TREE_ROUNDS = 200
BOOSTED_TREE_REST = {"learning_rate": 0.3, "newton": True}  # cuts weighed by Hessians, the rate left as it is
# End of fixed values.


def candidates(grid: Mapping[str, Sequence[Any]]) -> list[dict[str, Any]]:
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def _shared_fits(fit: Fit, grid: Sequence[Mapping[str, Any]]) -> tuple[list[dict[str, Any]], list[int]]:
    """The parameters to fit, and which of these each candidate uses."""
    fits, which = [], []
    for params in grid:
        if fit not in (classifiers.fit_forest, classifiers.fit_boosted, boosting.fit_boosted) or "n_estimators" not in params:
            fits.append(dict(params))
            which.append(len(fits) - 1)
            continue
        rest = {k: v for k, v in params.items() if k != "n_estimators"}
        same = [i for i, p in enumerate(fits) if "n_estimators" in p and {k: v for k, v in p.items() if k != "n_estimators"} == rest]
        if same:
            fits[same[0]]["n_estimators"] = max(fits[same[0]]["n_estimators"], params["n_estimators"])
        else:
            fits.append(dict(params))
        which.append(same[0] if same else len(fits) - 1)
    return fits, which


def save_folds(df: DataFrame, id_column: str, label: str, folds: int, seed: int = 42) -> DataFrame:
    """Assign folds and keep the frame as a table in the shared folder, by fold."""
    spark = df.sparkSession
    uri = new_folder(spark, "folds")
    stratified_folds(df, id_column, label, folds, seed).write.partitionBy("fold").parquet(uri)
    return spark.read.parquet(uri)


def _run_all(tasks: Sequence[Callable[[], Any]], session, parallelism: int) -> list[Any]:
    """Submit Spark jobs from a few threads; the cluster shares them out."""
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        futures = [pool.submit(inheritable_thread_target(session)(task)) for task in tasks]
        return [f.result() for f in futures]


def _table_parts(df: DataFrame, features: Sequence[str]) -> int:
    """Partitions for a table's features, by counted bytes: a fit of few rows is one task per step."""
    return max(1, math.ceil(df.count() * (len(features) + 2) * 8 / _PART_BYTES))


def out_of_fold(folded: DataFrame, folds: int, fit: Fit, grid: Sequence[Mapping[str, Any]],
                features: Sequence[str], label: str, id_column: str, parallelism: int = 8,
                scale_inside: bool = True) -> DataFrame:
    """``candidate, fold, id, label, probability`` for every candidate and row.

    The scaler sees the training folds only.
    """
    columns = [id_column, label, "fold", "probability", "candidate"]
    if fit is classifiers.fit_logistic:
        models = newton.fit_many(folded, features, label, grid, range(folds), scale_inside)
        return newton.out_of_fold(folded, models, features, [id_column, label]).select(*columns)
    fits, which = _shared_fits(fit, grid)
    if fit is boosting.fit_boosted:
        ends, found = boosting.fit_many(folded, features, label, fits, range(folds))
        models = [replace(m.first(grid[c].get("n_estimators", len(m.feature))), candidate=c)
                  for m in found for c, own in enumerate(which) if own == m.candidate]
        return boosting.with_probability(folded, ends, models, features, [id_column, label, "fold"], by_fold=True).select(*columns)
    if fit is classifiers.fit_forest:
        sizes = [[(c, forests.Settings(**grid[c]).n_estimators) for c, used in enumerate(which) if used == own] for own in range(len(fits))]
        many = forests.out_of_fold(folded, features, label, fits, sizes, range(folds), [id_column, label, "fold"])
        if many is not None:
            return many.select(*columns)
    spark, parts = folded.sparkSession, _table_parts(folded, features)
    uri = new_folder(spark, "out-of-fold")

    def one(fold: int, own: int) -> None:
        train, valid = folded.where(F.col("fold") != fold).coalesce(parts), folded.where(F.col("fold") == fold)
        if scale_inside:
            facts = scaling_facts(train, features)
            train, valid = scale(train, facts), scale(valid, facts)
        model = fit(train, features, label, **fits[own])
        for candidate, (params, used) in enumerate(zip(grid, which)):
            if used == own:
                fewer = params.get("n_estimators") != fits[own].get("n_estimators")
                classifiers.with_probability(classifiers.first_trees(model, params["n_estimators"]) if fewer else model, valid, features) \
                    .select(id_column, label, "probability").coalesce(parts).write.parquet(f"{uri}/fold={fold}/candidate={candidate}")

    _run_all([lambda f=fold, k=own: one(f, k) for fold in range(folds) for own in range(len(fits))], spark, parallelism)
    return spark.read.parquet(uri).select(*columns)


def fold_scores(pooled: DataFrame, label: str, by: Sequence[str] = ("candidate", "fold"),
                hard_labels: bool = False) -> DataFrame:
    """ROC area and average precision per candidate and fold.

    ``hard_labels`` scores 0/1 calls instead of probabilities.
    """
    if hard_labels:
        pooled = pooled.withColumn("probability", (F.col("probability") > 0.5).cast("double"))
    return metrics.ranking_metrics(pooled, label, "probability", by)


def grid_scores(scores: DataFrame) -> DataFrame:
    return scores.groupBy("candidate").agg(F.avg("roc_auc").alias("mean_auc"),
                                           F.avg("average_precision").alias("mean_ap"))


def best_candidate(scores: DataFrame, by: str = "mean_ap") -> int:
    """Candidate with the best mean score, the first one on ties; one row read."""
    return grid_scores(scores).orderBy(F.desc(by), "candidate").first().candidate


def search_with_calls(df: DataFrame, fit: Fit, grid: Mapping[str, Sequence[Any]], features: Sequence[str], label: str,
                      id_column: str, folds: int, seed: int = 42, parallelism: int = 8, scale_inside: bool = False,
                      hard_labels: bool = False, folded: DataFrame | None = None) -> tuple[dict[str, Any], DataFrame, DataFrame]:
    """Best parameters by mean average precision, the score table, and the best candidate's out-of-fold rows.

    ``folded`` is the same frame with its folds, if ``save_folds`` has written them already.
    """
    spark, options = df.sparkSession, candidates(grid)
    folded = save_folds(df, id_column, label, folds, seed) if folded is None else folded
    calls, uri = new_folder(spark, "grid-calls"), new_folder(spark, "grid-scores")
    out_of_fold(folded, folds, fit, options, features, label, id_column, parallelism, scale_inside) \
        .write.partitionBy("candidate").parquet(calls)
    pooled = spark.read.parquet(calls)
    fold_scores(pooled, label, hard_labels=hard_labels).write.parquet(uri)
    scores = spark.read.parquet(uri)
    best = best_candidate(scores)
    return options[best], scores, pooled.where(F.col("candidate") == best)


def search(df: DataFrame, fit: Fit, grid: Mapping[str, Sequence[Any]], features: Sequence[str], label: str,
           id_column: str, folds: int, **more: Any) -> tuple[dict[str, Any], DataFrame]:
    """Best parameters by mean average precision, and the score table."""
    return search_with_calls(df, fit, grid, features, label, id_column, folds, **more)[:2]


def cross_validated_auc(df: DataFrame, fit: Fit, params: Mapping[str, Any], features: Sequence[str],
                        label: str, id_column: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Mean fold area and twice its population deviation."""
    folded = save_folds(df, id_column, label, folds, seed)
    pooled = out_of_fold(folded, folds, fit, [params], features, label, id_column, scale_inside=False)
    scores = fold_scores(pooled, label)
    return scores.agg(F.count(F.lit(1)).alias("folds"), F.avg("roc_auc").alias("mean_auc"),
                      (2 * F.stddev_pop("roc_auc")).alias("spread"))


def compare_models(pooled: DataFrame, label: str, by: str = "model") -> DataFrame:
    """One row per model: ROC area and average precision."""
    return metrics.ranking_metrics(pooled, label, "probability", [by]) \
        .select(by, "roc_auc", "average_precision")
