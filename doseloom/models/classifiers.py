"""MLlib classifiers: L2 of inverse strength C, class weights, unscaled penalty."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseloom.functions.tails import chi2_p_value
from doseloom.models import forests
from doseloom.models.newton import class_weights

FEATURES, WEIGHT = "_features", "_weight"


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES).transform(df)


def class_sizes(df: DataFrame, label: str) -> tuple[int, int]:
    row = df.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).first()
    return row.n0, row.n1


def fit_logistic(df: DataFrame, features: Sequence[str], label: str, C: float = 1.0,
                 class_weight: str | Mapping[int, float] | None = None, max_iter: int = 1000,
                 sizes: tuple[int, int] | None = None):
    """Logistic regression with an L2 penalty of inverse strength ``C``.

    MLlib averages the loss over the weights, so the penalty is 1 / (C x sum of
    weights), taken from the rows that are fitted. ``sizes`` (rows per class)
    saves a count when many candidates are fitted on the same rows.
    """
    sizes = sizes or class_sizes(df, label)
    w0, w1 = class_weights(sizes, class_weight)
    weighted = assemble(df, features).withColumn(WEIGHT, F.when(F.col(label) == 1, w1).otherwise(w0))
    strength = 1.0 / (C * (sizes[0] * w0 + sizes[1] * w1))
    return LogisticRegression(featuresCol=FEATURES, labelCol=label, weightCol=WEIGHT, regParam=strength,
                              elasticNetParam=0.0, standardization=False, maxIter=max_iter,
                              tol=1e-10).fit(weighted)


def fit_forest(df: DataFrame, features: Sequence[str], label: str, n_estimators: int = 100,
               max_depth: int | None = None, min_samples_split: int = 2, seed: int = 42):
    """Random forest. No depth limit means MLlib's deepest tree (30); a node is
    split only when both children can hold half of ``min_samples_split``.

    Each row's node of each tree is kept from level to level: otherwise every level sends all
    trees grown so far to the tasks, and walks them from the root. The trees are the same.

    A table of many rows is fitted by ``forests``, on counted cells."""
    many = forests.fit(df, features, label, n_estimators=n_estimators, max_depth=max_depth, min_samples_split=min_samples_split, seed=seed)
    if many is not None:
        return many
    return RandomForestClassifier(
        featuresCol=FEATURES, labelCol=label, numTrees=n_estimators,
        maxDepth=30 if max_depth is None else max_depth,
        minInstancesPerNode=max(1, min_samples_split // 2), seed=seed, cacheNodeIds=True).fit(assemble(df, features))


def fit_boosted(df: DataFrame, features: Sequence[str], label: str, n_estimators: int = 100,
                learning_rate: float = 0.1, max_depth: int = 3, min_child_weight: int = 1, seed: int = 42):
    """Gradient-boosted trees."""
    return GBTClassifier(
        featuresCol=FEATURES, labelCol=label, maxIter=n_estimators, stepSize=learning_rate,
        maxDepth=max_depth, minInstancesPerNode=min_child_weight, seed=seed).fit(assemble(df, features))


def first_trees(model: Any, count: int) -> Any:
    """The forest or boosted model of the first ``count`` trees of ``model``."""
    if isinstance(model, forests.Forest):
        return model.first(count)
    have = model._java_obj
    if count >= model.getNumTrees:
        return model
    gateway, trees = SparkContext._active_spark_context._gateway, have.trees()
    kind = gateway.jvm.org.apache.spark.ml
    if isinstance(model, GBTClassificationModel):
        own = gateway.new_array(kind.regression.DecisionTreeRegressionModel, count)
        weights = gateway.new_array(gateway.jvm.double, count)
        for i in range(count):
            own[i], weights[i] = trees[i], float(have.treeWeights()[i])
        fewer = kind.classification.GBTClassificationModel(have.uid(), own, weights, have.numFeatures(), 2)
    else:
        own = gateway.new_array(kind.classification.DecisionTreeClassificationModel, count)
        for i in range(count):
            own[i] = trees[i]
        fewer = kind.classification.RandomForestClassificationModel(have.uid(), own, have.numFeatures(), have.numClasses())
    out = model._copyValues(type(model)(fewer))
    out._set(**{"maxIter" if out.hasParam("maxIter") else "numTrees": count})
    out._transfer_params_to_java()
    return out


def with_probability(model: Any, df: DataFrame, features: Sequence[str], into: str = "probability") -> DataFrame:
    """Add the model's probability of class 1."""
    if isinstance(model, forests.Forest):
        return model.with_probability(df, features, into)
    kept = df.columns
    scored = model.transform(assemble(df, features))
    return scored.select(*kept, vector_to_array(F.col(model.getProbabilityCol()))[1].alias(into))


def logistic_probability(model: Any, features: Sequence[str]) -> Column:
    """The same probability as a plain expression over the feature columns."""
    margin = sum((F.lit(float(c)) * F.col(f) for c, f in zip(model.coefficients, features)),
                 F.lit(float(model.intercept)))
    return 1.0 / (1.0 + F.exp(-margin))


def odds_ratios(model: Any, features: Sequence[str], df: DataFrame) -> DataFrame:
    """exp(coefficient) per feature: the odds ratio per unit, or per SD of a z-score; any model with coefficients."""
    rows = [(f, float(c), math.exp(c)) for f, c in zip(features, model.coefficients)]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double, odds_ratio double")


def model_tests(model: Any, df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Two tail values of a fitted logistic model, in one pass over the rows.

    ``accuracy_chi2_tail`` puts accuracy x n into a one-degree chi-square tail.
    It is kept under that name because it is not a test; the likelihood-ratio
    value next to it compares the model with an intercept alone.
    """
    p = logistic_probability(model, features)
    y = F.col(label).cast("double")
    sums = df.select(y.alias("y"), p.alias("p")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("cases"),
        F.count_if((F.col("p") > 0.5) == (F.col("y") == 1)).alias("correct"),
        F.sum(F.when(F.col("y") == 1, F.ln("p")).otherwise(F.ln(1 - F.col("p")))).alias("fitted"))
    share = F.col("cases") / F.col("n")
    # A class without rows adds nothing to the intercept-only likelihood.
    null = (F.when(F.col("cases") > 0, F.col("cases") * F.ln(share)).otherwise(0.0)
            + F.when(F.col("cases") < F.col("n"), (F.col("n") - F.col("cases")) * F.ln(1 - share)).otherwise(0.0))
    facts = sums.select("n", (F.col("correct") / F.col("n")).alias("accuracy"),
                        F.col("correct").cast("double").alias("_correct"),
                        (2 * (F.col("fitted") - null)).alias("likelihood_ratio"))
    return facts.select("n", "accuracy", chi2_p_value(F.col("_correct")).alias("accuracy_chi2_tail"),
                        "likelihood_ratio", chi2_p_value(F.col("likelihood_ratio")).alias("likelihood_ratio_p"))


def importance_table(df: DataFrame, features: Sequence[str], **columns: Sequence[float]) -> DataFrame:
    """One row per feature with coefficients or importances, largest size first."""
    names = list(columns)
    rows = [(f, *[float(columns[n][i]) for n in names]) for i, f in enumerate(features)]
    schema = ", ".join(["feature string", *[f"{n} double" for n in names]])
    return df.sparkSession.createDataFrame(rows, schema).orderBy(F.desc(F.abs(names[0])), "feature")
