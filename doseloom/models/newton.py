"""Many penalised logistic regressions at once: one aggregate per Newton step for all of them.

A model is a (candidate, fold) pair: a class-weight rule and an inverse penalty ``C``, fitted on the rows of all other
folds. In each step every task goes through its rows once and adds up, for each pair, the gradient, the
Hessian and the loss at the pair's current coefficients; these sums meet in one shuffle by pair and place. What
reaches the driver is bounded by pairs x (features + 1) ** 2, whatever the number of rows. A step that raises a pair's loss
is halved, and pairs that have converged take no part in later steps.

The penalty is that of the coefficients' squares over ``2 C``; the intercept is free. With
``scale_inside`` features are standardised by the mean and population deviation of the pair's own
training rows, and the fitted coefficients are given back in the units of the features.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLD = "fold"
ALL_ROWS = -1  # the "fold" of a model that is fitted on every row
_SUMS = pa.schema([("pair", pa.int32()), ("sums", pa.list_(pa.float64()))])


class EmptyClassError(ValueError):
    """A model would be fitted on rows of one class only."""


@dataclass(frozen=True)
class LogisticFit:
    """Intercept and coefficients in the units of the features, of one candidate without one fold."""

    candidate: int
    fold: int
    intercept: float
    coefficients: tuple[float, ...]


@dataclass
class _Facts:
    """Rows per class and feature moments of some rows."""

    n0: int
    n1: int
    mean: np.ndarray
    square: np.ndarray  # sum of squared distances from the mean

    @classmethod
    def together(cls, parts: Sequence[_Facts]) -> _Facts:
        sizes = np.array([p.n0 + p.n1 for p in parts], float)
        mean = sum(n * p.mean for n, p in zip(sizes, parts)) / max(1.0, sizes.sum())
        square = sum(p.square + n * (p.mean - mean) ** 2 for n, p in zip(sizes, parts))
        return cls(sum(p.n0 for p in parts), sum(p.n1 for p in parts), mean, square)

    def scale(self) -> np.ndarray:
        deviation = np.sqrt(self.square / max(1, self.n0 + self.n1))
        return np.where(deviation > 0, deviation, 1.0)


def class_weights(sizes: tuple[int, int], rule: str | Mapping[int, float] | None) -> tuple[float, float]:
    """Weight per class: none, ``balanced`` (n / (2 n_class)), or given ones."""
    n0, n1 = sizes
    if rule is None:
        return 1.0, 1.0
    if rule == "balanced":
        if not n0 or not n1:
            raise EmptyClassError(f"balanced weights need rows of both classes, not {n0} and {n1}")
        return (n0 + n1) / (2.0 * n0), (n0 + n1) / (2.0 * n1)
    return float(rule.get(0, 1.0)), float(rule.get(1, 1.0))


def _facts(rows: DataFrame, features: Sequence[str], label: str) -> dict[int, _Facts]:
    """Of each fold, in one aggregate; a fold is one row."""
    moments = [e for i, f in enumerate(features) for e in (F.avg(f).alias(f"m{i}"), F.var_pop(f).alias(f"v{i}"))]
    found = rows.groupBy(FOLD).agg(F.count_if(F.col(label) == 1).alias("n1"), F.count(F.lit(1)).alias("n"), *moments).collect()
    return {r[FOLD]: _Facts(r.n - r.n1, r.n1, np.array([r[f"m{i}"] for i in range(len(features))], float),
                            r.n * np.array([r[f"v{i}"] for i in range(len(features))], float)) for r in found}


def _sums(rows: DataFrame, width: int, pairs: Sequence[tuple], points: Mapping[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Gradient, upper half of the Hessian and loss (without penalty) of each pair at its point.

    ``rows`` holds the label, the fold and the features, in this order.
    """
    by_fold: dict[int, list[int]] = {}
    for k in points:
        by_fold.setdefault(pairs[k][0], []).append(k)
    shared = rows.sparkSession.sparkContext.broadcast((by_fold, {k: pairs[k][1:] for k in points}, dict(points)))
    upper = np.triu_indices(width)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds, facts, at = shared.value
        total = {k: np.zeros(width + len(upper[0]) + 1) for k in at}
        for batch in batches:
            y, fold, *x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            x = np.column_stack([c.astype(float) for c in x]) if x else np.zeros((len(y), 0))
            for out, own in folds.items():
                mean, scale, _ = facts[own[0]]  # the same for all candidates of a fold
                use = fold != out
                design = np.column_stack([np.ones(int(use.sum())), (x[use] - mean) / scale])
                case = y[use] == 1
                margins = design @ np.stack([at[k] for k in own], 1)
                for j, k in enumerate(own):
                    w0, w1 = facts[k][2]
                    weight, margin = np.where(case, w1, w0), margins[:, j]
                    chance = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
                    hessian = design.T @ (design * (weight * chance * (1 - chance))[:, None])
                    loss = np.logaddexp(0, np.where(case, -margin, margin)) @ weight
                    total[k] += np.concatenate([design.T @ (weight * (chance - case)), hessian[upper], [loss]])
        yield pa.RecordBatch.from_pydict({"pair": list(total), "sums": [t.tolist() for t in total.values()]}, schema=_SUMS)

    parts = rows.mapInArrow(summed, "pair int, sums array<double>").select("pair", F.posexplode("sums").alias("at", "part"))
    found = parts.groupBy("pair", "at").agg(F.sum("part").alias("total")).collect()
    out = {k: np.zeros(width + len(upper[0]) + 1) for k in points}
    for r in found:
        out[r.pair][r["at"]] = r.total
    return out


def fit_many(df: DataFrame, features: Sequence[str], label: str, options: Sequence[Mapping[str, Any]],
             folds: Sequence[int] = (ALL_ROWS,), scale_inside: bool = False, tolerance: float = 1e-10,
             most_steps: int = 100) -> list[LogisticFit]:
    """One fit per candidate (``C``, ``class_weight``) and fold, each on the rows outside its fold.

    Rows with a null feature or label are left out. ``folds`` names values of the column ``fold``; ``ALL_ROWS`` leaves
    none out, and without that column it is the only choice.
    """
    label_column = F.col(label).cast("int").alias("_y")
    fold = F.col(FOLD).cast("int") if FOLD in df.columns else F.lit(ALL_ROWS - 1)
    rows = df.select(label_column, fold.alias(FOLD), *[F.col(f).cast("double").alias(f) for f in features]).na.drop()
    known = _facts(rows, features, "_y")
    train = {f: _Facts.together([p for k, p in known.items() if k != f]) if set(known) - {f} else _Facts(0, 0, 0, 0) for f in folds}
    width = len(features) + 1
    pairs, strength = [], []
    for f, facts in train.items():
        if not facts.n0 or not facts.n1:
            raise EmptyClassError(f"the rows outside fold {f} hold {facts.n0} controls and {facts.n1} cases")
        mean = facts.mean if scale_inside else np.zeros(width - 1)
        scale = facts.scale() if scale_inside else np.ones(width - 1)
        for params in options:
            pairs.append((f, mean, scale, class_weights((facts.n0, facts.n1), params.get("class_weight"))))
            strength.append(1.0 / params.get("C", 1.0))
    here = {k: np.zeros(width) for k in range(len(pairs))}
    tried, move, size = dict(here), {}, {}
    upper, free = np.triu_indices(width), np.r_[0.0, np.ones(width - 1)]
    loss: dict[int, float] = {}
    for _ in range(most_steps):
        if not tried:
            break
        sums = _sums(rows, width, pairs, tried)
        following = {}
        for k, point in tried.items():
            total = sums[k][-1] + strength[k] / 2 * (free * point) @ point
            if k in loss and total > loss[k] + 1e-9 * abs(loss[k]):
                size[k] /= 2
                if size[k] > 1e-6:
                    following[k] = here[k] + size[k] * move[k]
                continue
            here[k], loss[k] = point, total
            gradient = sums[k][:width] + strength[k] * free * point
            hessian = np.zeros((width, width))
            hessian[upper] = sums[k][width:-1]
            hessian = np.triu(hessian) + np.triu(hessian, 1).T + np.diag(strength[k] * free)
            move[k], size[k] = -np.linalg.solve(hessian, gradient), 1.0
            if np.abs(move[k]).max() > tolerance * max(1.0, np.abs(point).max()):
                following[k] = point + move[k]
            else:
                here[k] = point + move[k]
        tried = following
    out = []
    for k, (f, mean, scale, _) in enumerate(pairs):
        own = here[k][1:] / scale
        out.append(LogisticFit(k % len(options), f, float(here[k][0] - own @ mean) if width > 1 else float(here[k][0]),
                               tuple(map(float, own))))
    return out


def fit_one(df: DataFrame, features: Sequence[str], label: str, C: float = 1.0,
            class_weight: str | Mapping[int, float] | None = None) -> LogisticFit:
    return fit_many(df.drop(FOLD), features, label, [{"C": C, "class_weight": class_weight}])[0]


def out_of_fold(folded: DataFrame, fits: Sequence[LogisticFit], features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep``, ``fold, candidate, probability``: every row under every candidate fitted without its fold.

    The models are one row for each pair, so the join with them moves no data row.
    """
    spark = folded.sparkSession
    models = spark.createDataFrame([(f.fold, f.candidate, f.intercept, list(f.coefficients)) for f in fits],
                                   "_fold int, candidate int, _intercept double, _coefficients array<double>")
    margin = sum((F.get("_coefficients", F.lit(i)) * F.col(f) for i, f in enumerate(features)), F.col("_intercept"))
    both = folded.join(F.broadcast(models), F.col(FOLD) == F.col("_fold"))
    return both.select(*keep, FOLD, "candidate", (1.0 / (1.0 + F.exp(-margin))).alias("probability"))
