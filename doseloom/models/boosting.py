"""Gradient-boosted trees for a whole grid: every (candidate, fold) model of a search in one go.

Features are cut into at most ``BINS`` bins at sketched quantiles, once for all models. A tree grows level by level: of
each open node a histogram holds count, gradient and Hessian per feature and bin, and the best cut comes from its running sums.

* A table whose packed bins are counted as at most ``FEW_BYTES`` is broadcast, and each model is one task. Of more than ``MANY_ROWS``
  rows, those alike in all bins are one cell with its rows and cases by fold: they have the same margin in every model.
* Beyond that rows stay in blocks of the shared folder, each with its own margins, and one aggregate a level adds up the histograms
  of all models at once; what reaches the driver is bounded by models x nodes x features x bins. Margins are
  written again every ``KEEP`` rounds; in between tasks add the trees grown since.

Both ways go through the same steps on the same sums, so they give the same trees.

``newton=True`` weighs a cut by Hessians with an L2 term of 1 and asks for ``min_child_weight`` of Hessian in a child;
``newton=False`` weighs it by rows (least squares on the residuals) and asks for that many rows. Leaves are Newton steps
in both. Rows with a null feature or label are left out of a fit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseloom.models.newton import ALL_ROWS, FOLD, EmptyClassError
from doseloom.plans.storage import new_folder

BINS = 256
FEW_BYTES = 32 << 20
MANY_ROWS = 1 << 16
KEEP = 10
_BLOCK_ROWS = 1 << 16
_L2 = 1.0


@dataclass(frozen=True)
class Settings:
    n_estimators: int = 100
    learning_rate: float = 0.1
    max_depth: int = 3
    min_child_weight: float = 1.0
    newton: bool = False


@dataclass(frozen=True)
class Boosted:
    """A fitted model; node k of a tree has the children 2 k + 1 and 2 k + 2, and a leaf has the feature -1."""

    candidate: int
    fold: int
    base: float
    feature: np.ndarray  # trees x nodes
    cut: np.ndarray  # rows with a bin up to it go left
    value: np.ndarray
    gain: np.ndarray  # of the cut of each node

    def first(self, trees: int) -> Boosted:
        return replace(self, feature=self.feature[:trees], cut=self.cut[:trees], value=self.value[:trees], gain=self.gain[:trees])

    def margins(self, bins: np.ndarray, start: int = 0) -> np.ndarray:
        """What the trees from ``start`` on add up to, and the base if that is the first one."""
        out = np.full(len(bins), 0.0 if start else self.base)
        for tree in range(start, len(self.feature)):
            out += self.value[tree][leaves(bins, self.feature[tree], self.cut[tree])]
        return out

    def importances(self, features: int) -> np.ndarray:
        """Mean gain of each feature's cuts, as shares of 1."""
        used = self.feature >= 0
        total = np.bincount(self.feature[used], self.gain[used], features)
        mean = total / np.maximum(1, np.bincount(self.feature[used], minlength=features))
        return mean / mean.sum() if mean.sum() else mean


def leaves(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node of one tree at which each row ends, as far as the tree has grown."""
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(len(feature).bit_length()):
        split = feature[node]
        right = bins[rows, split] > cut[node]
        node = np.where(split < 0, node, 2 * node + 1 + right)
    return node


def histogram(bins: np.ndarray, place: np.ndarray, nodes: int, gradient: np.ndarray, hessian: np.ndarray,
              count: np.ndarray | None = None) -> np.ndarray:
    """Count, gradient and Hessian by (node of the level, feature, bin); rows with a place under 0 are settled."""
    out = np.empty((nodes, bins.shape[1], BINS, 3))
    if place.min(initial=0) < 0:
        use = np.flatnonzero(place >= 0)
        place, bins, gradient, hessian, count = place[use], bins[use], gradient[use], hessian[use], None if count is None else count[use]
    begin = place * BINS
    for f in range(bins.shape[1]):  # one feature at a time: no weight is repeated for each of them
        cell = begin + bins[:, f]
        for k, w in enumerate((count, gradient, hessian)):
            out[:, f, :, k] = np.bincount(cell, w, nodes * BINS).reshape(nodes, BINS)
    return out


class Tree:
    """A tree that grows by one level at a time."""

    def __init__(self, depth: int):
        nodes = (2 << depth) - 1
        self.feature, self.cut = np.full(nodes, -1, np.int16), np.zeros(nodes, np.int16)
        self.value, self.gain = np.zeros(nodes), np.zeros(nodes)

    def grow(self, level: int, sums: np.ndarray, own: Settings) -> None:
        """Cut the nodes of a level where that gains, and give both children their leaf values."""
        first, l2 = (1 << level) - 1, _L2 if own.newton else 0.0
        left = sums.cumsum(2)[:, :, :-1]  # node, feature, cut
        whole = sums[:, :1].sum(2, keepdims=True)
        right = whole - left
        weight = 2 if own.newton else 0

        def score(part: np.ndarray) -> np.ndarray:
            return part[..., 1] ** 2 / np.maximum(part[..., weight] + l2, 1e-300)

        fits = (left[..., 0] > 0) & (right[..., 0] > 0) & (np.minimum(left[..., weight], right[..., weight]) >= own.min_child_weight)
        gain = np.where(fits, score(left) + score(right) - score(whole), -1.0).reshape(len(sums), -1)
        best = gain.argmax(1)
        if not level:
            self.value[0] = self._leaf(whole[0, 0, 0], own)
        for k in np.flatnonzero(gain[np.arange(len(sums)), best] > 1e-9):
            node = first + k
            if node and self.feature[(node - 1) // 2] < 0:
                continue
            f, at = divmod(int(best[k]), BINS - 1)
            self.feature[node], self.cut[node], self.gain[node] = f, at, gain[k, best[k]]
            self.value[2 * node + 1], self.value[2 * node + 2] = (self._leaf(part[k, f, at], own) for part in (left, right))

    @staticmethod
    def _leaf(sums: np.ndarray, own: Settings) -> float:
        steep = sums[2] + (_L2 if own.newton else 0.0)
        return -own.learning_rate * sums[1] / steep if steep > 1e-12 else 0.0

    def descend(self, bins: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Each row's node after the level last grown, from its node before."""
        split = self.feature[node]
        right = bins[np.arange(len(bins)), split] > self.cut[node]
        return np.where(split < 0, node, 2 * node + 1 + right)

    def places(self, bins: np.ndarray, level: int) -> np.ndarray:
        """Each row's node of the level, -1 where its path has ended before."""
        place = leaves(bins, self.feature, self.cut) - ((1 << level) - 1)
        return np.where(place >= 0, place, -1)


def _slopes(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    chance = 1 / (1 + np.exp(-margin))
    return chance - y, chance * (1 - chance)


def _grown(candidate: int, fold: int, base: float, trees: Sequence[Tree]) -> Boosted:
    return Boosted(candidate, fold, base, *(np.stack([getattr(t, c) for t in trees]) for c in ("feature", "cut", "value", "gain")))


def _fit_here(bins: np.ndarray, y: np.ndarray, base: float, own: Settings, count: np.ndarray | None = None) -> list[Tree]:
    """The trees on rows, or on cells with ``y`` cases among ``count`` rows."""
    margin, trees = np.full(len(y), base), []
    for _ in range(own.n_estimators):
        gradient, hessian = _slopes(margin, y if count is None else 0.0)
        if count is not None:
            gradient, hessian = count * gradient - y, count * hessian
        tree, node = Tree(own.max_depth), np.zeros(len(y), np.int64)
        for level in range(own.max_depth):
            place = np.maximum(node - ((1 << level) - 1), -1)  # -1 where a path has ended before
            if (place < 0).all():
                break
            tree.grow(level, histogram(bins, place, 1 << level, gradient, hessian, count), own)
            node = tree.descend(bins, node)
        margin += tree.value[node]
        trees.append(tree)
    return trees


def thresholds(df: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Upper ends of the bins: sketched quantiles of each feature, in one aggregate."""
    shares = [k / (BINS - 1) for k in range(1, BINS - 1)]
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 100_000).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [np.unique(np.array(row[f"q{i}"] or [], float)) for i in range(len(features))]


def binned(columns: Sequence[pa.Array], ends: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c.to_numpy(zero_copy_only=False).astype(float)) for c, e in zip(columns, ends)], 1).astype(np.uint8)


def _base(cases: int, rows: int, fold: int) -> float:
    if not 0 < cases < rows:
        raise EmptyClassError(f"the rows outside fold {fold} hold {rows - cases} controls and {cases} cases")
    return float(np.log(cases / (rows - cases)))


def fit_many(df: DataFrame, features: Sequence[str], label: str, options: Sequence[Mapping[str, Any]],
             folds: Sequence[int] = (ALL_ROWS,), few_bytes: int = FEW_BYTES) -> tuple[list[np.ndarray], list[Boosted]]:
    """The bins' ends, and one model per candidate and fold, each fitted on the rows outside its fold."""
    fold = F.col(FOLD).cast("int") if FOLD in df.columns else F.lit(ALL_ROWS - 1)
    rows = df.select(F.col(label).cast("double").alias("_y"), fold.alias(FOLD), *[F.col(f).cast("double").alias(f) for f in features]).na.drop()
    ends = thresholds(rows, features)
    counts = {r[FOLD]: (r.n, r.cases) for r in rows.groupBy(FOLD).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_y") == 1).alias("cases")).collect()}
    base = {f: _base(sum(c for k, (_, c) in counts.items() if k != f), sum(n for k, (n, _) in counts.items() if k != f), f) for f in folds}
    models = [(c, f, base[f], Settings(**options[c])) for f in folds for c in range(len(options))]
    total = sum(n for n, _ in counts.values())
    if total * (len(features) + 5) <= few_bytes:
        return ends, _fit_in_tasks(rows, ends, models)
    return ends, _fit_by_level(rows, ends, models)


def _blocks(rows: DataFrame, ends: Sequence[np.ndarray]) -> DataFrame:
    """Packed rows: label, fold and bins of up to ``_BLOCK_ROWS`` rows each."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BLOCK_ROWS):
                y, fold, *x = batch.slice(at, _BLOCK_ROWS).columns
                yield pa.RecordBatch.from_pydict({
                    "y": [(y.to_numpy(zero_copy_only=False) == 1).tobytes()],
                    "fold": [fold.to_numpy(zero_copy_only=False).astype(np.int32).tobytes()], "bins": [binned(x, ends).tobytes()]})
    return rows.mapInArrow(packed, "y binary, fold binary, bins binary")


def _unpacked(y: bytes, fold: bytes, bins: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    case = np.frombuffer(y, bool).astype(float)
    return case, np.frombuffer(fold, np.int32), np.frombuffer(bins, np.uint8).reshape(len(case), -1)


def _alike(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and which of them each row is; all rows where a row does not fit into a long."""
    if bins.shape[1] > 7:
        return bins, np.arange(len(bins))
    key, own = np.unique(bins.astype(np.int64) @ (1 << 8 * np.arange(bins.shape[1])), return_inverse=True)
    return (key[:, None] >> 8 * np.arange(bins.shape[1])).astype(np.uint8), own


def _cells(y: np.ndarray, fold: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct bins of rows, and for each of these the cases and the rows of each fold; last the folds."""
    alike, own = _alike(bins)
    folds, at = np.unique(fold, return_inverse=True)
    place, shape = own * len(folds) + at, (len(alike), len(folds))
    cases, count = (np.bincount(place, w, math.prod(shape)).reshape(shape).astype(np.int32) for w in (y, None))
    return alike, cases, count, folds


def _fit_in_tasks(rows: DataFrame, ends: Sequence[np.ndarray], models: Sequence[tuple]) -> list[Boosted]:
    """Each model in a task of its own, on the broadcast table."""
    spark = rows.sparkSession
    # In a fixed order of the rows: sums of doubles depend on it.
    parts = [_unpacked(r.y, r.fold, r.bins) for r in _blocks(rows.orderBy(FOLD, "_y", *rows.columns[2:]), ends).collect()]
    table = tuple(np.concatenate(c) for c in zip(*parts))
    cells = _cells(*table) if len(table[0]) > MANY_ROWS else None
    many = cells is not None and sum(c.nbytes for c in cells) < sum(c.nbytes for c in table)
    shared = spark.sparkContext.broadcast((cells if many else table, list(models)))
    names = ("feature", "cut", "value", "gain")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, all_models = shared.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                _, out, base, own = all_models[k]
                if many:
                    bins, cases, count, folds = table
                    cases, count = (c[:, folds != out].sum(1).astype(float) for c in (cases, count))
                    train = count > 0
                    trees = _fit_here(bins[train], cases[train], base, own, count[train])
                else:
                    y, fold, bins = table
                    train = fold != out
                    trees = _fit_here(bins[train], y[train], base, own)
                yield pa.RecordBatch.from_pydict({"model": pa.array([k], pa.int64()), **{
                    c: [np.stack([getattr(t, c) for t in trees]).tobytes()] for c in names}})

    jobs = spark.range(0, len(models), 1, len(models)).mapInArrow(
        fitted, "model long, feature binary, cut binary, value binary, gain binary")
    out = []
    for r in sorted(jobs.collect(), key=lambda r: r.model):
        c, f, base, own = models[r.model]
        shape = (own.n_estimators, (2 << own.max_depth) - 1)
        out.append(Boosted(c, f, base, *(np.frombuffer(r[n], d).reshape(shape) for n, d in zip(names, (np.int16, np.int16, float, float)))))
    return out


def _fit_by_level(rows: DataFrame, ends: Sequence[np.ndarray], models: Sequence[tuple]) -> list[Boosted]:
    """All models together: one aggregate for each level of each round."""
    spark, width = rows.sparkSession, len(ends)
    settings = [m[3] for m in models]
    grown: list[list[Tree]] = [[] for _ in models]

    def written(blocks: DataFrame, start: int) -> DataFrame:
        """The blocks with every model's margins, the trees from ``start`` on included."""
        shared = spark.sparkContext.broadcast([_grown(c, f, b, t) if t else None for (c, f, b, _), t in zip(models, grown)])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    bins = _unpacked(r["y"], r["fold"], r["bins"])[2]
                    old = np.frombuffer(r["margins"]).reshape(len(models), -1) if start else \
                        np.array([[m[2]] * len(bins) for m in models])
                    more = [m.margins(bins, start) if start else m.margins(bins) - m.base if m else 0.0 for m in shared.value]
                    out.append((old + np.array([np.broadcast_to(x, len(bins)) for x in more])).tobytes())
                names = ("y", "fold", "bins")
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.binary())], names=[*names, "margins"])
        uri = new_folder(spark, "boosting-margins")
        blocks.mapInArrow(summed, "y binary, fold binary, bins binary, margins binary").write.parquet(uri)
        return spark.read.parquet(uri)

    def histograms(blocks: DataFrame, since: int, level: int, trees: Mapping[int, Tree]) -> dict[int, np.ndarray]:
        shared = spark.sparkContext.broadcast(({k: (grown[k][since:], t) for k, t in trees.items()}, [m[1] for m in models]))

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (own, outs), total = shared.value, {}
            for batch in batches:
                for r in batch.to_pylist():
                    y, fold, bins = _unpacked(r["y"], r["fold"], r["bins"])
                    margins = np.frombuffer(r["margins"]).reshape(len(outs), -1)
                    for k, (before, tree) in own.items():
                        train = fold != outs[k]
                        x, margin = bins[train], margins[k][train].copy()
                        for t in before:
                            margin += t.value[leaves(x, t.feature, t.cut)]
                        place = tree.places(x, level) if level else np.zeros(len(x), np.int64)
                        total[k] = total.get(k, 0) + histogram(x, place, 1 << level, *_slopes(margin, y[train]))
            for k, t in total.items():
                flat = t.reshape(-1, 3)
                cells = np.flatnonzero(flat[:, 0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), k, np.int32)), pa.array(cells), *map(pa.array, flat[cells].T)],
                                                 names=["model", "cell", "n", "g", "h"])

        cells = blocks.mapInArrow(summed, "model int, cell long, n double, g double, h double").groupBy("model", "cell") \
            .agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        model, cell = cells.column("model").to_numpy(), cells.column("cell").to_numpy()
        values, out = np.stack([cells.column(c).to_numpy() for c in "ngh"], 1), {}
        for k in trees:
            out[k] = np.zeros(((1 << level) * width * BINS, 3))
            out[k][cell[model == k]] = values[model == k]
            out[k] = out[k].reshape(1 << level, width, BINS, 3)
        return out

    uri = new_folder(spark, "boosting-rows")
    _blocks(rows, ends).write.parquet(uri)
    blocks, since = written(spark.read.parquet(uri), 0), 0
    for turn in range(max(s.n_estimators for s in settings)):
        trees = {k: Tree(s.max_depth) for k, s in enumerate(settings) if turn < s.n_estimators}
        for level in range(max(settings[k].max_depth for k in trees)):
            open_now = {k: t for k, t in trees.items() if level < settings[k].max_depth
                        and (not level or (t.feature[(1 << level - 1) - 1:(1 << level) - 1] >= 0).any())}
            for k, sums in histograms(blocks, since, level, open_now).items() if open_now else ():
                trees[k].grow(level, sums, settings[k])
        for k, t in trees.items():
            grown[k].append(t)
        if (turn + 1) % KEEP == 0:
            blocks, since = written(blocks, since), turn + 1
    return [_grown(c, f, base, t) for (c, f, base, _), t in zip(models, grown)]


def with_probability(df: DataFrame, ends: Sequence[np.ndarray], models: Sequence[Boosted], features: Sequence[str],
                     keep: Sequence[str], by_fold: bool = False) -> DataFrame:
    """``keep, candidate, probability`` of every row and model; with ``by_fold`` only models fitted without the row's fold.

    A null feature gives a null probability.
    """
    shared = df.sparkSession.sparkContext.broadcast((list(ends), list(models)))
    rows = df.select(*keep, *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)],
                     (F.col(FOLD).cast("int") if by_fold else F.lit(ALL_ROWS)).alias("_fold"))
    kept = rows.select(*keep)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_ends, own = shared.value
        for batch in batches:
            x = [batch.column(f"_x{i}") for i in range(len(features))]
            known = np.all([c.is_valid().to_numpy(zero_copy_only=False) for c in x], axis=0)
            bins = binned([c.fill_null(0.0) for c in x], own_ends)
            fold = batch.column("_fold").to_numpy(zero_copy_only=False)
            found = {}
            for m in own:
                if m.fold not in found:
                    use = np.flatnonzero(fold == m.fold) if by_fold else np.arange(len(bins))
                    found[m.fold] = use, *_alike(bins[use])  # rows alike are worked out once
                use, alike, which = found[m.fold]
                if len(use):
                    chance = 1 / (1 + np.exp(-m.margins(alike)[which]))
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).take(pa.array(use)) for c in keep), pa.array(np.full(len(use), m.candidate, np.int32)),
                         pa.array(chance, mask=~known[use])], names=[*keep, "candidate", "probability"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return rows.mapInArrow(scored, f"{kinds}, candidate int, probability double")


def fit_boosted(df: DataFrame, features: Sequence[str], label: str, **params: Any) -> tuple[list[np.ndarray], Boosted]:
    """One model on all rows, with its bins' ends."""
    ends, models = fit_many(df.drop(FOLD), features, label, [params])
    return ends, models[0]
