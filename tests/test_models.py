import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from doseloom.functions.tails import chi2_p_value, erfc, t_p_value
from doseloom.models import boosting, classifiers, features, folds, forests, newton, selection
from doseloom.operators import metrics

NAMES = ["a", "b"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 2))
    y = (rng.random(300) < 1 / (1 + np.exp(1.2 - x @ [1.0, -0.5]))).astype(int)
    rows = [(i, float(u), float(v), int(k)) for i, ((u, v), k) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id long, a double, b double, y int").cache()


def optimum(x, y, strength, weights):
    """Minimise sum w logloss + |coef|^2 / (2 C), intercept free."""
    design = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([0.0] + [1.0 / strength] * x.shape[1])
    beta = np.zeros(design.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ beta))
        grad = design.T @ (weights * (p - y)) + penalty @ beta
        hess = design.T @ (design * (weights * p * (1 - p))[:, None]) + penalty
        beta = beta - np.linalg.solve(hess, grad)
    return beta


@pytest.mark.parametrize("strength,rule", [(1.0, None), (0.01, "balanced"), (10.0, {0: 1, 1: 5})])
def test_logistic_is_the_penalised_optimum(table, strength, rule):
    x, y, df = table
    model = classifiers.fit_logistic(df, NAMES, "y", strength, rule)
    n = len(y)
    w = {None: (1, 1), "balanced": (n / 2 / (y == 0).sum(), n / 2 / (y == 1).sum())}.get(
        rule if not isinstance(rule, dict) else "x", (1, 5))
    want = optimum(x, y, strength, np.where(y == 1, w[1], w[0]))
    own = newton.fit_one(df, NAMES, "y", strength, rule)
    assert [own.intercept, *own.coefficients] == pytest.approx(want.tolist(), abs=1e-10)
    assert [model.intercept, *model.coefficients] == pytest.approx(want.tolist(), abs=1e-5)
    ratios = {r.feature: r.odds_ratio for r in classifiers.odds_ratios(model, NAMES, df).collect()}
    assert ratios["a"] == pytest.approx(math.exp(want[1]), rel=1e-4)
    own = classifiers.with_probability(model, df, NAMES, "p").withColumn(
        "q", classifiers.logistic_probability(model, NAMES))
    assert own.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-12


def test_model_tests(table):
    x, y, df = table
    model = classifiers.fit_logistic(df, NAMES, "y")
    row = classifiers.model_tests(model, df, NAMES, "y").first()
    p = 1 / (1 + np.exp(-(model.intercept + x @ np.array(model.coefficients))))
    correct = ((p > 0.5) == (y == 1)).sum()
    assert row.n == 300 and row.accuracy == pytest.approx(correct / 300)
    assert row.accuracy_chi2_tail == pytest.approx(math.erfc(math.sqrt(correct / 2)), rel=1e-9)
    fitted = np.sum(np.where(y == 1, np.log(p), np.log(1 - p)))
    null = y.sum() * math.log(y.mean()) + (1 - y).sum() * math.log(1 - y.mean())
    assert row.likelihood_ratio == pytest.approx(2 * (fitted - null))


def tail(spark, t, df):
    rows = spark.createDataFrame([(float(t), float(df)), (-float(t), float(df))], "t double, df double")
    found = [r[0] for r in rows.select(t_p_value(F.col("t"), F.col("df"))).collect()]
    assert found[0] == found[1]
    return found[0]


@pytest.mark.parametrize("t,df,p", [  # from published tables
    (12.706, 1, 0.05), (2.228, 10, 0.05), (1.96, 1e7, 0.05), (3.169, 10, 0.01), (0.0, 5, 1.0), (1.372, 10, 0.2)])
def test_t_tail(spark, t, df, p):
    assert tail(spark, t, df) == pytest.approx(p, rel=2e-3)


def test_t_tail_closed_forms_and_chi2(spark):
    for t in (0.3, 1.0, 4.0, 40.0):
        assert tail(spark, t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), rel=1e-9)
        assert tail(spark, t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-9)
    assert tail(spark, math.inf, 3) == 0.0
    edge = spark.createDataFrame([(None, 3.0), (float("nan"), 3.0), (1.0, 0.0)], "t double, df double")
    assert [r[0] for r in edge.select(t_p_value(F.col("t"), F.col("df"))).collect()] == [None] * 3
    xs = [0.0, 1e-9, 0.01, 1.0, 3.841459, 7.9, 8.1, 50.0, 900.0, -1.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(chi2_p_value(F.col("x"))).collect()
    assert [r[0] for r in got] == pytest.approx([math.erfc(math.sqrt(max(x, 0) / 2)) for x in xs], rel=1e-12)
    zs = [0.0, 0.5, 1.999, 2.0, 2.5, 6.0, 20.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select(erfc(F.col("z"))).collect()
    assert [r[0] for r in got] == pytest.approx([math.erfc(z) for z in zs], rel=1e-12)


def test_tails_need_no_python_worker(spark):
    plan = spark.range(1).select(t_p_value(F.rand(), F.lit(3.0)), chi2_p_value(F.rand()))._jdf.queryExecution().toString()
    assert "Python" not in plan


def t_by_steps(t, df, steps=200_000):
    """The tail as one minus a Simpson sum of the density from -t to t."""
    x = np.linspace(0, abs(t), steps + 1)
    density = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - (df + 1) / 2 * np.log1p(x * x / df)) / math.sqrt(df * math.pi)
    weight = np.where(np.arange(steps + 1) % 2, 4.0, 2.0)
    weight[[0, -1]] = 1.0
    return 1 - 2 * float(density @ weight) * abs(t) / steps / 3


def test_feature_effects(table):
    x, y, df = table
    rows = {r.feature: r for r in features.with_p_values(features.feature_effects(df, NAMES, "y")).collect()}
    for j, name in enumerate(NAMES):
        one, zero = x[y == 1, j], x[y == 0, j]
        v1, v0 = one.var(ddof=1), zero.var(ddof=1)
        pooled = ((len(one) - 1) * v1 + (len(zero) - 1) * v0) / (len(y) - 2)
        t = (one.mean() - zero.mean()) / math.sqrt(pooled * (1 / len(one) + 1 / len(zero)))
        assert rows[name].t_stat == pytest.approx(t) and rows[name].p_value == pytest.approx(t_by_steps(t, 298), rel=1e-6)
        assert rows[name].cohens_d == pytest.approx((one.mean() - zero.mean()) / math.sqrt((v1 + v0) / 2))


def test_scaler_uses_population_deviation(table):
    x, _, df = table
    got = features.scale(df, features.scaling_facts(df, NAMES)).orderBy("id").collect()
    want = (x - x.mean(0)) / x.std(0)
    assert np.allclose([[r.a, r.b] for r in got], want)
    flat = df.select("id", F.lit(3.0).alias("a"))
    assert {r.a for r in features.scale(flat, features.scaling_facts(flat, ["a"])).collect()} == {0.0}


def test_split_and_folds_are_exact_and_repeatable(spark):
    df = spark.createDataFrame([(i, int(i >= 341)) for i in range(399)], "id long, y int")
    split = folds.stratified_split(df.repartition(9), "id", "y").collect()
    assert sum(r.is_test for r in split if r.y == 0) == 68 and sum(r.is_test for r in split if r.y == 1) == 12
    again = folds.stratified_split(df.coalesce(1), "id", "y").collect()
    assert {r.id: r.is_test for r in split} == {r.id: r.is_test for r in again}
    dealt = folds.stratified_folds(df, "id", "y", 5).collect()
    assert len(dealt) == 399
    for y, sizes in ((0, {68, 69}), (1, {11, 12})):
        assert {sum(r.fold == k for r in dealt if r.y == y) for k in range(5)} <= sizes


def test_out_of_fold_and_search(table):
    _, _, df = table
    grid = {"C": [0.001, 1.0], "class_weight": ["balanced", None]}
    best, scores = selection.search(df, classifiers.fit_logistic, grid, NAMES, "y", "id", folds=3, scale_inside=True)
    assert scores.count() == 12 and best in selection.candidates(grid)
    means = {r.candidate: r.mean_ap for r in selection.grid_scores(scores).collect()}
    assert means[selection.candidates(grid).index(best)] == max(means.values())
    folded = selection.save_folds(df, "id", "y", 3)
    pooled = selection.out_of_fold(folded, 3, classifiers.fit_logistic, [best], NAMES, "y", "id")
    assert pooled.count() == 300 and pooled.select("id").distinct().count() == 300
    hard = selection.fold_scores(pooled, "y", hard_labels=True).count()
    assert hard == 3
    area = metrics.ranking_metrics(pooled, "y", "probability").first().roc_auc
    assert area > 0.65


def test_cross_validated_auc(table):
    _, _, df = table
    row = selection.cross_validated_auc(df, classifiers.fit_logistic, {}, NAMES, "y", "id", folds=3)
    r = row.first()
    assert r.folds == 3 and 0.6 < r.mean_auc < 1 and r.spread >= 0


def test_trees_and_importances(table):
    _, _, df = table
    forest = classifiers.fit_forest(df, NAMES, "y", n_estimators=5, max_depth=3)
    boosted = classifiers.fit_boosted(df, NAMES, "y", n_estimators=3, max_depth=2)
    for model in (forest, boosted):
        scored = classifiers.with_probability(model, df, NAMES)
        assert metrics.ranking_metrics(scored, "y", "probability").first().roc_auc > 0.7
    shown = classifiers.importance_table(df, NAMES, coefficient=[-3.0, 2.0],
                                         importance=forest.featureImportances.toArray()).collect()
    assert [r.feature for r in shown] == ["a", "b"] and sum(r.importance for r in shown) == pytest.approx(1)


@pytest.mark.parametrize("fit", [classifiers.fit_forest, classifiers.fit_boosted])
def test_fewer_trees_are_the_first_of_more(table, fit):
    _, _, df = table
    more = fit(df, NAMES, "y", n_estimators=6, max_depth=3)
    fewer = classifiers.first_trees(more, 3)
    assert fewer.getNumTrees == 3 and [t.toDebugString for t in fewer.trees] == [t.toDebugString for t in more.trees[:3]]
    got = [r.probability for r in classifiers.with_probability(fewer, df.orderBy("id"), NAMES).collect()]
    if fit is classifiers.fit_boosted:
        model = fit(df, NAMES, "y", n_estimators=3, max_depth=3)
        want = [r.probability for r in classifiers.with_probability(model, df.orderBy("id"), NAMES).collect()]
    else:
        want = np.mean([[t.predictProbability(r["_features"])[1] for r in classifiers.assemble(df.orderBy("id"), NAMES).collect()]
                        for t in more.trees[:3]], axis=0)
    assert got == pytest.approx(list(want), abs=1e-9)


def test_candidates_share_the_fit_with_most_trees(table):
    _, _, df = table
    grid = {"n_estimators": [2, 4], "max_depth": [2, 3]}
    fits, which = selection._shared_fits(classifiers.fit_boosted, selection.candidates(grid))
    assert [f["n_estimators"] for f in fits] == [4, 4] and which == [0, 1, 0, 1]
    for fit in (boosting.fit_boosted, classifiers.fit_forest):
        best, scores, pooled = selection.search_with_calls(df, fit, grid, NAMES, "y", "id", folds=2)
        assert scores.count() == 8 and best in selection.candidates(grid)
        assert pooled.count() == 300 and pooled.select("id").distinct().count() == 300


def test_registered_searches_are_whole(monkeypatch):
    from standins import models
    asked = []
    monkeypatch.setattr(models, "rows", lambda *_: None)
    monkeypatch.setattr(selection, "grid_scores", lambda scores: scores)
    monkeypatch.setattr(selection, "search", lambda df, fit, grid, *_, folds, **__: asked.append((fit, grid, folds)) or ({}, None))
    models.boosted_trees_grid(None, None)
    models._tuned(None, classifiers.fit_forest, selection.FOREST_GRID)
    trees = {"max_depth": [3, 4, 5], "min_child_weight": [1, 3, 5], "n_estimators": [200], "learning_rate": [0.3], "newton": [True]}
    assert asked == [(boosting.fit_boosted, trees, 5), (classifiers.fit_forest, selection.FOREST_GRID, 3)]


def test_many_logistic_fits_are_each_its_own(spark, table):
    """All pairs of one search against a plain Newton fit of each on its scaled training rows."""
    x, y, df = table
    folded = folds.stratified_folds(df, "id", "y", 3)
    fold = np.array([r.fold for r in folded.orderBy("id").collect()])
    grid = [{"C": 0.01, "class_weight": "balanced"}, {"C": 10.0, "class_weight": {0: 1, 1: 15}}, {}]
    fits = newton.fit_many(folded.repartition(5), NAMES, "y", grid, range(3), scale_inside=True)
    assert [(f.candidate, f.fold) for f in fits] == [(c, k) for k in range(3) for c in range(3)]
    for f in fits:
        use, params = fold != f.fold, grid[f.candidate]
        mean, sd = x[use].mean(0), x[use].std(0)
        n1, n0 = (y[use] == 1).sum(), (y[use] == 0).sum()
        rule = params.get("class_weight")
        w = {"balanced": (use.sum() / 2 / n0, use.sum() / 2 / n1), None: (1, 1)}.get(rule if not isinstance(rule, dict) else 0, (1, 15))
        want = optimum((x[use] - mean) / sd, y[use], params.get("C", 1.0), np.where(y[use] == 1, w[1], w[0]))
        coefficients = want[1:] / sd
        assert f.coefficients == pytest.approx(tuple(coefficients), abs=1e-9)
        assert f.intercept == pytest.approx(want[0] - coefficients @ mean, abs=1e-9)
    calls = newton.out_of_fold(folded, fits, NAMES, ["id"]).collect()
    assert len(calls) == 900
    named = {(f.candidate, f.fold): f for f in fits}
    for r in calls[:50]:
        f = named[r.candidate, r.fold]
        assert r.probability == pytest.approx(1 / (1 + math.exp(-(f.intercept + x[r.id] @ f.coefficients))))


def test_one_class_and_missing_values(spark, table):
    _, _, df = table
    one = df.withColumn("y", F.lit(1))
    for fit in (lambda: newton.fit_one(one, NAMES, "y"), lambda: boosting.fit_boosted(one, NAMES, "y"),
                lambda: newton.fit_one(df.limit(0), NAMES, "y"), lambda: classifiers.fit_logistic(one, NAMES, "y", class_weight="balanced")):
        with pytest.raises(newton.EmptyClassError):
            fit()
    holes = df.unionByName(spark.createDataFrame([(900, None, 1.0, 1), (901, 1.0, 1.0, None)], df.schema))
    assert newton.fit_one(holes, NAMES, "y").coefficients == pytest.approx(newton.fit_one(df, NAMES, "y").coefficients, abs=1e-12)
    ends, model = boosting.fit_boosted(holes, NAMES, "y", n_estimators=2)
    got = boosting.with_probability(holes, ends, [model], NAMES, ["id"]).where("id >= 900").orderBy("id").collect()
    assert got[0].probability is None and 0 < got[1].probability < 1
    apart = spark.createDataFrame([(float(k), int(k > 5)) for k in range(12)], "a double, y int")  # separable: the penalty holds
    assert 0.5 < newton.fit_one(apart, ["a"], "y", C=100.0).coefficients[0] < 50


def plain_boosting(x, y, rounds, rate, depth, least, second):
    """Margins of exact greedy boosting, cuts tried one by one."""
    margin = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    l2 = 1.0 if second else 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def leaf(rows):
            return -rate * g[rows].sum() / (h[rows].sum() + l2)

        def split(rows, level):
            if level == depth:
                return [(rows, leaf(rows))]
            weigh = (lambda r: h[r].sum() + l2) if second else len
            size = (lambda r: h[r].sum()) if second else len
            best = (1e-9, None)
            for f in range(x.shape[1]):
                for cut in np.unique(x[rows, f])[:-1]:
                    a, b = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if min(size(a), size(b)) >= least:
                        gain = sum(g[r].sum() ** 2 / weigh(r) for r in (a, b)) - g[rows].sum() ** 2 / weigh(rows)
                        if gain > best[0] + 1e-9:
                            best = (gain, (a, b))
            if best[1] is None:
                return [(rows, leaf(rows))]
            return split(best[1][0], level + 1) + split(best[1][1], level + 1)

        for rows, value in split(np.arange(len(y)), 0):
            margin[rows] += value
    return margin


@pytest.mark.parametrize("second,least", [(True, 3), (False, 1)])
def test_boosting_is_exact_greedy_and_alike_in_both_ways(spark, second, least):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 2)).round(2)
    y = (rng.random(120) < 1 / (1 + np.exp(-2 * x[:, 0] * x[:, 1]))).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(k), i % 3) for i, ((a, b), k) in enumerate(zip(x, y))],
                               "id long, a double, b double, y int, fold int").repartition(3)
    grid = [{"n_estimators": 12, "max_depth": 3, "min_child_weight": least, "newton": second, "learning_rate": 0.3},
            {"n_estimators": 3, "max_depth": 2, "min_child_weight": least, "newton": second}]
    for few in (boosting.FEW_BYTES, 0):
        ends, models = boosting.fit_many(df, NAMES, "y", grid, (0, boosting.ALL_ROWS), few_bytes=few)
        got = boosting.with_probability(df.drop("fold"), ends, [m for m in models if m.fold == boosting.ALL_ROWS], NAMES, ["id"]).collect()
        for c, params in enumerate(grid):
            want = 1 / (1 + np.exp(-plain_boosting(x, y, params["n_estimators"], params.get("learning_rate", 0.1), params["max_depth"],
                                                   least, second)))
            assert [r.probability for r in sorted(got, key=lambda r: r.id) if r.candidate == c] == pytest.approx(list(want), abs=1e-9)
        use = np.arange(120) % 3 != 0
        own = boosting.with_probability(df, ends, [m for m in models if m.fold == 0], NAMES, ["id"], by_fold=True).collect()
        assert sorted({r.id for r in own}) == list(range(0, 120, 3)) and len(own) == 80
        other = plain_boosting(x[use], y[use], 12, 0.3, 3, least, second)
        assert models[0].margins(boosting.binned([pa.array(x[use, 0]), pa.array(x[use, 1])], ends)) == pytest.approx(other, abs=1e-9)
        assert models[0].first(5).margins(np.zeros((1, 2), np.uint8)).shape == (1,)
        assert models[0].importances(2).sum() == pytest.approx(1)


def test_forest_keeps_each_rows_node(table):
    """The trees are those that MLlib grows by walking every tree again at each level."""
    from pyspark.ml.classification import RandomForestClassifier
    table = table[2]
    kept = classifiers.fit_forest(table, NAMES, "y", n_estimators=7, min_samples_split=4)
    walked = RandomForestClassifier(featuresCol=classifiers.FEATURES, labelCol="y", numTrees=7, maxDepth=30, minInstancesPerNode=2, seed=42) \
        .fit(classifiers.assemble(table, NAMES))
    assert kept.getCacheNodeIds() and not walked.getCacheNodeIds()
    assert kept.toDebugString.split("\n", 1)[1] == walked.toDebugString.split("\n", 1)[1]


@pytest.mark.parametrize("newton", [True, False])
def test_boosting_walks_no_tree_from_its_root(monkeypatch, newton):
    """A fit on one task's table goes down one level at a time, with the same trees to the last bit."""
    rng = np.random.default_rng(5)
    bins, y = rng.integers(0, 40, (900, 3)).astype(np.uint8), (rng.random(900) < 0.3).astype(float)
    bins[:500] = bins[0]  # most rows alike: paths that end early
    own = boosting.Settings(n_estimators=6, max_depth=4, min_child_weight=2, newton=newton)
    margin, want, walk = np.full(900, -0.5), [], boosting.leaves
    for _ in range(own.n_estimators):
        slopes, tree = boosting._slopes(margin, y), boosting.Tree(own.max_depth)
        for level in range(own.max_depth):
            place = tree.places(bins, level)
            use = place >= 0
            cell = ((place[use, None] * 3 + np.arange(3)) * boosting.BINS + bins[use]).ravel()
            sums = [np.bincount(cell, None if w is None else np.repeat(w[use], 3), 3 * boosting.BINS << level) for w in (None, *slopes)]
            tree.grow(level, np.stack(sums, -1).reshape(1 << level, 3, boosting.BINS, 3).astype(float), own)
        margin += tree.value[walk(bins, tree.feature, tree.cut)]
        want.append(tree)

    def refuse(*_):
        raise AssertionError("walked from the root")
    monkeypatch.setattr(boosting, "leaves", refuse)
    got = boosting._fit_here(bins, y, -0.5, own)
    for a, b in zip(got, want, strict=True):
        assert all((getattr(a, c) == getattr(b, c)).all() for c in ("feature", "cut", "value", "gain"))


@pytest.fixture(scope="module")
def lumpy(spark):
    """Few, many and skewed values, and a constant."""
    rng = np.random.default_rng(3)
    n = 1500
    a = np.where(rng.random(n) < 0.6, 2.0, rng.integers(0, 6, n))
    b, c = rng.normal(size=n).round(2), np.exp(2 * rng.normal(size=n)).round()
    y = (rng.random(n) < 1 / (1 + np.exp(1 - b - a / 4))).astype(int)
    rows = [(i, *map(float, x), 1.0, int(k), i % 3) for i, (*x, k) in enumerate(zip(a, b, c, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int, fold int").coalesce(1).cache()


WIDE = ["a", "b", "c", "d"]


@pytest.mark.parametrize("depth,least", [(None, 2), (None, 10), (5, 2)])
def test_cells_grow_the_tree_that_mllib_grows_on_rows(lumpy, depth, least, monkeypatch):
    """Without draws both are the same to the last bit: ends of bins, cuts, merged leaves and importances."""
    from pyspark.ml.classification import RandomForestClassifier
    want = RandomForestClassifier(featuresCol=classifiers.FEATURES, labelCol="y", numTrees=1, maxDepth=depth or 30, bootstrap=False,
                                  minInstancesPerNode=least // 2, featureSubsetStrategy="all").fit(classifiers.assemble(lumpy, WIDE))
    monkeypatch.setattr(forests, "MANY_ROWS", 0)
    rows = lumpy.repartition(5)
    ends, cells = forests._counted(forests._numeric(rows, WIDE, "y", F.lit(-2)), WIDE, (boosting.ALL_ROWS,))
    own = cells[boosting.ALL_ROWS]
    assert own.counts.sum() == 1500 and len(own.bins) < 1500 and len(ends[boosting.ALL_ROWS][3]) == 0
    tree, shares = forests.grow(own.bins, own.counts.astype(float), forests.Settings(1, depth, least), 4, np.random.default_rng(0))
    table = lumpy.orderBy("id").select(*WIDE).toArrow().combine_chunks()
    got = tree.chances(boosting.binned([c.chunk(0) for c in table.columns], ends[boosting.ALL_ROWS]))
    assert list(got) == [r.probability for r in classifiers.with_probability(want, lumpy, WIDE).orderBy("id").collect()]
    assert list(shares) == pytest.approx(list(want.featureImportances.toArray()), abs=1e-12)


def test_many_rows_take_no_forest_of_mllib(lumpy, monkeypatch):
    """Search, fit and prediction on cells: every row once, alike for any partitions, close to MLlib's forest."""
    plain = classifiers.fit_forest(lumpy, WIDE, "y", n_estimators=40)
    near = [r.probability for r in classifiers.with_probability(plain, lumpy, WIDE).orderBy("id").collect()]

    def refuse(*_, **__):
        raise AssertionError("rows through MLlib's trees")
    monkeypatch.setattr(classifiers, "RandomForestClassifier", refuse)
    monkeypatch.setattr(forests, "MANY_ROWS", 1000)
    model = classifiers.fit_forest(lumpy, WIDE, "y", n_estimators=40)
    scored = classifiers.with_probability(model, lumpy, WIDE)
    assert scored.columns == [*lumpy.columns, "probability"]
    got = [r.probability for r in scored.orderBy("id").collect()]
    assert len(got) == 1500 and np.corrcoef(got, near)[0, 1] > 0.97 and abs(np.mean(got) - np.mean(near)) < 0.01
    assert list(model.featureImportances.toArray()) == pytest.approx(list(plain.featureImportances.toArray()), abs=0.05)
    again = classifiers.fit_forest(lumpy.repartition(7), WIDE, "y", n_estimators=60)
    fewer = classifiers.first_trees(again, 40)
    monkeypatch.setattr(forests, "CELLS", 100)  # scored piece by piece
    assert fewer.getNumTrees == 40 and [r.probability for r in classifiers.with_probability(fewer, lumpy, WIDE).orderBy("id").collect()] == got
    monkeypatch.setattr(forests, "CELLS", 1 << 18)
    grid = {"n_estimators": [10, 30], "max_depth": [None, 3], "min_samples_split": [2, 5]}
    monkeypatch.setattr(forests, "MANY_ROWS", 1499)
    best, scores, pooled = selection.search_with_calls(lumpy.drop("fold"), classifiers.fit_forest, grid, WIDE, "y", "id", folds=3)
    assert scores.count() == 24 and best in selection.candidates(grid)
    assert pooled.count() == 1500 and pooled.select("id").distinct().count() == 1500
    calls = selection.out_of_fold(lumpy, 3, classifiers.fit_forest, [{"n_estimators": 10}, {"n_estimators": 40}], WIDE, "y", "id")
    held = [r.probability for r in calls.where("candidate = 1 and fold = 0").orderBy("id").collect()]
    monkeypatch.setattr(forests, "MANY_ROWS", 0)
    outside = classifiers.fit_forest(lumpy.where("fold <> 0"), WIDE, "y", n_estimators=40)
    assert held == [r.probability for r in classifiers.with_probability(outside, lumpy.where("fold = 0"), WIDE).orderBy("id").collect()]


def test_cells_are_for_whole_rows_of_two_classes(lumpy, monkeypatch):
    monkeypatch.setattr(forests, "MANY_ROWS", 0)
    model = forests.fit(lumpy, WIDE, "y", n_estimators=2)
    holes = lumpy.withColumn("b", F.when(F.col("id") != 7, F.col("b")))
    with pytest.raises(Exception, match="a feature is missing"):
        classifiers.with_probability(model, holes, WIDE).collect()
    three = lumpy.withColumn("y", F.when(F.col("id") == 7, 2).otherwise(F.col("y")))
    assert [forests.fit(df, WIDE, "y") for df in (holes, three, lumpy.where("y = 0"))] == [None] * 3
    monkeypatch.setattr(forests, "CELLS", 100)
    assert forests.fit(lumpy, WIDE, "y") is None


def test_boosting_takes_rows_alike_as_one(lumpy, monkeypatch):
    """The same trees from cells as from rows, for one fold and for all."""
    grid = [{"n_estimators": 8, "max_depth": 4}, {"n_estimators": 4, "max_depth": 3, "newton": True, "min_child_weight": 3}]
    names = ["a", "c", "d"]
    _, rows = boosting.fit_many(lumpy, names, "y", grid, (0, boosting.ALL_ROWS))
    sizes, fit = [], boosting._cells
    monkeypatch.setattr(boosting, "_cells", lambda *x: sizes.append((len(x[0]), len(fit(*x)[0]))) or fit(*x))
    monkeypatch.setattr(boosting, "MANY_ROWS", 1000)
    _, cells = boosting.fit_many(lumpy, names, "y", grid, (0, boosting.ALL_ROWS))
    assert sizes and 2 * sizes[0][1] < sizes[0][0] == 1500
    for a, b in zip(rows, cells, strict=True):
        assert (a.feature == b.feature).all() and (a.cut == b.cut).all() and np.abs(a.value - b.value).max() < 1e-12
