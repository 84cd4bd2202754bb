"""Splits, scaling and classifiers on customers and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from doseloom.models import boosting, classifiers, features, folds, newton, selection
from doseloom.operators import metrics, ranking
from doseloom.plans.storage import cut_lineage
from standins import fits, query
from standins import frames as f

LABEL = "quality"
COLUMNS = ("length", "lines", "digits")
FOLDS = 5


def rows(spark, sf):
    """Labelled documents with three plain features of the whole text."""
    docs = f.table(spark, sf, "documents").select(
        "doc_id", F.ln(F.col("n_chars") + 1.0).alias("length"),
        F.ln(F.size(F.split("text", "\n")) + 1.0).alias("lines"),
        F.ln(F.length(F.regexp_replace("text", "[^0-9]", "")) + 1.0).alias("digits"))
    return docs.join(f.table(spark, sf, "labels"), "doc_id").select("doc_id", *COLUMNS, LABEL)


_N = "n AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1)"


@query("stratified_split", f"""WITH {_N}, w AS (SELECT quality, n, n * 0.2 AS want, floor(n * 0.2) AS low FROM n),
r AS (SELECT *, row_number() OVER (ORDER BY want - low DESC, quality) AS place,
  ceil(sum(n) OVER () * 0.2) - sum(low) OVER () AS spare FROM w),
t AS (SELECT quality, n, cast(low + CASE WHEN place <= spare THEN 1 ELSE 0 END AS bigint) AS k FROM r)
SELECT quality, true AS is_test, k AS count FROM t UNION ALL SELECT quality, false, n - k FROM t""")
def stratified_split(spark, sf):
    split = folds.stratified_split(f.table(spark, sf, "labels").select("doc_id", LABEL), "doc_id", LABEL)
    return split.groupBy(LABEL, "is_test").agg(F.count(F.lit(1)).alias("count"))


@query("stratified_folds", f"""WITH {_N}
SELECT quality, cast(fold AS int) AS fold, (n - 1 - fold) // 5 + 1 AS count FROM n, range(5) t(fold)""")
def stratified_folds(spark, sf):
    dealt = folds.stratified_folds(f.table(spark, sf, "labels").select("doc_id", LABEL), "doc_id", LABEL)
    return dealt.groupBy(LABEL, "fold").agg(F.count(F.lit(1)).alias("count"))


_T = f"""{_N}, w AS (SELECT quality, n, n * 0.2 AS want, floor(n * 0.2) AS low FROM n),
k AS (SELECT quality, cast(low + CASE WHEN row_number() OVER (ORDER BY want - low DESC, quality)
  <= ceil(sum(n) OVER () * 0.2) - sum(low) OVER () THEN 1 ELSE 0 END AS bigint) AS n_test FROM w),
split AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {fits.ORDER}) <= n_test AS is_test
  FROM labels JOIN k USING (quality))"""
_FOLDED = f"""folded AS (SELECT doc_id, quality, cast((row_number() OVER (PARTITION BY quality ORDER BY {fits.ORDER}) - 1) % {FOLDS} AS int) AS fold
  FROM labels)"""


@query("split_members", f"WITH {_T} SELECT doc_id, quality, is_test FROM split")
def split_members(spark, sf):
    """Which rows are in the test part."""
    return folds.stratified_split(f.table(spark, sf, "labels").select("doc_id", LABEL), "doc_id", LABEL)


@query("fold_members", f"WITH {_FOLDED} SELECT doc_id, quality, fold FROM folded")
def fold_members(spark, sf):
    """Which rows are in which fold."""
    return folds.stratified_folds(f.table(spark, sf, "labels").select("doc_id", LABEL), "doc_id", LABEL)


@query("scaled_features", """SELECT c_custkey,
  round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal,
  round((total - avg(total) OVER ()) / stddev_pop(total) OVER (), 6) AS total
FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def scaled_features(spark, sf):
    total = f.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum("o_totalprice").alias("total"))
    both = f.table(spark, sf, "customer").select("c_custkey", "c_acctbal").join(total, "c_custkey")
    scaled = features.scale(both, features.scaling_facts(both, ["c_acctbal", "total"]))
    return scaled.withColumns({c: F.round(c, 6) for c in ("c_acctbal", "total")})


_Z = f"""{f.MERGED_SQL}, z AS (SELECT s, (score - avg(score) OVER ()) / stddev_samp(score) OVER () AS zscore, status
  FROM (SELECT s, score, status FROM merged))"""
_Z_FIT = f"""{_Z}, models AS (SELECT 0 AS model, 1.0 AS lam), design AS (SELECT 0 AS model, status AS y, 1.0 AS w, zscore FROM z),
{fits.newton(["zscore"])}"""
_Z_CALLS = f"{_Z_FIT}, calls AS (SELECT s, status, {fits.probability(['zscore'])} AS p FROM z, fitted)"


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _z_rows(spark, sf):
    merged = f.scored_phenotype(spark, sf)
    return cut_lineage(ranking.z_scores(merged, "score", "zscore").select("s", "zscore", "status"))


@query("logistic_odds_ratio", f"""WITH RECURSIVE {_Z_FIT}
SELECT 'zscore' AS feature, round(b1, 6) AS coefficient, round(exp(b1), 6) AS odds_ratio FROM fitted""")
def logistic_odds_ratio(spark, sf):
    """Odds ratio per standard deviation of the score."""
    data = _z_rows(spark, sf)
    return _rounded(classifiers.odds_ratios(newton.fit_one(data, ["zscore"], "status"), ["zscore"], data), "coefficient", "odds_ratio")


@query("logistic_tests", f"""WITH RECURSIVE {_Z_CALLS}, t AS (SELECT count(*) AS n, sum(status) AS cases,
  count(*) FILTER (WHERE (p > 0.5) = (status = 1)) AS correct, sum(ln(CASE WHEN status = 1 THEN p ELSE 1 - p END)) AS own FROM calls),
u AS (SELECT n, correct, 2 * (own - cases * ln(cases / n) - (n - cases) * ln(1 - cases / n)) AS lr FROM t)
SELECT n, round(correct / n, 6) AS accuracy, {fits.chi2_tail('correct::DOUBLE')} AS accuracy_chi2_tail,
  round(lr, 6) AS likelihood_ratio, round({fits.chi2_tail('lr')}, 9) AS likelihood_ratio_p FROM u""")
def logistic_tests(spark, sf):
    data = _z_rows(spark, sf)
    out = classifiers.model_tests(newton.fit_one(data, ["zscore"], "status"), data, ["zscore"], "status")
    return _rounded(out, "accuracy", "likelihood_ratio").withColumn("likelihood_ratio_p", F.round("likelihood_ratio_p", 9))


_AT = """SELECT rule, count(*) FILTER (WHERE status = 0 AND called = 0) AS tn, count(*) FILTER (WHERE status = 0 AND called = 1) AS fp,
  count(*) FILTER (WHERE status = 1 AND called = 0) AS fn, count(*) FILTER (WHERE status = 1 AND called = 1) AS tp FROM ruled GROUP BY rule"""


def _share(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} = 0 THEN 0.0 ELSE {top} * 1.0 / ({bottom}) END"


@query("logistic_metrics", f"""WITH RECURSIVE {_Z_CALLS}, points AS (SELECT p, sum(status) AS pos, sum(1 - status) AS neg FROM calls GROUP BY p),
run AS (SELECT p, sum(pos) OVER (ORDER BY p DESC) * sum(neg) OVER () - sum(neg) OVER (ORDER BY p DESC) * sum(pos) OVER () AS gain FROM points),
best AS (SELECT CASE WHEN gain > 0 THEN p ELSE 'Infinity'::DOUBLE END AS cut FROM run ORDER BY gain DESC, p DESC LIMIT 1),
ruled AS (SELECT 'youden' AS rule, status, cast(p >= cut AS int) AS called FROM calls, best
  UNION ALL SELECT 'half', status, cast(p > 0.5 AS int) FROM calls), k AS ({_AT})
SELECT rule, tn, fp, fn, tp, round({_share('(tp + tn)', 'tp + tn + fp + fn')}, 6) AS accuracy, round({_share('tp', 'tp + fp')}, 6) AS precision,
  round({_share('tp', 'tp + fn')}, 6) AS recall, round({_share('2 * tp', '2 * tp + fp + fn')}, 6) AS f1,
  round(({_share('tp', 'tp + fn')} + {_share('tn', 'tn + fp')}) / 2, 6) AS balanced_accuracy, round({_share('tn', 'tn + fp')}, 6) AS specificity,
  round({_share('tp', 'tp + fp')}, 6) AS ppv, round({_share('tn', 'tn + fn')}, 6) AS npv FROM k""")
def logistic_metrics(spark, sf):
    """Metrics at the Youden threshold and at 0.5 of one fitted model."""
    data = _z_rows(spark, sf)
    model = newton.fit_one(data, ["zscore"], "status")
    scored = data.withColumn("probability", classifiers.logistic_probability(model, ["zscore"]))
    cut = metrics.youden_threshold(scored, "status", "probability").select("threshold").scalar()
    both = metrics.label_above(scored, "probability", cut).withColumn("rule", F.lit("youden")).unionByName(
        scored.withColumn("called", F.when(F.col("probability") > 0.5, 1).otherwise(0))
        .withColumn("rule", F.lit("half")))
    return _rounded(metrics.threshold_metrics(both, "status", "called", ["rule"]), "accuracy", "precision", "recall", "f1",
                    "balanced_accuracy", "specificity", "ppv", "npv")


def _train_test(spark, sf):
    split = cut_lineage(folds.stratified_split(rows(spark, sf), "doc_id", LABEL))
    return split.where(~F.col("is_test")).drop("is_test"), split.where("is_test").drop("is_test")


_BALANCED = "CASE WHEN quality = 1 THEN n / (2.0 * n1) ELSE n / (2.0 * (n - n1)) END"
_REPORT = """r AS (SELECT count(*) FILTER (WHERE y = 0 AND c = 0) AS tn, count(*) FILTER (WHERE y = 0 AND c = 1) AS fp,
  count(*) FILTER (WHERE y = 1 AND c = 0) AS fn, count(*) FILTER (WHERE y = 1 AND c = 1) AS tp, count(*) AS n FROM calls),
s AS (SELECT *, coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0,
  coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) AS f0, coalesce(tp / nullif(tp + fp, 0), 0) AS p1,
  coalesce(tp / nullif(tp + fn, 0), 0) AS r1, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM r),
report AS (SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, tn + fp AS support FROM s
  UNION ALL SELECT '1', p1, r1, f1, tp + fn FROM s
  UNION ALL SELECT 'accuracy', (tp + tn) / n, (tp + tn) / n, (tp + tn) / n, n FROM s
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM s
  UNION ALL SELECT 'weighted avg', (p0 * (tn + fp) + p1 * (tp + fn)) / n, (r0 * (tn + fp) + r1 * (tp + fn)) / n,
    (f0 * (tn + fp) + f1 * (tp + fn)) / n, n FROM s)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report"""


@query("class_weighted", f"""WITH RECURSIVE {fits.ROWS}, {_T}, train AS (SELECT rows.*, count(*) OVER () AS n, sum(rows.quality) OVER () AS n1
  FROM rows JOIN split USING (doc_id) WHERE NOT is_test),
models AS (SELECT 0 AS model, 1.0 AS lam), design AS (SELECT 0 AS model, quality AS y, {_BALANCED} AS w, length, lines, digits FROM train),
{fits.newton(COLUMNS)}, calls AS (SELECT rows.quality AS y, cast({fits.probability(COLUMNS)} >= 0.5 AS int) AS c
  FROM rows JOIN split USING (doc_id), fitted WHERE is_test), {_REPORT}""")
def class_weighted(spark, sf):
    """Balanced logistic regression: report on the test part."""
    train, test = _train_test(spark, sf)
    model = newton.fit_one(train, COLUMNS, LABEL, class_weight="balanced")
    scored = test.withColumn("probability", classifiers.logistic_probability(model, COLUMNS))
    return _rounded(metrics.class_report(metrics.label_above(scored, "probability", 0.5), LABEL, "called"), "precision", "recall", "f1")


@query("coefficients", f"""WITH RECURSIVE {fits.ROWS}, weighed AS (SELECT *, count(*) OVER () AS n, sum(quality) OVER () AS n1 FROM rows),
models AS (SELECT 0 AS model, 1.0 AS lam), design AS (SELECT 0 AS model, quality AS y, {_BALANCED} AS w, length, lines, digits FROM weighed),
{fits.newton(COLUMNS)}, c AS (SELECT unnest(['length', 'lines', 'digits']) AS feature, unnest([b1, b2, b3]) AS coefficient FROM fitted)
SELECT feature, round(coefficient, 6) AS coefficient, cast(row_number() OVER (ORDER BY abs(coefficient) DESC, feature) AS int) AS place FROM c""")
def coefficients(spark, sf):
    """Coefficient bars: the largest size first."""
    data = cut_lineage(rows(spark, sf))
    fit = newton.fit_one(data, COLUMNS, LABEL, class_weight="balanced")
    bars = classifiers.importance_table(data, COLUMNS, coefficient=fit.coefficients)
    place = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.abs("coefficient")), "feature")  # a row for each feature
    return bars.withColumn("place", F.row_number().over(place)).withColumn("coefficient", F.round("coefficient", 6))


@query("importance")
def importance(spark, sf):
    """Coefficients and forest importances, largest coefficient first."""
    data = cut_lineage(rows(spark, sf))
    logistic = newton.fit_one(data, COLUMNS, LABEL, class_weight="balanced")
    forest = classifiers.fit_forest(data, COLUMNS, LABEL, n_estimators=100)
    return classifiers.importance_table(data, COLUMNS, coefficient=logistic.coefficients,
                                        importance=forest.featureImportances.toArray())


def _search_sql(options: str, scaled: bool) -> str:
    """Areas of every candidate and fold: fits on all other folds, calls on the fold itself."""
    x = [f"({c} - m_{c}) / s_{c}" if scaled else c for c in COLUMNS]
    columns = ", ".join(f"{e} AS {c}" for e, c in zip(x, COLUMNS))
    facts = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in COLUMNS)
    return f"""{fits.ROWS}, {_FOLDED}, dealt AS (SELECT rows.*, fold FROM rows JOIN folded USING (doc_id)),
options(candidate, lam, w1) AS ({options}),
train AS (SELECT k.fold, count(*) AS n, sum(quality) AS n1, {facts} FROM range({FOLDS}) k(fold) JOIN dealt d ON d.fold <> k.fold GROUP BY k.fold),
models AS (SELECT cast(candidate * {FOLDS} + fold AS int) AS model, candidate, fold, lam FROM options, train),
design AS (SELECT cast(candidate * {FOLDS} + t.fold AS int) AS model, quality AS y, CASE WHEN w1 IS NULL THEN {_BALANCED}
  WHEN quality = 1 THEN w1 ELSE 1.0 END AS w, {columns} FROM options, train t JOIN dealt d ON d.fold <> t.fold),
{fits.newton(COLUMNS)}, scored AS (SELECT candidate, fold, quality AS y, {fits.probability(COLUMNS)} AS p FROM (
  SELECT m.candidate, d.fold, d.quality, fitted.*, {columns} FROM dealt d JOIN train USING (fold) JOIN models m USING (fold) JOIN fitted USING (model))),
{fits.ranked("scored", "candidate, fold")}"""


@query("cv_scores", f"""WITH RECURSIVE {_search_sql("SELECT 0, 1.0, NULL::DOUBLE", False)}
SELECT count(*) AS folds, round(avg(roc_auc), 6) AS mean_auc, round(2 * stddev_pop(roc_auc), 6) AS spread FROM areas""")
def cv_scores(spark, sf):
    """Five-fold area of a balanced logistic regression."""
    out = selection.cross_validated_auc(rows(spark, sf), classifiers.fit_logistic,
                                        {"class_weight": "balanced"}, COLUMNS, LABEL, "doc_id", FOLDS)
    return _rounded(out, "mean_auc", "spread")


_OPTIONS = ", ".join(f"({i}, {1 / o['C']}, {'NULL' if o['class_weight'] == 'balanced' else float(o['class_weight'][1])})"
                     for i, o in enumerate(selection.candidates(selection.LOGISTIC_GRID)))


@query("logistic_grid", f"""WITH RECURSIVE {_search_sql(f"VALUES {_OPTIONS}", True)}
SELECT candidate, round(avg(roc_auc), 6) AS mean_auc, round(avg(average_precision), 6) AS mean_ap FROM areas GROUP BY candidate""")
def logistic_grid(spark, sf):
    """All 20 candidates over five folds: mean area and mean average precision."""
    _, scores = selection.search(rows(spark, sf), classifiers.fit_logistic, selection.LOGISTIC_GRID, COLUMNS,
                                 LABEL, "doc_id", folds=FOLDS, scale_inside=True)
    return _rounded(selection.grid_scores(scores), "mean_auc", "mean_ap")


_BOOSTED_TREES = {**selection.BOOSTED_TREE_GRID, "n_estimators": [selection.BOOSTED_TREE_ROUNDS],
                  **{k: [v] for k, v in selection.BOOSTED_TREE_REST.items()}}


def _tuned(data, fit, grid):
    best, _ = selection.search(data, fit, grid, COLUMNS, LABEL, "doc_id", folds=3)
    return best


@query("model_comparison")
def model_comparison(spark, sf):
    """Logistic, forest and boosting, tuned over three folds of the training part, on the test part."""
    train, test = _train_test(spark, sf)
    logistic = newton.fit_one(train, COLUMNS, LABEL)
    forest = classifiers.fit_forest(train.coalesce(1) if train.count() < 100_000 else train, COLUMNS, LABEL,
                                    **_tuned(train, classifiers.fit_forest, selection.FOREST_GRID))
    ends, boosted = boosting.fit_boosted(train, COLUMNS, LABEL, **_tuned(train, boosting.fit_boosted, selection.BOOSTING_GRID))
    parts = {"Logistic Regression": test.withColumn("probability", classifiers.logistic_probability(logistic, COLUMNS)),
             "Random Forest": classifiers.with_probability(forest, test, COLUMNS),
             "Gradient Boosting": boosting.with_probability(test, ends, [boosted], COLUMNS, [LABEL])}
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("model"), LABEL, "probability")
        out = part if out is None else out.unionByName(part)
    return selection.compare_models(out, LABEL)


@query("boosted_trees_grid")
def boosted_trees_grid(spark, sf):
    """All nine candidates over five folds, 200 rounds each."""
    _, scores = selection.search(rows(spark, sf), boosting.fit_boosted, _BOOSTED_TREES, COLUMNS, LABEL,
                                 "doc_id", folds=FOLDS)
    return selection.grid_scores(scores)


@query("pooled_fold_report")
def pooled_fold_report(spark, sf):
    """Out-of-fold calls of two tuned models, pooled over the folds."""
    data = rows(spark, sf)
    folded = selection.save_folds(data, "doc_id", LABEL, FOLDS)
    options = {"lr": (classifiers.fit_logistic, selection.LOGISTIC_GRID), "trees": (boosting.fit_boosted, _BOOSTED_TREES)}
    out = None
    for name, (fit, grid) in options.items():
        _, _, part = selection.search_with_calls(data, fit, grid, COLUMNS, LABEL, "doc_id", folds=FOLDS, scale_inside=True, folded=folded)
        part = part.withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    predicted = metrics.label_above(out, "probability", 0.5)
    return metrics.class_report(predicted, LABEL, "called", ["model"], ("No", "Yes"))
