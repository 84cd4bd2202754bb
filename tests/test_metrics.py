import math

import numpy as np
import pytest

from doseloom.operators import association, chartdata, metrics


def brute_points(y, s):
    return [(t, sum(a for a, b in zip(y, s) if b >= t), sum(1 - a for a, b in zip(y, s) if b >= t))
            for t in sorted(set(s), reverse=True)]


def flat(points):
    return [x for t in sorted(points) for x in (t, *points[t])]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    y = (rng.random(600) < 0.3).astype(int)
    s = np.round(rng.normal(size=600) + y * 0.5, 1)
    return y.tolist(), s.tolist(), spark.createDataFrame(list(zip(y.tolist(), s.tolist())), "y int, s double")


def auc(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_and_average_precision(data):
    y, s, df = data
    row = metrics.ranking_metrics(df, "y", "s").first()
    assert row.roc_auc == pytest.approx(auc(y, s), abs=1e-12)
    last = want = 0.0
    for _, tp, fp in brute_points(y, s):
        want, last = want + (tp - last) / sum(y) * tp / (tp + fp), tp
    assert row.average_precision == pytest.approx(want, abs=1e-12)


def test_auc_properties(data):
    _, _, df = data
    base = metrics.ranking_metrics(df, "y", "s").first().roc_auc
    turned = metrics.ranking_metrics(df.selectExpr("y", "-s AS s"), "y", "s").first().roc_auc
    bent = metrics.ranking_metrics(df.selectExpr("y", "exp(s) AS s"), "y", "s").first().roc_auc
    parts = metrics.ranking_metrics(df.repartition(17), "y", "s").first().roc_auc
    assert turned == pytest.approx(1 - base) and bent == pytest.approx(base) and parts == base


def test_curves_and_youden(data):
    y, s, df = data
    want = {t: (fp / (len(y) - sum(y)), tp / sum(y)) for t, tp, fp in brute_points(y, s)}
    got = {r.threshold: (r.fpr, r.tpr) for r in metrics.roc_points(df, "y", "s").collect()}
    assert got.pop(float("inf")) == (0.0, 0.0)
    assert flat(got) == pytest.approx(flat(want))
    pr = {r.threshold: (r.precision, r.recall) for r in metrics.precision_recall_points(df, "y", "s").collect()}
    assert pr.pop(float("inf")) == (1.0, 0.0)
    assert flat(pr) == pytest.approx(flat({t: (tp / (tp + fp), tp / sum(y)) for t, tp, fp in brute_points(y, s)}))
    best = max(want, key=lambda t: (round(want[t][1] - want[t][0], 12), t))
    assert metrics.youden_threshold(df, "y", "s").first().threshold == best


def test_one_class_only(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.7)], "y int, s double")
    row = metrics.ranking_metrics(df, "y", "s").first()
    assert row.roc_auc is None and row.average_precision == 1.0
    assert {r.fpr for r in metrics.roc_points(df, "y", "s").where("threshold < 1").collect()} == {None}
    assert metrics.roc_points(df.where("s > 1"), "y", "s").count() == 0


def test_useless_score_has_infinite_threshold(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 1.0)], "y int, s double")
    row = metrics.youden_threshold(df, "y", "s").first()
    assert math.isinf(row.threshold) and (row.tpr, row.fpr) == (0.0, 0.0)


def test_threshold_metrics_and_zero_division(spark):
    df = spark.createDataFrame([(0, 0)] * 3 + [(1, 0)] * 2, "y int, p int")
    r = metrics.threshold_metrics(df, "y", "p").first()
    assert (r.tn, r.fp, r.fn, r.tp) == (3, 0, 2, 0)
    assert (r.accuracy, r.precision, r.recall, r.f1, r.ppv) == (0.6, 0.0, 0.0, 0.0, 0.0)
    assert (r.balanced_accuracy, r.specificity, r.npv) == (0.5, 1.0, 0.6)
    report = {x["class"]: x for x in metrics.class_report(df, "y", "p").collect()}
    assert report["0"].f1 == pytest.approx(0.75) and report["1"].support == 2
    assert report["macro avg"].recall == 0.5 and report["weighted avg"].precision == pytest.approx(0.36)


@pytest.fixture(scope="module")
def merged(spark):
    rows = [(f"p{i}", float(i), int(i >= 90 or i % 10 == 0)) for i in range(100)]
    return spark.createDataFrame(rows, "s string, score double, status int")


def test_tails(merged):
    r = association.tail_odds_ratio(merged, "score", "status").first()
    assert (r.bottom_count, r.bottom_cases, r.top_count, r.top_cases) == (5, 1, 5, 5)
    assert r.odds_ratio is None and r.top_odds is None  # only cases at the top
    groups = {g.group_label: g for g in association.tail_groups(merged, "score", "status").collect()}
    assert groups["Top 5%"].case_label == "Cases=5" and groups["Bottom 5%"].prevalence == 20.0


def test_prevalence_and_totals(merged, spark):
    rows = association.prevalence_by_bin(merged, "score", "status", 10, association.DECILE_LABELS, True).collect()
    by = {r.label: (r["count"], r.prevalence) for r in rows}
    assert by["D1"] == (10, 10.0) and by["D10"] == (10, 100.0) and sum(c for c, _ in by.values()) == 100
    t = association.cohort_totals(merged, "status").first()
    assert (t.participants, t.cases, t.prevalence_percent) == (100, 19, 19.0)
    none = association.cohort_totals(merged.where("false"), "status").first()
    assert (none.participants, none.cases, none.prevalence_percent) == (0, 0, None)
    flag = spark.createDataFrame([("p1", 1)], "s string, status int")
    scores = merged.select("s", "score")
    assert association.merge_phenotype(scores, flag).count() == 1
    assert association.merge_phenotype(scores, flag, keep_unrecorded=True).where("status = 0").count() == 99


def test_density_integrates_to_one_and_is_exact(data):
    _, s, df = data
    rows = chartdata.density(df, "s").orderBy("point").collect()
    x, d = np.array([r.x for r in rows]), np.array([r.density for r in rows])
    h = np.std(s, ddof=1) * len(s) ** -0.2
    want = np.exp(-0.5 * ((x[:, None] - np.array(s)) / h) ** 2).sum(1) / (len(s) * h * math.sqrt(2 * math.pi))
    assert d == pytest.approx(want) and np.trapezoid(d, x) == pytest.approx(1, abs=0.01)


def test_density_of_values_that_do_not_differ_has_no_rows(spark):
    for rows in ([], [(1.0,)], [(2.0,), (2.0,), (None,)]):
        assert chartdata.density(spark.createDataFrame(rows, "x double"), "x").count() == 0


def test_density_makes_no_row_per_value_and_point(data):
    plan = chartdata.density(data[2], "s")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("MapInArrow")


def test_histogram_is_numpy(data):
    _, s, df = data
    want, edges = np.histogram(s, bins=50)
    got = {r.bin: (r["count"], r.left_edge) for r in chartdata.histogram(df, "s").collect()}
    assert [got[i][0] for i in range(50)] == want.tolist()
    assert all(got[i][1] == pytest.approx(edges[i]) for i in got)


def test_constant_histogram(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "s double")
    assert [(r.bin, r["count"]) for r in chartdata.histogram(df, "s").orderBy("bin").collect()] == [(0, 5)] + [(i, 0) for i in range(1, 50)]
