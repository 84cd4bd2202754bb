"""Curves and classification metrics: document length against two labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from doseloom.operators import metrics
from standins import frames as f
from standins import query

_CURVE = f"""{f.LABELLED_SQL}, c AS (
  SELECT cast(n_chars AS double) AS threshold, sum(quality) AS pos, sum(1 - quality) AS neg FROM labelled GROUP BY 1),
run AS (SELECT *, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp,
  sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM c)"""


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("roc_curve", f"""WITH {_CURVE}
SELECT threshold, round(fp * 1.0 / an, 6) AS fpr, round(tp * 1.0 / ap, 6) AS tpr FROM run
UNION ALL SELECT 'Infinity'::double, 0.0, 0.0""")
def roc_curve(spark, sf):
    return _rounded(metrics.roc_points(f.labelled(spark, sf), "quality", "n_chars"), "fpr", "tpr")


@query("pr_curve", f"""WITH {_CURVE}
SELECT threshold, round(tp * 1.0 / (tp + fp), 6) AS precision, round(tp * 1.0 / ap, 6) AS recall FROM run
UNION ALL SELECT 'Infinity'::double, 1.0, 0.0""")
def pr_curve(spark, sf):
    return _rounded(metrics.precision_recall_points(f.labelled(spark, sf), "quality", "n_chars"),
                    "precision", "recall")


def _models(spark, sf):
    """Two label columns as two models of the same score."""
    rows = f.labelled(spark, sf)
    return rows.select(F.lit("quality").alias("model"), F.col("quality").alias("y"), "n_chars").unionByName(
        rows.select(F.lit("toxic").alias("model"), F.col("toxic").alias("y"), "n_chars"))


_MODELS_SQL = f"""{f.LABELLED_SQL}, m AS (SELECT 'quality' AS model, quality AS y, n_chars FROM labelled
  UNION ALL SELECT 'toxic', toxic, n_chars FROM labelled)"""


_BY_MODEL = f"""WITH {_MODELS_SQL}, c AS (
  SELECT model, cast(n_chars AS double) AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM m GROUP BY 1, 2),
run AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS ap,
  sum(neg) OVER (PARTITION BY model) AS an FROM c WINDOW w AS (PARTITION BY model ORDER BY threshold DESC))"""


@query("roc_curves_by_model", f"""{_BY_MODEL}
SELECT model, threshold, round(fp * 1.0 / an, 6) AS fpr, round(tp * 1.0 / ap, 6) AS tpr FROM run
UNION ALL SELECT DISTINCT model, 'Infinity'::double, 0.0, 0.0 FROM m""")
def roc_curves_by_model(spark, sf):
    return _rounded(metrics.roc_points(_models(spark, sf), "y", "n_chars", ["model"]), "fpr", "tpr")


@query("pr_curves_by_model", f"""{_BY_MODEL}
SELECT model, threshold, round(tp * 1.0 / (tp + fp), 6) AS precision, round(tp * 1.0 / ap, 6) AS recall FROM run
UNION ALL SELECT DISTINCT model, 'Infinity'::double, 1.0, 0.0 FROM m""")
def pr_curves_by_model(spark, sf):
    return _rounded(metrics.precision_recall_points(_models(spark, sf), "y", "n_chars", ["model"]), "precision", "recall")


@query("roc_auc", f"""WITH {_MODELS_SQL}, r AS (
  SELECT model, y, rank() OVER (PARTITION BY model ORDER BY n_chars)
    + (count(*) OVER (PARTITION BY model, n_chars) - 1) / 2.0 AS rk FROM m),
s AS (SELECT model, sum(CASE WHEN y = 1 THEN rk END) AS rs, cast(sum(y) AS bigint) AS n_pos,
  cast(sum(1 - y) AS bigint) AS n_neg FROM r GROUP BY 1)
SELECT model, n_pos, n_neg, round((rs - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 6) AS roc_auc FROM s""")
def roc_auc(spark, sf):
    out = metrics.ranking_metrics(_models(spark, sf), "y", "n_chars", ["model"])
    return _rounded(out, "roc_auc").drop("average_precision")


@query("average_precision", f"""WITH {_MODELS_SQL}, c AS (
  SELECT model, n_chars, sum(y) AS pos, count(*) AS n FROM m GROUP BY 1, 2),
run AS (SELECT model, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS pp, sum(pos) OVER (PARTITION BY model) AS ap
  FROM c WINDOW w AS (PARTITION BY model ORDER BY n_chars DESC))
SELECT model, round(sum(pos * 1.0 / ap * tp / pp), 6) AS average_precision FROM run GROUP BY 1""")
def average_precision(spark, sf):
    out = metrics.ranking_metrics(_models(spark, sf), "y", "n_chars", ["model"])
    return _rounded(out, "average_precision").select("model", "average_precision")


_BEST = f"""{_CURVE}, best AS (SELECT threshold, tp, fp, ap, an FROM run
  ORDER BY tp * an - fp * ap DESC, threshold DESC LIMIT 1)"""


@query("youden", f"""WITH {_BEST}
SELECT threshold, round(tp * 1.0 / ap, 6) AS tpr, round(fp * 1.0 / an, 6) AS fpr FROM best""")
def youden(spark, sf):
    return _rounded(metrics.youden_threshold(f.labelled(spark, sf), "quality", "n_chars"), "tpr", "fpr")


def _predicted(spark, sf):
    rows = f.labelled(spark, sf)
    cut = metrics.youden_threshold(rows, "quality", "n_chars").select("threshold").scalar()
    return metrics.label_above(rows, "n_chars", cut)


_COUNTS = f"""{_BEST}, k AS (SELECT
  count(*) FILTER (WHERE quality = 0 AND n_chars < threshold) AS tn,
  count(*) FILTER (WHERE quality = 0 AND n_chars >= threshold) AS fp,
  count(*) FILTER (WHERE quality = 1 AND n_chars < threshold) AS fn,
  count(*) FILTER (WHERE quality = 1 AND n_chars >= threshold) AS tp FROM labelled, (SELECT threshold FROM best))"""


@query("predicted_labels", f"""WITH {_BEST}
SELECT doc_id, cast(n_chars >= threshold AS int) AS called FROM labelled, (SELECT threshold FROM best)""")
def predicted_labels(spark, sf):
    return _predicted(spark, sf).select("doc_id", "called")


@query("confusion", f"WITH {_COUNTS} SELECT tn, fp, fn, tp FROM k")
def confusion(spark, sf):
    return metrics.confusion(_predicted(spark, sf), "quality", "called")


@query("threshold_metrics", f"""WITH {_COUNTS} SELECT tn, fp, fn, tp,
  round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(tn / (tn + fp), 6) AS specificity,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS ppv, round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS npv FROM k""")
def threshold_metrics(spark, sf):
    out = metrics.threshold_metrics(_predicted(spark, sf), "quality", "called")
    return _rounded(out, *out.columns[4:])


@query("class_report", f"""WITH {_COUNTS}, p AS (SELECT *, tn + fp AS s0, tp + fn AS s1, tn + fp + fn + tp AS n,
  coalesce(tn / nullif(tn + fn, 0), 0) AS p0, tn / (tn + fp) AS r0, 2 * tn / (2 * tn + fp + fn) AS f0,
  coalesce(tp / nullif(tp + fp, 0), 0) AS p1, tp / (tp + fn) AS r1, 2 * tp / (2 * tp + fp + fn) AS f1 FROM k),
u AS (SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM p
  UNION ALL SELECT '1', p1, r1, f1, s1 FROM p
  UNION ALL SELECT 'accuracy', (tp + tn) / n, (tp + tn) / n, (tp + tn) / n, n FROM p
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM p
  UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n FROM p)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM u""")
def class_report(spark, sf):
    return _rounded(metrics.class_report(_predicted(spark, sf), "quality", "called"),
                    "precision", "recall", "f1")
