"""Events as survey answers: latest answers, distributions, feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from doseloom.models import features
from doseloom.operators import cohort, survey
from standins import fits, query
from standins import frames as f

_LATEST = f"""{f.ANSWERS_SQL}, latest AS (
  SELECT person_id, question, arg_max(answer, (survey_datetime, event_id)) AS answer
  FROM answers WHERE answer IS NOT NULL GROUP BY 1, 2)"""


@query("latest_answer", f"WITH {_LATEST} SELECT * FROM latest")
def latest_answer(spark, sf):
    return survey.latest_answers(f.answers(spark, sf), tie_break=["event_id"])


@query("answer_distribution", f"""WITH {f.ANSWERS_SQL}, c AS (
  SELECT question, answer, count(*) AS count FROM answers WHERE answer IS NOT NULL GROUP BY 1, 2)
SELECT question, answer, count, cast(sum(count) OVER (PARTITION BY question) AS bigint) AS total
FROM c QUALIFY sum(count) OVER (PARTITION BY question) >= 50""")
def answer_distribution(spark, sf):
    return survey.answer_distribution(f.answers(spark, sf), 50)


@query("question_features", f"""WITH {_LATEST}
SELECT person_id, lower(replace(split_part(question, ': ', 2), ' ', '_')) AS feature,
  CASE answer WHEN 'Low' THEN 0.0 WHEN 'Middle' THEN 1.0 WHEN 'High' THEN 2.0 END::double AS value
FROM latest WHERE answer <> 'Skip' AND question <> 'Visit: Purchase'""")
def question_features(spark, sf):
    latest = survey.latest_answers(f.answers(spark, sf), tie_break=["event_id"])
    return survey.feature_rows(latest, f.answer_values(spark))


def _case_ids(spark, sf):
    """Cases: users with an error worth more than 30."""
    events = f.table(spark, sf, "events")
    return events.where((F.col("event_type") == "error") & (F.col("value") > 60)) \
        .select(F.col("user_id").alias("person_id")).distinct()


_CASES_SQL = "cases AS (SELECT DISTINCT user_id AS person_id FROM events WHERE event_type = 'error' AND value > 60)"


def _numeric_answers(spark, sf):
    """Answers plus the purchase question answered with a number, a sentinel or text."""
    rows = f.answers(spark, sf)
    number = (F.when(F.col("value") < 2, "No matching concept").when(F.col("value") > 150, "a lot")
              .otherwise(F.floor("value").cast("string")))
    is_number = F.col("question") == "Visit: Purchase"
    return rows.withColumn("answer", F.when(is_number, number).otherwise(F.col("answer")))


_NUMERIC_SQL = f"""{f.ANSWERS_SQL}, numeric_answers AS (
  SELECT * REPLACE (CASE WHEN question <> 'Visit: Purchase' THEN answer WHEN value < 2 THEN 'No matching concept'
    WHEN value > 150 THEN 'a lot' ELSE cast(cast(floor(value) AS bigint) AS varchar) END AS answer) FROM answers),
latest AS (SELECT person_id, question, arg_max(answer, (survey_datetime, event_id)) AS answer
  FROM numeric_answers WHERE answer IS NOT NULL GROUP BY 1, 2)"""

_MATRIX_SQL = f"""{_NUMERIC_SQL}, {_CASES_SQL}, coded AS (
  SELECT person_id, question, CASE answer WHEN 'Low' THEN 0.0 WHEN 'Middle' THEN 1.0 WHEN 'High' THEN 2.0 END::double AS v,
         CASE WHEN question = 'Visit: Purchase' THEN try_cast(answer AS double) END AS number FROM latest),
matrix AS (SELECT p.person_id, max(v) FILTER (WHERE question = 'Visit: Click') AS click,
  max(v) FILTER (WHERE question = 'Visit: Error') AS error, max(v) FILTER (WHERE question = 'Visit: View') AS "view",
  max(v) FILTER (WHERE question = 'Visit: Signup') AS signup, max(number) AS amount,
  cast(max(CASE WHEN c.person_id IS NOT NULL THEN 1 ELSE 0 END) AS int) AS has_t1d
  FROM (SELECT DISTINCT person_id FROM answers) p LEFT JOIN coded USING (person_id)
  LEFT JOIN cases c ON c.person_id = p.person_id GROUP BY 1)"""
FEATURES = [*f.ANSWER_FEATURES, "amount"]


def matrix(spark, sf, complete: bool = True):
    answers = _numeric_answers(spark, sf)
    ids = _case_ids(spark, sf)
    return survey.case_feature_matrix(
        answers, ids, f.answer_values(spark), FEATURES, complete=complete, numeric_question="Visit: Purchase",
        numeric_name="amount", sentinels=("Skip", "No matching concept"), tie_break=["event_id"])


@query("feature_matrix_all", f"WITH {_MATRIX_SQL} SELECT * FROM matrix")
def feature_matrix_all(spark, sf):
    return matrix(spark, sf, complete=False)


@query("feature_matrix", f"""WITH {_MATRIX_SQL} SELECT * FROM matrix WHERE click IS NOT NULL
  AND error IS NOT NULL AND "view" IS NOT NULL AND signup IS NOT NULL AND amount IS NOT NULL""")
def feature_matrix(spark, sf):
    return matrix(spark, sf)


@query("bad_numeric_answers", f"""WITH {_NUMERIC_SQL} SELECT count(*) AS bad_answers FROM latest
WHERE question = 'Visit: Purchase' AND answer NOT IN ('Skip', 'No matching concept') AND try_cast(answer AS double) IS NULL""")
def bad_numeric_answers(spark, sf):
    latest = survey.latest_answers(_numeric_answers(spark, sf), tie_break=["event_id"])
    return survey.bad_numeric_answers(latest, "Visit: Purchase", ("Skip", "No matching concept"))


@query("label_persons", f"""WITH {_CASES_SQL}
SELECT user_id AS person_id, cast(max(CASE WHEN c.person_id IS NOT NULL THEN 1 ELSE 0 END) AS int) AS has_t1d
FROM events LEFT JOIN cases c ON c.person_id = user_id GROUP BY 1""")
def label_persons(spark, sf):
    """Cases also stand among the controls here; the case label wins."""
    everyone = f.table(spark, sf, "events").select(F.col("user_id").alias("person_id"))
    return survey.label_persons(_case_ids(spark, sf), everyone)


@query("class_balance", f"""WITH {_MATRIX_SQL} SELECT has_t1d, count(*) AS count FROM matrix WHERE click IS NOT NULL
  AND error IS NOT NULL AND "view" IS NOT NULL AND signup IS NOT NULL AND amount IS NOT NULL GROUP BY 1""")
def class_balance(spark, sf):
    from doseloom.operators.ranking import value_counts
    return value_counts(matrix(spark, sf), "has_t1d")


_EFFECT_COLUMNS = ("acctbal", "total", "orders")


def _effect_rows(spark, sf):
    per = f.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).cast("double").alias("orders"))
    customer = f.table(spark, sf, "customer")
    return customer.join(per, "c_custkey").select(
        "c_custkey", F.col("c_acctbal").alias("acctbal"), "total", "orders",
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"))


_EFFECT_SQL = """e AS (SELECT c_custkey, c_acctbal AS acctbal, total, orders, cast(c_mktsegment = 'BUILDING' AS int) AS y
  FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS total, cast(count(*) AS double) AS orders
    FROM orders GROUP BY 1) ON o_custkey = c_custkey),
l AS (SELECT y, 'acctbal' AS feature, acctbal AS v FROM e UNION ALL SELECT y, 'total', total FROM e
  UNION ALL SELECT y, 'orders', orders FROM e),
g AS (SELECT feature, count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0,
  avg(v) FILTER (WHERE y = 1) AS mean1, avg(v) FILTER (WHERE y = 0) AS mean0,
  var_samp(v) FILTER (WHERE y = 1) AS var1, var_samp(v) FILTER (WHERE y = 0) AS var0 FROM l GROUP BY 1)"""


@query("feature_effect", f"""WITH {_EFFECT_SQL}
SELECT feature, n1, n0, round(mean1, 4) AS mean1, round(mean0, 4) AS mean0,
  round((mean1 - mean0) / sqrt(((n1 - 1) * var1 + (n0 - 1) * var0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)), 6) AS t_stat,
  cast(n1 + n0 - 2 AS double) AS degrees,
  round((mean1 - mean0) / sqrt((var1 + var0) / 2), 6) AS cohens_d FROM g""")
def feature_effect(spark, sf):
    out = features.feature_effects(_effect_rows(spark, sf), _EFFECT_COLUMNS, "y")
    return out.select("feature", "n1", "n0", F.round("mean1", 4).alias("mean1"), F.round("mean0", 4).alias("mean0"),
                      F.round("t_stat", 6).alias("t_stat"), "degrees", F.round("cohens_d", 6).alias("cohens_d"))


@query("feature_p_values", f"""WITH {_EFFECT_SQL}, t AS (SELECT *, cast(n1 + n0 - 2 AS double) AS degrees,
  (mean1 - mean0) / sqrt(((n1 - 1) * var1 + (n0 - 1) * var0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)) AS t_stat FROM g)
SELECT feature, round(t_stat, 6) AS t_stat, degrees, round({fits.t_tail('t_stat', 'degrees')}, 9) AS p_value FROM t""")
def feature_p_values(spark, sf):
    out = features.with_p_values(features.feature_effects(_effect_rows(spark, sf), _EFFECT_COLUMNS, "y"))
    return out.select("feature", F.round("t_stat", 6).alias("t_stat"), "degrees", F.round("p_value", 9).alias("p_value"))
