"""Survey answers to numeric features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doseloom.functions.text import numeric_answer, question_feature


def latest_answers(answers: DataFrame, person: str = "person_id", question: str = "question",
                   at: str = "survey_datetime", answer: str = "answer",
                   tie_break: Sequence[str] = ()) -> DataFrame:
    """Latest non-null answer per person and question, in one aggregate.

    Equal times are settled by ``tie_break`` and then by the answer itself.
    """
    order = F.struct(at, *tie_break, answer)
    known = answers.where(F.col(answer).isNotNull())
    return known.groupBy(person, question).agg(F.max_by(F.col(answer), order).alias(answer))


def answer_distribution(answers: DataFrame, floor: int = 50, questions: Sequence[str] | None = None,
                        question: str = "question", answer: str = "answer") -> DataFrame:
    """Answer counts of the questions with at least ``floor`` answers."""
    rows = answers.where(F.col(answer).isNotNull())
    if questions is not None:
        rows = rows.where(F.col(question).isin(*questions))
    counts = rows.groupBy(question, answer).agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy(question).agg(F.sum("count").alias("total")).where(F.col("total") >= floor)
    return counts.join(totals, question)


def feature_rows(latest: DataFrame, values: DataFrame, numeric_question: str | None = None,
                 numeric_name: str = "pain", sentinels: Sequence[str] = (),
                 person: str = "person_id", question: str = "question", answer: str = "answer") -> DataFrame:
    """Long features (person, feature, value); unmapped answers have no value.

    ``values`` is (question, answer, value): the ordinal map as a table.
    """
    coded = values.select(F.col("question").alias(question), F.col("answer").alias(answer), "value")
    mapped = (latest.join(coded, [question, answer], "left")
              .where(F.col("value").isNotNull())
              .select(person, question_feature(F.col(question)).alias("feature"),
                      F.col("value").cast("double").alias("value")))
    if numeric_question is None:
        return mapped
    numbers = latest.where(F.col(question) == numeric_question).select(
        person, F.lit(numeric_name).alias("feature"),
        numeric_answer(F.col(answer), sentinels).alias("value"))
    return mapped.unionByName(numbers.where(F.col("value").isNotNull()))


def bad_numeric_answers(latest: DataFrame, numeric_question: str, sentinels: Sequence[str],
                        question: str = "question", answer: str = "answer") -> DataFrame:
    """How many answers are neither a number nor a sentinel."""
    text = F.col(answer)
    return latest.where((F.col(question) == numeric_question) & ~text.isin(*sentinels)
                        & text.try_cast("double").isNull()).agg(F.count(F.lit(1)).alias("bad_answers"))


def label_persons(cases: DataFrame, controls: DataFrame, person: str = "person_id",
                  into: str = "has_t1d") -> DataFrame:
    """One row per person; a person in both sets is a case."""
    rows = cases.select(person, F.lit(1).alias(into)).unionByName(
        controls.select(person, F.lit(0).alias(into)))
    return rows.where(F.col(person).isNotNull()).groupBy(person).agg(F.max(into).alias(into))


def feature_matrix(cases: DataFrame, controls: DataFrame, values: DataFrame, features: Sequence[str],
                   person: str = "person_id", label: str = "has_t1d", complete: bool = True,
                   numeric_question: str | None = None, numeric_name: str = "pain",
                   sentinels: Sequence[str] = (), at: str = "survey_datetime",
                   tie_break: Sequence[str] = ()) -> DataFrame:
    """One row per person: a column per feature and the label.

    Both answer sets are pooled (a person in both brings rows twice, which the
    latest answer ignores). ``complete`` drops persons missing any feature.
    """
    pooled = cases.unionByName(controls)
    latest = latest_answers(pooled, person, at=at, tie_break=tie_break)
    long = feature_rows(latest, values, numeric_question, numeric_name, sentinels, person)
    wide = long.groupBy(person).pivot("feature", list(features)).agg(F.first("value"))
    out = label_persons(cases, controls, person, label).join(wide, person, "left") \
        .select(person, *features, label)
    return out.na.drop("any") if complete else out


def case_feature_matrix(answers: DataFrame, cases: DataFrame, values: DataFrame, features: Sequence[str],
                        person: str = "person_id", label: str = "has_t1d", complete: bool = True,
                        numeric_question: str | None = None, numeric_name: str = "pain",
                        sentinels: Sequence[str] = (), at: str = "survey_datetime",
                        tie_break: Sequence[str] = ()) -> DataFrame:
    """The same matrix for everyone who answered, with one cohort of case ids deciding the label.

    The answers are not split into cases and controls: the label joins one row per person.
    """
    latest = latest_answers(answers, person, at=at, tie_break=tie_break)
    long = feature_rows(latest, values, numeric_question, numeric_name, sentinels, person)
    wide = long.groupBy(person).pivot("feature", list(features)).agg(F.first("value"))
    people = answers.select(person).where(F.col(person).isNotNull()).distinct()
    flags = cases.select(person, F.lit(1).alias(label)).where(F.col(person).isNotNull()).distinct()
    out = people.join(flags, person, "left").join(wide, person, "left") \
        .select(person, *features, F.coalesce(label, F.lit(0)).alias(label))
    return out.na.drop("any") if complete else out


def unpivot(matrix: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return matrix.unpivot(list(keep), list(features), "feature", "value")


# The ordinal answers of the seven mapped questions, lowest first,
# and the question answered with a number from 0 to 10.
ORDINAL_ANSWERS: Mapping[str, Sequence[str]] = {
    "Overall Health: General Health": ("Poor", "Fair", "Good", "Very Good", "Excellent"),
    "Overall Health: General Physical Health": ("Poor", "Fair", "Good", "Very Good", "Excellent"),
    "Overall Health: Everyday Activities": ("Not At All", "A Little", "Moderately", "Mostly", "Completely"),
    "Overall Health: Average Fatigue 7 Days": ("None", "Mild", "Moderate", "Severe", "Very Severe"),
    "Overall Health: Difficult Understand Info": ("Never", "Occasionally", "Sometimes", "Often", "Always"),
    "Disability: Walking Climbing": ("No", "Yes"),
    "Overall Health: Medical Form Confidence": (
        "Not At All", "A Little Bit", "Somewhat", "Quite A Bit", "Extremely"),
}
PAIN_QUESTION = "Overall Health: Average Pain 7 Days"
PAIN_SENTINELS = ("PMI: Skip", "No matching concept")
HEALTH_FEATURES = ("general_health", "general_physical_health", "everyday_activities",
                   "average_fatigue_7_days", "difficult_understand_info", "walking_climbing",
                   "medical_form_confidence", "pain")
# End of fixed values.


def ordinal_values(spark: SparkSession, scales: Mapping[str, Sequence[str]] = ORDINAL_ANSWERS) -> DataFrame:
    """(question, answer, value) rows: ``General Health: Poor`` is 0, and so on.

    Skipped and undisclosed answers are absent and so get no value.
    """
    rows = [(question, f"{question.split(': ')[-1]}: {answer}", float(i))
            for question, answers in scales.items() for i, answer in enumerate(answers)]
    return spark.createDataFrame(rows, "question string, answer string, value double")
