import datetime

import pytest

from doseloom.operators import cohort, hierarchy
from doseloom.plans import workflows
from doseloom.sources import readers, schemas


def below(paths, roots):
    """Concepts whose dotted path goes through one of the root ids."""
    return {concept for concept, path in paths if set(path.split(".")) & {str(r) for r in roots}}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    day, root = datetime.date(2020, 1, 1), tmp_path_factory.mktemp("warehouse")
    criteria = [  # id, concept, domain, type, subtype, path, text, standard, selectable
        (2, 201254, "CONDITION", "X", "X", "1.2", "[x_rank1]y", 1, 1), (3, 55, "CONDITION", "X", "X", "1.2.3", "", 1, 1),
        (12, 66, "CONDITION", "X", "X", "1.12.5", "", 1, 1), (4, 77, "CONDITION", "X", "X", "1.2.4", "", 1, 0),
        (20, 1585710, "SURVEY", "PPI", "SURVEY", "20", "", 0, 1), (21, 901, "SURVEY", "PPI", "QUESTION", "20.21", "", 0, 1),
        (22, 902, "SURVEY", "PPI", "QUESTION", "120.22", "", 0, 1), (23, 903, "SURVEY", "PPI", "ANSWER", "20.21.23", "", 0, 1),
        (24, 904, "SURVEY", "PPI", "QUESTION", "9.24", "", 0, 1)]
    events = [(1, day, 201254, 1, None), (1, day, 201254, 1, None), (2, day, 55, 1, None), (3, day, 66, 1, None),
              (4, day, 77, 1, None), (5, day, 836799, 0, 43529923), (6, day, 836799, 0, 1), (7, day, 55, 0, None),
              (8, day, 201254, 1, None)]
    search = [(i, i % 2, 1) for i in range(1, 8)]
    data = {"person": ([(i, i, None, 8, 8, None) for i in range(1, 9)], schemas.PERSON),
            "concept": ([(1, "one"), (8, "eight")], schemas.CONCEPT),
            "cb_search_person": (search, schemas.SEARCH_PERSON), "cb_search_all_events": (events, schemas.SEARCH_EVENTS),
            "cb_criteria": (criteria, schemas.CRITERIA),
            "condition_occurrence": ([(1, "E10.1"), (1, "Z"), (2, "E10.11"), (3, "250.01")], schemas.CONDITIONS),
            "ds_survey": ([], schemas.SURVEY)}
    for name, (rows, schema) in data.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}")
    return readers.warehouse(spark, str(root))


def test_case_cohort_is_the_walk(tables):
    """Type 1 diabetes by a standard concept below the rank-1 node, or by the source code of the survey answer."""
    criteria, events = tables["cb_criteria"].collect(), tables["cb_search_all_events"].collect()
    roots = [c.id for c in criteria if c.concept_id == 201254 and "_rank1]" in c.full_text]
    concepts = below([(c.concept_id, c.path) for c in criteria if c.is_standard and c.is_selectable], roots)
    diagnosed = {e.person_id for e in events if e.is_standard and e.concept_id in concepts}
    answered = {e.person_id for e in events
                if not e.is_standard and (e.concept_id, e.value_source_concept_id) == (836799, 43529923)}
    searchable = {r.person_id for r in tables["cb_search_person"].collect()}
    got = sorted(r.person_id for r in workflows.case_persons(tables, workflows.TYPE1_DIABETES_SURVEY).collect())
    assert got == sorted((diagnosed | answered) & searchable) == [1, 2, 5]


def test_questions_are_the_walk(tables):
    """Questions whose path holds a survey's id and a dot as text: 120.22 is met by 20 as well."""
    surveys = workflows.TYPE1_DIABETES_SURVEY.surveys
    criteria = tables["cb_criteria"].collect()
    marks = [f"{c.id}." for c in criteria if c.domain_id == "SURVEY" and c.concept_id in surveys]
    questions = sorted(c.concept_id for c in criteria if (c.domain_id, c.type, c.subtype) == ("SURVEY", "PPI", "QUESTION")
                       and any(m in c.path for m in marks))
    got = sorted(r.concept_id for r in hierarchy.survey_questions(tables["cb_criteria"], surveys).collect())
    assert got == questions == [901, 902]


def test_no_nested_loop_in_path_tests(tables):
    criteria = tables["cb_criteria"]
    for found in (hierarchy.by_path_element(criteria, criteria), hierarchy.by_path_substring(criteria, criteria)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_path_tests_differ(spark):
    nodes = spark.createDataFrame([("1.2.3",), ("1.12.5",), ("2",)], "path string")
    ids = spark.createDataFrame([(2,)], "id long")
    assert sorted(r.path for r in hierarchy.by_path_element(nodes, ids).collect()) == ["1.2.3", "2"]
    assert sorted(r.path for r in hierarchy.by_path_substring(nodes, ids).collect()) == ["1.12.5", "1.2.3"]


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("ids", [[], [1, 2], [1, None]])
def test_not_in_is_sql(spark, ids, hot):
    left = spark.createDataFrame([(1,), (3,), (3,), (None,)], "k int")
    right = spark.createDataFrame([(i,) for i in ids], "k int")
    left.createOrReplaceTempView("not_in_left")
    right.createOrReplaceTempView("not_in_right")
    want = spark.sql("SELECT k FROM not_in_left WHERE k NOT IN (SELECT k FROM not_in_right)").collect()
    got = cohort.not_in(left, right, "k", hot=hot)
    assert sorted(got.collect(), key=str) == sorted(want, key=str)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_cohort_labels_and_flags(tables):
    both = cohort.genome_and_records_cohort(tables["person"], tables["cb_search_person"])
    assert sorted(r.person_id for r in both.collect()) == [1, 3, 5, 7]
    rows = {r.person_id: r for r in cohort.person_labels(tables["person"], tables["concept"]).collect()}
    assert len(rows) == 8 and rows[1].gender == "one" and rows[2].gender is None and rows[2].race == "eight"
    flags = cohort.phenotype_flag(tables["condition_occurrence"], "person_id", "condition_source_value",
                                  cohort.TYPE1_DIABETES_CODES)
    assert {r.s: r.status for r in flags.collect()} == {1: 1, 2: 0, 3: 1}


def test_sizes_skip_null_persons(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "person_id int")
    row = cohort.cohort_sizes({"a": df}).first()
    assert (row.cohort, row.n_rows, row.n_persons) == ("a", 3, 1)


def test_skewed_key_is_split(spark, tmp_path):
    """A key with most rows is split over tasks although the ids were grouped."""
    from pyspark.sql import functions as F
    spark.range(400_000).select(F.when(F.col("id") % 10 < 7, 5).otherwise(F.col("id") % 997).alias("k"), "id") \
        .write.parquet(str(tmp_path / "rows"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB"}
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.read.parquet(str(tmp_path / "rows")).repartition(8)
        ids = spark.range(500).withColumnRenamed("id", "k").distinct()
        kept = cohort.keep_ids(rows, ids, "k", hot=True)
        assert kept.count() == cohort.keep_ids(rows, ids, "k").count()
        kept.collect()
        assert "skew=true" in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
