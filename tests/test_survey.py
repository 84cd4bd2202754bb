import glob
import datetime

import pytest
from pyspark.sql import functions as F

from doseloom.functions.text import question_feature
from doseloom.operators import cohort, incidence, survey
from doseloom.sources import readers, writers

T = [datetime.datetime(2020, 1, d) for d in range(1, 6)]
HEALTH, PAIN = "Overall Health: General Health", survey.PAIN_QUESTION


def answers(spark, rows):
    return spark.createDataFrame(rows, "person_id long, question string, survey_datetime timestamp, "
                                       "answer string, answer_concept_id long")


def test_latest_answer(spark):
    df = answers(spark, [(1, "q", T[0], "old", 1), (1, "q", T[1], "new", 1), (2, "q", T[0], "kept", 1),
                         (2, "q", T[3], None, 1), (3, "q", T[0], "a", 1), (3, "q", T[0], "b", 2), (4, "q", T[0], None, 1)])
    got = {r.person_id: r.answer for r in survey.latest_answers(df, tie_break=["answer_concept_id"]).collect()}
    assert got == {1: "new", 2: "kept", 3: "b"}


def test_distribution_floor(spark):
    df = answers(spark, [(i, "often", T[0], "ab"[i % 2], 1) for i in range(50)]
                 + [(i, "rare", T[0], "a", 1) for i in range(49)])
    rows = survey.answer_distribution(df, 50).collect()
    assert {(r.question, r.answer, r["count"], r.total) for r in rows} == {("often", "a", 25, 50), ("often", "b", 25, 50)}
    assert survey.answer_distribution(df, 1, ["rare"]).count() == 1


def test_ordinal_map_and_names(spark):
    values = survey.ordinal_values(spark)
    assert values.count() == 5 * 6 + 2
    got = {(r.question, r.answer): r.value for r in values.collect()}
    assert got[(HEALTH, "General Health: Excellent")] == 4.0
    assert got[("Disability: Walking Climbing", "Walking Climbing: Yes")] == 1.0
    assert got[("Overall Health: Medical Form Confidence", "Medical Form Confidence: A Little Bit")] == 1.0
    names = [r[0] for r in values.select(question_feature(F.col("question"))).distinct().collect()]
    assert set(names) | {"pain"} == set(survey.HEALTH_FEATURES)


def test_feature_matrix(spark):
    def full(person, health, pain):
        rows = [(person, q, T[0], f"{q.split(': ')[-1]}: {scale[0]}", 1) for q, scale in survey.ORDINAL_ANSWERS.items()]
        return [*rows, (person, HEALTH, T[1], health, 1), (person, PAIN, T[0], pain, 1)]

    rows = (full(1, "General Health: Good", "7") + full(2, "PMI: Skip", "3") + full(3, "General Health: Fair", "PMI: Skip")
            + full(4, "General Health: Poor", "No matching concept") + full(5, "General Health: Fair", "2")[:-1]
            + full(6, "General Health: Excellent", "0"))
    df = answers(spark, rows)
    ids = spark.createDataFrame([(1,), (3,)], "person_id long")
    cases, controls = cohort.keep_ids(df, ids, "person_id"), cohort.not_in(df, ids, "person_id")

    def build(c, n, **extra):
        return survey.feature_matrix(c, n, survey.ordinal_values(spark), survey.HEALTH_FEATURES,
                                     numeric_question=PAIN, sentinels=survey.PAIN_SENTINELS,
                                     tie_break=["answer_concept_id"], **extra)

    kept = {r.person_id: r for r in build(cases, controls).collect()}
    assert set(kept) == {1, 6}
    assert (kept[1].general_health, kept[1].pain, kept[1].has_t1d) == (2.0, 7.0, 1)
    assert (kept[6].general_health, kept[6].walking_climbing, kept[6].has_t1d) == (4.0, 0.0, 0)
    everyone = {r.person_id: r for r in build(cases, controls, complete=False).collect()}
    assert len(everyone) == 6 and everyone[2].general_health is None and everyone[3].pain is None
    # A person on both sides is one row, and a case.
    both = {r.person_id: r.has_t1d for r in build(cases, df).collect()}
    assert both == {1: 1, 6: 0}


def test_bad_numbers_are_counted(spark):
    df = answers(spark, [(1, PAIN, T[0], "seven", 1), (2, PAIN, T[0], "PMI: Skip", 1), (3, PAIN, T[0], "3", 1)])
    assert survey.bad_numeric_answers(df, PAIN, survey.PAIN_SENTINELS).first().bad_answers == 1


ALIGNMENTS = """{"name": "p1", "path": {"mapping": [{"position": {"node_id": "3"}}, {"position": {"node_id": "3"}}, {"position": {"node_id": "10"}}]}}
{"name": "p1", "path": {"mapping": [{"position": {"node_id": "2"}}, {"position": {}}, {"rank": 1}]}}
{"name": "p2", "path": {"mapping": [{"position": {}}]}}
{"name": "p3", "path": null}
{"name": "", "path": {"mapping": [{"position": {"node_id": "9"}}]}}
{"path": {"mapping": [{"position": {"node_id": "9"}}]}}
{"name": "p4", "path": {"mapping": []}}
{"name": "broken", "path": {"mapp
{"name": "p5", "path": {"mapping": [{"position": {"node_id": 3}}]}, "score": 7}
"""


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("json") / "a.json"
    path.write_text(ALIGNMENTS)
    return readers.alignments(spark, str(path))


def test_node_pairs(records):
    got = {(r.name, r.node_id) for r in incidence.node_pairs(records).collect()}
    assert got == {("p1", "3"), ("p1", "10"), ("p1", "2"), ("p5", "3")}
    assert {r.name for r in incidence.names_with_mapping(records).collect()} == {"p1", "p2", "p5"}


def test_matrices_and_row_check(spark, records, tmp_path):
    pairs, names = incidence.node_pairs(records), incidence.names_with_mapping(records)
    nodes = ["10", "2", "3"]  # string order
    want = {"p1": [1, 1, 1], "p2": [0, 0, 0], "p5": [0, 0, 1]}
    blocks = incidence.matrix_blocks(pairs, names, 2)
    assert {(r.name, r.block): r.cells for r in blocks.collect()} == \
        {(n, b): v[2 * b:2 * b + 2] for n, v in want.items() for b in (0, 1)}
    uri = writers.presence_csv(pairs, str(tmp_path / "m"), names, 2)
    assert [readers.incidence_matrix(spark, f"{uri}/block={b}").columns for b in (0, 1)] == \
        [["participant", "10", "2"], ["participant", "3"]]
    uri = writers.presence_csv(pairs, str(tmp_path / "w"), names) + "/block=0"
    back = readers.incidence_matrix(spark, uri)
    assert back.columns == ["participant", *nodes] and incidence.column_types(back) == {"int": 3}
    for check in (incidence.wide_row_homogeneity(back), incidence.row_homogeneity(pairs, names),
                  incidence.block_row_homogeneity(blocks)):
        assert {r.name: (r.ones, r.zeros, r.mixed) for r in check.collect()} == \
            {"p1": (3, 0, False), "p2": (0, 3, False), "p5": (1, 2, True)}
    assert sorted(r.value for r in incidence.distinct_cells(pairs, names).collect()) == [0, 1]
    assert [r.value for r in incidence.distinct_cells(pairs.where("name = 'p1'")).collect()] == [1]
    rows, cols = incidence.matrix_axes(pairs, names)
    ones = {tuple(r) for r in incidence.sparse_matrix(pairs, rows, cols).collect()}
    assert ones == {(0, 0), (0, 1), (0, 2), (2, 2)}


def test_matrix_of_very_many_nodes(spark, tmp_path):
    """More columns than a pivot takes, names and nodes that need quotes."""
    pairs = spark.range(12_001).select(F.concat(F.lit('p,"'), F.col("id") % 3).alias("name"),
                                       F.concat(F.lit("n,"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("node_id"))
    uri = writers.presence_csv(pairs, str(tmp_path / "big"))
    total, width = {}, 0
    for b in range(3):
        back = readers.incidence_matrix(spark, f"{uri}/block={b}")
        width += len(back.columns) - 1
        for r in back.collect():
            total[r[0]] = total.get(r[0], 0) + sum(r[1:])
    assert width == 12_001 and total == {'p,"0': 4001, 'p,"1': 4000, 'p,"2': 4000}


def test_a_block_is_many_files(spark, tmp_path):
    """Pieces of names: each file has its header, several tasks write one block, and the reader gives all blocks back."""
    pairs = spark.range(3000).select(F.concat(F.lit("p"), F.col("id") % 500).alias("name"), F.concat(F.lit("n"), F.col("id") % 40).alias("node_id"))
    uri = writers.presence_csv(pairs, str(tmp_path / "m"), width=25, file_rows=60)
    for block in (0, 1):
        files = [p for k in range(9) for p in glob.glob(f"{uri}/block={block}/piece={k}/part-*")]
        assert len(files) == 9 and all(open(p).readline().startswith("participant,n") for p in files)
    blocks = readers.incidence_blocks(spark, uri)
    assert [len(b.columns) - 1 for b in blocks] == [25, 15] and all(b.count() == 500 for b in blocks)
    total = sum(sum(r[1:]) for b in blocks for r in b.collect())
    assert total == pairs.distinct().count()


def test_lists_in_pieces_and_text(spark, records, tmp_path):
    pairs = incidence.node_pairs(records)
    got = {(r.name, r.part): r.nodes for r in incidence.node_lists(pairs, 2).collect()}
    assert got == {("p1", 0): ["10", "2"], ("p1", 1): ["3"], ("p5", 0): ["3"]}
    uri = writers.node_lists_text(pairs, str(tmp_path / "t"))
    text = "\n".join(r.value for r in spark.read.text(uri).coalesce(1).collect())
    assert "p1:\nNodes: 10, 2, 3" in text and "p5:\nNodes: 3" in text


def test_node_summary_is_describe(spark):
    import pandas as pd
    names = spark.createDataFrame([(f"n{i}",) for i in range(8)], "name string")
    held = {"a": 1, "b": 2, "c": 3, "d": 6, "e": 8}
    pairs = spark.createDataFrame([(f"n{i}", k) for k, n in held.items() for i in range(n)], "name string, node_id string")
    for r in incidence.node_summary(pairs, names).collect():
        want = pd.Series([1.0] * held[r.node_id] + [0.0] * (8 - held[r.node_id])).describe()
        assert [r["count"], r.mean, r.std, r.min, r.p25, r.p50, r.p75, r.max] == pytest.approx(want.tolist())
