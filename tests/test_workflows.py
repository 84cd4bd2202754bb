import datetime
import gzip
import itertools
import random

import pytest
from pyspark.sql import functions as F

from doseloom.operators import cohort, survey
from doseloom.plans import workflows
from doseloom.sources import readers, writers


@pytest.fixture(scope="module")
def genotypes(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("g") / "data")
    variants = [("chr6", p, ["A", "C"]) for p in range(100, 200, 10)]
    samples = [(f"{i}",) for i in range(1, 61)]
    rng = random.Random(6)
    calls = [(c, p, a, s[0], rng.choice([[0, 1], [1, 1]]), True)
             for (c, p, a), s in itertools.product(variants, samples) if rng.random() < 0.6]
    writers.genotypes(spark.createDataFrame(variants, "contig string, position int, alleles array<string>"),
                      spark.createDataFrame(samples, "s string"),
                      spark.createDataFrame(calls, "contig string, position int, alleles array<string>, s string, "
                                                   "gt array<int>, ft boolean"), root, block_size=50)
    return root, variants, samples, calls


def test_score_then_evaluate(spark, genotypes, tmp_path):
    root, variants, samples, calls = genotypes
    (tmp_path / "flagged.tsv").write_text("sample_id\n3\n4\n999\n")
    with gzip.open(tmp_path / "score.txt.gz", "wt") as f:
        f.write("#comment\nhm_chr\thm_pos\teffect_allele\teffect_weight\n"
                + "".join(f"6\t{p}\t{'A' if p % 20 else 'C'}\t{p / 97}\n" for _, p, _ in variants) + "7\t5\tA\t9\n")
    people = spark.createDataFrame([(i,) for i in range(2, 80)], "person_id long")
    out = workflows.score_cohort(spark, root, str(tmp_path / "flagged.tsv"), people, str(tmp_path / "score.txt.gz"),
                                 str(tmp_path / "out"), block_size=50)
    rows = {r.s: r for r in out.scores.collect()}
    assert set(rows) == {str(i) for i in range(2, 61)} - {"3", "4"}
    held = {(c[3], c[1]): c[4] for c in calls}
    for s, r in rows.items():
        total = 0.0
        for _, p, _ in variants:
            gt = held.get((s, p))
            alts = sum(gt) if gt else 0
            total += (2 - alts if p % 20 else alts) * p / 97
        assert r.total_score == pytest.approx(total) and r.variant_count == 10
    assert out.found.count() == 10 and out.weight_report.first().weight_rows == 11
    back = readers.scores_csv(spark, str(tmp_path / "out" / "scores_csv"))
    assert back.count() == len(rows)

    standard = workflows.standardise(out.scores, str(tmp_path / "standard"))
    assert standard.agg(F.avg("prs_zscore")).first()[0] == pytest.approx(0, abs=1e-9)
    conditions = spark.createDataFrame(
        [(s, "E10.1" if (r.total_score * 7) % 3 > 1.4 else "Z00") for s, r in rows.items()],
        "person_id string, code string")
    flag = cohort.phenotype_flag(conditions, "person_id", "code", cohort.TYPE1_DIABETES_CODES)
    result = workflows.evaluate(standard, flag)
    assert result["totals"].first().participants == len(rows)
    assert sum(r["count"] for r in result["deciles"].collect()) == len(rows)
    area = result["ranking"].first().roc_auc
    assert 0 <= area <= 1 and result["odds_per_sd"].first().odds_ratio > 0
    assert {"roc", "tests", "youden", "metrics_youden", "report_half"} <= set(result)
    assert all(df.count() > 0 for df in result.values())


def test_region_exports(spark, genotypes, tmp_path):
    root, variants, _, calls = genotypes
    ids = spark.createDataFrame([("1",), ("2",)], "person_id string")
    bases = spark.createDataFrame([("chr6", 1, "A" * 1000)], "contig string, chunk_start long, bases string")
    out = workflows.region_exports(spark, root, ids, "chr6:100-150", str(tmp_path / "o"), bases)
    want = {c[1] for c in calls if c[3] in ("1", "2") and 100 <= c[1] < 150}
    assert out["count"].first().n_variants == len(want)
    assert {r.s for r in out["sequences"].collect()} == {"1", "2"}


def test_coverage(spark, tmp_path):
    (tmp_path / "w.csv").write_text("chr,pos,effect_allele,weight,id\n22,10,A,1,a\n22,9000,A,1,b\n22,90000,A,1,c\n")
    (tmp_path / "v.bim").write_text("22 22:10:A:C 0 0 A C\n22 22:5000:A:C 0 0 A C\n22 bad 0 0 A C\n")
    out = workflows.weight_coverage(spark, str(tmp_path / "w.csv"), str(tmp_path / "v.bim"), "22")
    s = out["summary"].first()
    assert (s.exact_positions, s.approximate_positions, s.mean_distance) == (1, 1, 4000.0)
    assert {r.id: r.match_type for r in out["examples"].collect()} == \
        {"a": "Exact Match", "b": "Approximate Match", "c": "No Match"}


def test_node_incidence(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "p", "path": {"mapping": [{"position": {"node_id": "1"}}]}}\n')
    out = workflows.node_incidence(spark, str(tmp_path / "a.json"), str(tmp_path / "out"))
    assert out["pairs"].count() == 1 and out["rows"].first().ones == 1


def test_survey_to_models(spark, tmp_path):
    day = datetime.datetime(2021, 3, 1)
    concepts = workflows.SurveyConcepts((10,), (20,), (30,), (40,))
    criteria = [(1, 10, "SURVEY", "PPI", "SURVEY", "1", "", 0, 1), (2, 11, "SURVEY", "PPI", "QUESTION", "1.2", "", 0, 1),
                (3, 20, "CONDITION", "X", "X", "3", "_rank1]", 1, 1)]
    people = range(1, 121)
    answers = []
    for i in people:
        for j, (question, scale) in enumerate(survey.ORDINAL_ANSWERS.items()):
            level = (i * (j + 3) + (i % 3 == 0) * 2) % len(scale)
            answers.append((i, day, "s", 11, question, 1, f"{question.split(': ')[-1]}: {scale[level]}", 1, "v"))
        answers.append((i, day, "s", 11, survey.PAIN_QUESTION, 1, str((i * 5) % 11), 1, "v"))
    from doseloom.sources import schemas
    tables = {
        "cb_criteria": spark.createDataFrame(criteria, schemas.CRITERIA),
        "cb_search_person": spark.createDataFrame([(i, 1, 1) for i in people], schemas.SEARCH_PERSON),
        "cb_search_all_events": spark.createDataFrame([(i, day.date(), 20, 1, None) for i in people if i % 3 == 0],
                                                      schemas.SEARCH_EVENTS),
        "ds_survey": spark.createDataFrame(answers, schemas.SURVEY)}
    matrix = workflows.survey_features(spark, tables, concepts)
    assert matrix.count() == 120 and matrix.agg(F.sum("has_t1d")).first()[0] == 40
    out = workflows.compare_survey_models(matrix, folds=3, logistic_grid={"C": [0.1, 1.0], "class_weight": ["balanced"]},
                                          tree_grid={"max_depth": [2], "min_child_weight": [1]}, rounds=3)
    assert {r.model for r in out["ranking"].collect()} == {"lr", "trees"}
    assert out["pooled"].count() == 240 and out["features"].count() == 8
    assert out["report"].count() == 10 and set(out["best"]) == {"lr", "trees"}
