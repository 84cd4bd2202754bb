"""End-to-end jobs over the operators, from stored inputs to saved outputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doseloom.functions.text import parse_region
from doseloom.models import boosting, classifiers, features, newton, selection
from doseloom.operators import (association, cohort, hierarchy, incidence, intervals, matching, metrics, ranking,
                                regions, scoring, survey)
from doseloom.plans import storage
from doseloom.sources import readers, writers


class ScoreOutputs(NamedTuple):
    scores: DataFrame
    found: DataFrame
    weight_report: DataFrame


def score_cohort(spark: SparkSession, genotype_root: str, flagged_uri: str, people: DataFrame, scoring_uri: str,
                 output_root: str, block_size: int | None = None, allele_specific: bool = False) -> ScoreOutputs:
    """Drop flagged samples, keep the cohort, score it, save scores and found variants.

    Samples and blocks are filtered before any join with the weights; the score
    table is written once and every later step reads it. Blocks are pruned by the size that
    is stored with the calls; another ``block_size`` raises.
    """
    data = readers.genotypes(spark, genotype_root)
    flagged = readers.flagged_samples(spark, flagged_uri)
    samples = cohort.drop_ids(data.samples.withColumn("s", F.col("s").cast("string")), flagged, "s", "sample_id")
    samples = cohort.keep_ids(samples, people.select(F.col("person_id").cast("string").alias("person_id")),
                              "s", "person_id")
    root = output_root.rstrip("/")
    prepared = readers.prepare_weights(readers.scoring_file(spark, scoring_uri))
    weights = readers.located_weight_csv(spark, writers.weights(readers.locate_weights(prepared), f"{root}/weights"))
    writers.weight_intervals(weights, f"{root}/intervals")
    if block_size is not None and block_size != data.block_size:
        raise ValueError(f"calls are stored in blocks of {data.block_size}, not {block_size}")
    calls = scoring.prune_calls(data, weights)
    calls = scoring.calls_of(calls.withColumn("s", F.col("s").cast("string")), samples)
    points = intervals.point_intervals(weights)
    variants = intervals.at_points(data.variants, points)
    scored = scoring.score_samples(samples, variants, calls, weights, allele_specific)
    saved = writers.scores(scored, f"{root}/scores", f"{root}/scores_csv")
    found = scoring.found_variants(variants, weights)
    writers.found_variants(found, f"{root}/found")
    return ScoreOutputs(saved, found, readers.weight_report(weights))


def standardise(scores: DataFrame, output_uri: str | None = None,
                labels: Sequence[str] = scoring.RISK_LABELS) -> DataFrame:
    """z-score, percentile and risk category of every scored sample, saved as CSV."""
    out = ranking.z_scores(scores, "total_score", "prs_zscore")
    out = ranking.percentile_ranks(out, "total_score", "prs_percentile")  # the saved score: the same order
    out = ranking.quantile_cut(out, "prs_zscore", len(labels), "_bin", labels, "risk_category").drop("_bin")
    out = out.select(*scores.columns, "prs_zscore", "prs_percentile", "risk_category")
    if output_uri is not None:
        writers.csv(out, output_uri)
    return out


def evaluate(standardised: DataFrame, phenotype: DataFrame, status: str = "status",
             keep_unrecorded: bool = False) -> dict[str, DataFrame]:
    """Every association result of a standardised score and a phenotype."""
    merged = association.merge_phenotype(standardised, phenotype, status, keep_unrecorded)
    merged = storage.cut_lineage(merged.select("s", "prs_zscore", F.col(status).cast("int").alias(status)))
    z = "prs_zscore"
    model = newton.fit_one(merged, [z], status)
    scored = storage.cut_lineage(
        merged.withColumn("probability", classifiers.logistic_probability(model, [z])))
    cut = metrics.youden_threshold(scored, status, "probability")
    at_best = metrics.label_above(scored, "probability", cut.select("threshold").scalar())
    at_half = scored.withColumn("called", (F.col("probability") > 0.5).cast("int"))
    return {
        "totals": association.cohort_totals(merged, status),
        "roc": metrics.roc_points(merged, status, z),
        "ranking": metrics.ranking_metrics(merged, status, z),
        "deciles": association.prevalence_by_bin(merged, z, status, 10, association.DECILE_LABELS, percent=True),
        "quintiles": association.prevalence_by_bin(merged, z, status, 5, association.QUINTILE_LABELS),
        "tails": association.tail_odds_ratio(merged, z, status),
        "odds_per_sd": classifiers.odds_ratios(model, [z], merged),
        "tests": classifiers.model_tests(model, merged, [z], status),
        "youden": cut,
        "metrics_youden": metrics.threshold_metrics(at_best, status, "called"),
        "metrics_half": metrics.threshold_metrics(at_half, status, "called"),
        "report_youden": metrics.class_report(at_best, status, "called"),
        "report_half": metrics.class_report(at_half, status, "called"),
    }


def weight_coverage(spark: SparkSession, weights_uri: str, variant_list_uri: str, chrom: str | None = None,
                    window: int = 5_000) -> dict[str, DataFrame]:
    """Share of a weight table found in a variant list, exactly and nearby."""
    weights = readers.processed_weights(spark, weights_uri, chrom)
    variants = readers.variant_list(spark, variant_list_uri, chrom)
    matched = matching.match_weights(weights, variants, window)
    return {"summary": matching.coverage_summary(weights, variants, window), "matched": matched,
            "examples": matching.match_examples(matched, ["chrom", "pos", "id"]),
            "bad_rows": readers.bad_variant_ids(variants)}


class SurveyConcepts(NamedTuple):
    """Concept ids that define the surveys and the case cohort."""

    surveys: Sequence[int]
    conditions: Sequence[int]
    source_concepts: Sequence[int]
    source_values: Sequence[int]


# Concept ids of the health surveys and of type 1 diabetes.
TYPE1_DIABETES_SURVEY = SurveyConcepts(surveys=(1585710, 1586134, 1585855), conditions=(201254,),
                                       source_concepts=(836799,), source_values=(43529923,))


def case_persons(tables: Mapping[str, DataFrame], concepts: SurveyConcepts) -> DataFrame:
    """Distinct persons with the condition or one below it, or the source concept."""
    events = tables["cb_search_all_events"]
    below = hierarchy.concept_descendants(tables["cb_criteria"], concepts.conditions)
    both = cohort.union_ids(
        cohort.event_cohort(events, concepts=below),
        cohort.event_cohort(events, concept_ids=concepts.source_concepts, is_standard=0,
                            value_source_ids=concepts.source_values), key="person_id")
    return cohort.keep_ids(both, tables["cb_search_person"], "person_id")


def survey_answers(tables: Mapping[str, DataFrame], concepts: SurveyConcepts) -> DataFrame:
    questions = hierarchy.survey_questions(tables["cb_criteria"], concepts.surveys)
    return cohort.keep_ids(tables["ds_survey"], questions, "question_concept_id", "concept_id", hot=True)


def survey_features(spark: SparkSession, tables: Mapping[str, DataFrame],
                    concepts: SurveyConcepts = TYPE1_DIABETES_SURVEY) -> DataFrame:
    """Feature matrix of cases and non-cases; one case cohort defines both sides."""
    answers, cases = survey_answers(tables, concepts), case_persons(tables, concepts)
    return survey.case_feature_matrix(
        answers, cases, survey.ordinal_values(spark), survey.HEALTH_FEATURES, numeric_question=survey.PAIN_QUESTION,
        sentinels=survey.PAIN_SENTINELS, tie_break=["answer_concept_id"])


def compare_survey_models(matrix: DataFrame, feature_names: Sequence[str] = survey.HEALTH_FEATURES,
                          label: str = "has_t1d", id_column: str = "person_id", folds: int = 5,
                          logistic_grid: Mapping[str, Sequence[Any]] | None = None,
                          tree_grid: Mapping[str, Sequence[Any]] | None = None,
                          rounds: int = selection.BOOSTED_TREE_ROUNDS) -> dict[str, Any]:
    """Tune logistic regression and boosted trees, pool their out-of-fold
    calls, and report metrics, curves and per-feature statistics."""
    data = storage.cut_lineage(matrix)
    trees = {**(tree_grid or selection.BOOSTED_TREE_GRID), "n_estimators": [rounds],
             **{k: [v] for k, v in selection.BOOSTED_TREE_REST.items()}}
    folded = selection.save_folds(data, id_column, label, folds)
    scaled = features.scale(data, features.scaling_facts(data, feature_names))
    best_lr, _, lr_calls = selection.search_with_calls(
        data, classifiers.fit_logistic, logistic_grid or selection.LOGISTIC_GRID, feature_names, label, id_column, folds,
        scale_inside=True, folded=folded)
    best_trees, _, tree_calls = selection.search_with_calls(
        data, boosting.fit_boosted, trees, feature_names, label, id_column, folds, folded=folded)
    best = {"lr": best_lr, "trees": best_trees}
    # The search has scored every row by models fitted without its fold; the best candidate's rows are the pooled calls.
    pooled = lr_calls.withColumn("model", F.lit("lr")).unionByName(tree_calls.withColumn("model", F.lit("trees")))
    importances = {"lr": newton.fit_one(scaled, feature_names, label, **best_lr).coefficients,
                   "trees": boosting.fit_boosted(data, feature_names, label, **best_trees)[1].importances(len(feature_names))}
    pooled = storage.cut_lineage(pooled)
    predicted = pooled.withColumn("called", (F.col("probability") > 0.5).cast("int"))
    effects = features.with_p_values(features.feature_effects(scaled, feature_names, label))
    table = classifiers.importance_table(data, feature_names, lr_coefficient=importances["lr"],
                                         tree_importance=importances["trees"])
    return {"best": best, "pooled": pooled,
            "ranking": selection.compare_models(pooled, label),
            "report": metrics.class_report(predicted, label, "called", ["model"]),
            "roc": metrics.roc_points(pooled, label, "probability", ["model"]),
            "precision_recall": metrics.precision_recall_points(pooled, label, "probability", ["model"]),
            "features": table.join(effects, "feature").orderBy("p_value", "feature")}


def node_incidence(spark: SparkSession, alignments_uri: str, output_root: str) -> dict[str, DataFrame]:
    """Alignment records to pairs, lists, text, both matrices and the row check."""
    root = output_root.rstrip("/")
    records = readers.alignments(spark, alignments_uri)
    names = incidence.names_with_mapping(records)
    pairs = spark.read.parquet(writers.parquet(incidence.node_pairs(records), f"{root}/pairs"))
    writers.node_lists_json(pairs, f"{root}/raw_json")
    writers.node_lists_text(pairs, f"{root}/readable")
    writers.sparse_matrix(pairs, f"{root}/matrix", names)
    return {"pairs": pairs, "rows": incidence.row_homogeneity(pairs, names),
            "nodes": incidence.node_summary(pairs, names)}


def region_exports(spark: SparkSession, genotype_root: str, ids: DataFrame, region: str, output_root: str,
                   bases: DataFrame | None = None) -> dict[str, DataFrame]:
    """Slice samples and a region, count variants, write one folder per sample,
    and the consensus sequences when a reference is given."""
    root = output_root.rstrip("/")
    data = readers.genotypes(spark, genotype_root)
    calls = data.calls.withColumn("s", F.col("s").cast("string"))
    wanted = ids.select(F.col("person_id").cast("string").alias("s"))
    inside = regions.slice_region(calls, region, samples=wanted)
    writers.sample_variant_files(inside, f"{root}/variants")
    out = {"count": regions.count_variants(inside)}
    if bases is not None:
        samples = cohort.keep_ids(data.samples.withColumn("s", F.col("s").cast("string")), wanted, "s")
        sequences = regions.consensus(samples, calls, bases, region)
        writers.sample_sequences(sequences, f"{root}/sequences", parse_region(region)[1])
        out["sequences"] = sequences
    return out
