"""Weights, dosage, scores and variant filters on the stand-in genotypes."""

from __future__ import annotations

from pyspark.sql import functions as F

from doseloom.functions import genotype as g
from doseloom.operators import cohort, intervals, ranking, scoring
from doseloom.operators.scoring import RISK_LABELS
from doseloom.plans.storage import cut_lineage
from doseloom.sources import readers
from standins import frames as f
from standins import query

_FULL = f"{f.VARIANTS_SQL}, {f.WEIGHTS_SQL}, {f.CALLS_SQL}"
_IS_REF, _IS_ALT = "effect_allele = ref", "(effect_allele = alt1 OR coalesce(effect_allele = alt2, false))"
_DOSAGE = f"""CASE WHEN kind IS NULL OR kind = 3 THEN CASE WHEN {_IS_REF} THEN 2 ELSE 0 END
     WHEN kind = 0 AND {_IS_REF} THEN 2 WHEN kind = 2 AND {_IS_ALT} THEN 2
     WHEN kind IN (1, 4) AND {_IS_REF} THEN 1 WHEN kind IN (1, 4) AND {_IS_ALT} THEN 1 ELSE 0 END"""
# Copies really carried: allele by allele, absent and missing calls as reference.
_FIRST = "CASE WHEN kind = 2 OR (kind = 4 AND alt2 IS NOT NULL) THEN alt1 ELSE ref END"
_SECOND = "CASE WHEN kind IN (1, 2) OR (kind = 4 AND alt2 IS NULL) THEN alt1 WHEN kind = 4 THEN alt2 ELSE ref END"
_CARRIED = (f"CASE WHEN kind IS NULL OR kind = 3 THEN CASE WHEN {_IS_REF} THEN 2 ELSE 0 END ELSE "
            f"cast(effect_allele = {_FIRST} AS int) + cast(effect_allele = {_SECOND} AS int) END")


def _dense(dosage: str, extra: str = "") -> str:
    """Scores from the full samples x variants grid."""
    return f"""scores AS (
  SELECT s, sum(dosage * weight) AS total_score, count(*) AS variant_count
  FROM (SELECT c.c_custkey AS s, w.weight, {dosage} AS dosage
        FROM customer c CROSS JOIN (SELECT * FROM variants JOIN weights USING (contig, position)) w
        LEFT JOIN calls k ON k.s = c.c_custkey AND k.p_partkey = w.p_partkey {extra}) GROUP BY s)"""


_SCORE_COLUMNS = """s, round(total_score, 6) AS total_score, variant_count,
  round(total_score / variant_count, 6) AS normalized_score"""


def _rounded(scores):
    return scores.withColumns({c: F.round(c, 6) for c in ("total_score", "normalized_score")})


@query("weights_prepare", f"""WITH {f.weights_sql('p_retailprice')}, picked AS (
  SELECT contig, position, count(*) AS locus_weights,
         min({{'effect_allele': effect_allele, 'weight': weight}}) AS w FROM weights GROUP BY 1, 2)
SELECT contig, position, w.effect_allele AS effect_allele, w.weight AS weight, locus_weights FROM picked""")
def weights_prepare(spark, sf):
    return scoring.one_weight_per_locus(f.weights(spark, sf, "p_retailprice"))


@query("weight_report", f"""WITH {f.weights_sql('p_retailprice')}
SELECT count(*) AS weight_rows, cast(0 AS bigint) AS without_locus,
       count(*) - count(DISTINCT contig || ':' || position) AS repeated_locus FROM weights""")
def weight_report(spark, sf):
    return readers.weight_report(f.weights(spark, sf, "p_retailprice"))


@query("point_intervals", f"""WITH {f.WEIGHTS_SQL}
SELECT contig, position AS start, position AS "end" FROM weights""")
def point_intervals(spark, sf):
    return intervals.point_intervals(f.weights(spark, sf))


@query("interval_points", f"""WITH {f.VARIANTS_SQL}, {f.WEIGHTS_SQL}
SELECT contig, position FROM variants WHERE EXISTS (
  SELECT 1 FROM weights w WHERE w.contig = variants.contig AND w.position = variants.position)""")
def interval_points(spark, sf):
    points = intervals.point_intervals(f.weights(spark, sf))
    return intervals.at_points(f.variants(spark, sf), points).select("contig", "position")


def _supplier_intervals(spark, sf):
    """Closed intervals from suppliers; a negative balance gives an invalid one,
    and the contig of nation 0 is no contig of any variant."""
    start = F.col("s_suppkey") * 7
    return f.table(spark, sf, "supplier").select(
        F.concat(F.lit("chr"), F.col("s_nationkey").cast("string")).alias("contig"),
        start.cast("int").alias("start"),
        (start + F.floor(F.col("s_acctbal") / 20)).cast("int").alias("end"))


_INTERVALS_SQL = """intervals AS (SELECT 'chr' || s_nationkey AS contig, cast(s_suppkey * 7 AS int) AS "start",
  cast(s_suppkey * 7 + floor(s_acctbal / 20) AS int) AS "end" FROM supplier)"""


@query("interval_valid", f"""WITH {_INTERVALS_SQL}, {f.VARIANTS_SQL}
SELECT contig, "start", "end" FROM intervals WHERE "start" <= "end" AND contig IN (SELECT contig FROM variants)""")
def interval_valid(spark, sf):
    contigs = f.variants(spark, sf).select("contig").distinct()
    return intervals.valid_intervals(_supplier_intervals(spark, sf), contigs)


@query("interval_wide", f"""WITH {_INTERVALS_SQL}, {f.VARIANTS_SQL}
SELECT contig, position FROM variants v WHERE EXISTS (SELECT 1 FROM intervals i
  WHERE i.contig = v.contig AND v.position BETWEEN i."start" AND i."end")""")
def interval_wide(spark, sf):
    kept = intervals.valid_intervals(_supplier_intervals(spark, sf))
    return intervals.in_intervals(f.variants(spark, sf), kept, block=64).select("contig", "position")


@query("interval_open_end", f"""WITH {_INTERVALS_SQL}, {f.VARIANTS_SQL}
SELECT contig, position FROM variants v WHERE EXISTS (SELECT 1 FROM intervals i
  WHERE i.contig = v.contig AND v.position >= i."start" AND v.position < i."end")""")
def interval_open_end(spark, sf):
    kept = intervals.valid_intervals(_supplier_intervals(spark, sf))
    return intervals.in_intervals(f.variants(spark, sf), kept, end_inclusive=False).select("contig", "position")


@query("variant_annotation", f"""WITH {f.VARIANTS_SQL}, {f.WEIGHTS_SQL}
SELECT contig, position, effect_allele, weight FROM variants LEFT JOIN weights USING (contig, position)""")
def variant_annotation(spark, sf):
    return scoring.annotate_variants(f.variants(spark, sf), f.weights(spark, sf)) \
        .select("contig", "position", "effect_allele", "weight")


@query("call_states", f"""WITH {f.VARIANTS_SQL}, {f.CALLS_SQL}
SELECT count(*) AS stored, count(*) FILTER (WHERE kind = 3) AS missing,
       count(*) FILTER (WHERE kind = 0) AS hom_ref, count(*) FILTER (WHERE kind IN (1, 4)) AS het,
       count(*) FILTER (WHERE kind = 2) AS hom_var, count(*) FILTER (WHERE flag = 'A') AS passed,
       count(*) FILTER (WHERE flag = 'N') AS failed FROM calls JOIN variants USING (p_partkey)""")
def call_states(spark, sf):
    gt, label = F.col("gt"), g.filter_label(F.col("ft"))
    return f.calls(spark, sf).agg(
        F.count(F.lit(1)).alias("stored"), F.count_if(g.is_missing(gt)).alias("missing"),
        F.count_if(g.is_hom_ref(gt)).alias("hom_ref"), F.count_if(g.is_het(gt)).alias("het"),
        F.count_if(g.is_hom_var(gt)).alias("hom_var"), F.count_if(label == "PASS").alias("passed"),
        F.count_if(label == "FAIL").alias("failed"))


@query("dosage", f"""WITH {_FULL}
SELECT s, contig, position, cast({_DOSAGE} AS int) AS dosage, round({_DOSAGE} * weight, 6) AS contribution
FROM calls JOIN variants USING (p_partkey) JOIN weights USING (contig, position)""")
def dosage(spark, sf):
    rows = scoring.call_dosages(f.calls(spark, sf), f.weights(spark, sf))
    return rows.select("s", "contig", "position", "dosage", F.round("contribution", 6).alias("contribution"))


@query("score_sparse", f"WITH {_FULL}, {_dense(_DOSAGE)} SELECT {_SCORE_COLUMNS} FROM scores")
def score_sparse(spark, sf):
    return _rounded(scoring.score_samples(f.samples(spark, sf), f.variants(spark, sf),
                                          f.calls(spark, sf), f.weights(spark, sf), sampled=f.sampled_calls(spark, sf)))


@query("score_allele_specific", f"WITH {_FULL}, {_dense(_CARRIED)} SELECT {_SCORE_COLUMNS} FROM scores")
def score_allele_specific(spark, sf):
    return _rounded(scoring.score_samples(f.samples(spark, sf), f.variants(spark, sf), f.calls(spark, sf),
                                          f.weights(spark, sf), allele_specific=True, sampled=f.sampled_calls(spark, sf)))


@query("score_shuffled", f"WITH {_FULL}, {_dense(_DOSAGE)} SELECT {_SCORE_COLUMNS} FROM scores")
def score_shuffled(spark, sf):
    """The same score when the weights are too many to broadcast."""
    return _rounded(scoring.score_samples(f.samples(spark, sf), f.variants(spark, sf), f.calls(spark, sf),
                                          f.weights(spark, sf), max_broadcast=0, sampled=f.sampled_calls(spark, sf)))


@query("score_found_variants", f"""WITH {f.VARIANTS_SQL}, {f.WEIGHTS_SQL}
SELECT contig, position, concat_ws(',', ref, alt1, alt2) AS alleles, effect_allele, weight
FROM variants JOIN weights USING (contig, position)""")
def score_found_variants(spark, sf):
    found = scoring.found_variants(f.variants(spark, sf), f.weights(spark, sf))
    return found.withColumn("alleles", F.array_join("alleles", ","))


_COHORT_SQL = """cohort AS (SELECT c_custkey AS s FROM customer WHERE c_acctbal >= 0
  AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'))"""


def _cohort_samples(spark, sf):
    flagged = f.table(spark, sf, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("s"))
    recorded = f.table(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
    return cohort.keep_ids(cohort.drop_ids(f.samples(spark, sf), flagged, "s"), recorded, "s", "o_custkey")


@query("score_cohort", f"""WITH {_FULL}, {_COHORT_SQL}, {_dense(_DOSAGE)},
kept AS (SELECT s, total_score, variant_count FROM scores JOIN cohort USING (s)),
ranked AS (SELECT *, rank() OVER (ORDER BY round(total_score, 6)) AS r,
                  count(*) OVER (PARTITION BY round(total_score, 6)) AS ties, count(*) OVER () AS n,
                  avg(total_score) OVER () AS mean, stddev_samp(total_score) OVER () AS sd FROM kept),
edges AS (SELECT quantile_cont(round(total_score, 6), [0.2, 0.4, 0.6, 0.8]) AS e FROM kept)
SELECT s, round(total_score, 6) AS total_score, variant_count,
       round((total_score - mean) / sd, 6) AS zscore, round((r + (ties - 1) / 2.0) / n * 100, 6) AS percentile,
       CASE WHEN round(total_score, 6) <= e[1] THEN 'Very Low' WHEN round(total_score, 6) <= e[2] THEN 'Low'
            WHEN round(total_score, 6) <= e[3] THEN 'Average' WHEN round(total_score, 6) <= e[4] THEN 'High'
            ELSE 'Very High' END AS risk_category
FROM ranked, edges""")
def score_cohort(spark, sf):
    """Select the cohort, score it, standardise, rank and name the risk fifth."""
    kept = _cohort_samples(spark, sf)
    calls = scoring.calls_of(f.calls(spark, sf), kept)
    scored = scoring.score_samples(kept, f.variants(spark, sf), calls, f.weights(spark, sf), sampled=f.sampled_calls(spark, sf))
    # Equal scores may differ in the last bits after summing in another order.
    # The scores are saved once; all statistics below read the saved rows.
    scored = cut_lineage(scored.withColumn("total_score", F.round("total_score", 6)))
    out = ranking.z_scores(scored, "total_score", "zscore")
    out = ranking.percentile_ranks(out, "total_score", "percentile")
    out = ranking.quantile_cut(out, "total_score", 5, "risk_bin", RISK_LABELS, "risk_category")
    return out.select("s", "total_score", "variant_count", F.round("zscore", 6).alias("zscore"),
                      F.round("percentile", 6).alias("percentile"), "risk_category")


@query("sample_counts", f"""WITH {_COHORT_SQL}
SELECT 'all' AS cohort, count(*) AS n_rows, count(DISTINCT c_custkey) AS n_persons FROM customer
UNION ALL SELECT 'not_flagged', count(*), count(DISTINCT c_custkey) FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT 'cohort', count(*), count(DISTINCT s) FROM cohort""")
def sample_counts(spark, sf):
    customers = f.table(spark, sf, "customer")
    flagged = customers.where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("s"))
    everyone = f.samples(spark, sf)
    return cohort.cohort_sizes({"all": everyone, "not_flagged": cohort.drop_ids(everyone, flagged, "s"),
                                "cohort": _cohort_samples(spark, sf)}, "s")


@query("score_describe", f"""WITH {_FULL}, {_dense(_DOSAGE)}, t AS (SELECT round(total_score, 6) AS x FROM scores)
SELECT count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min,
       round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50,
       round(quantile_cont(x, 0.75), 6) AS p75, max(x) AS max FROM t""")
def score_describe(spark, sf):
    out = ranking.describe(cut_lineage(score_sparse(spark, sf)), "total_score")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


@query("variant_count_distribution", f"""WITH {_FULL}, {_dense(_DOSAGE)}
SELECT variant_count, count(*) AS count FROM scores GROUP BY 1""")
def variant_count_distribution(spark, sf):
    return ranking.value_counts(score_sparse(spark, sf), "variant_count")
