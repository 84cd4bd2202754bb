"""Distribution statistics and association with a phenotype."""

from __future__ import annotations

from pyspark.sql import functions as F

from doseloom.operators import association, chartdata, ranking
from doseloom.operators.scoring import RISK_LABELS
from standins import frames as f
from standins import query


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _edges_sql(bins: int, source: str) -> str:
    inner = ", ".join(str(i / bins) for i in range(1, bins))
    return f"edges AS (SELECT quantile_cont(score, [{inner}]) AS e FROM {source})"


def _bin_sql(bins: int) -> str:
    tests = " ".join(f"WHEN score <= e[{i}] THEN {i}" for i in range(1, bins))
    return f"cast(CASE {tests} ELSE {bins} END AS int)"


@query("zscore", f"""WITH {f.SPEND_SQL}
SELECT s, score, round((score - avg(score) OVER ()) / stddev_samp(score) OVER (), 6) AS zscore FROM spend""")
def zscore(spark, sf):
    return _rounded(ranking.z_scores(f.spend(spark, sf), "score"), "zscore")


@query("percentile_rank", """SELECT doc_id, n_chars,
  round((rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0)
        / count(*) OVER () * 100, 6) AS percentile FROM documents""")
def percentile_rank(spark, sf):
    """Average ranks with many ties: document lengths."""
    rows = f.table(spark, sf, "documents").select("doc_id", "n_chars")
    return _rounded(ranking.percentile_ranks(rows, "n_chars"), "percentile")


@query("percentile_rank_hot", """SELECT l_linenumber, l_quantity,
  count(*) AS rows_here, round((any_value(r) + (any_value(ties) - 1) / 2.0) / any_value(n) * 100, 6) AS percentile
FROM (SELECT l_linenumber, l_quantity, rank() OVER (ORDER BY l_quantity) AS r,
             count(*) OVER (PARTITION BY l_quantity) AS ties, count(*) OVER () AS n FROM lineitem)
GROUP BY 1, 2""")
def percentile_rank_hot(spark, sf):
    """Few values, each with very many rows."""
    rows = f.table(spark, sf, "lineitem").select("l_linenumber", "l_quantity")
    ranked = ranking.percentile_ranks(rows, "l_quantity")
    return ranked.groupBy("l_linenumber", "l_quantity").agg(
        F.count(F.lit(1)).alias("rows_here"), F.round(F.max("percentile"), 6).alias("percentile"))


for _bins, _labels in ((5, list(RISK_LABELS)), (10, list(association.DECILE_LABELS))):
    _names = ", ".join(f"'{x}'" for x in _labels)

    @query(f"quantile_cut_{_bins}", f"""WITH {f.SPEND_SQL}, {_edges_sql(_bins, 'spend')},
cut AS (SELECT s, score, {_bin_sql(_bins)} AS bin FROM spend, edges)
SELECT s, score, bin, [{_names}][bin] AS label FROM cut""")
    def _quantile_cut(spark, sf, bins=_bins, labels=_labels):
        return ranking.quantile_cut(f.spend(spark, sf), "score", bins, "bin", labels, "label")


@query("percentile_tails", f"""WITH {f.SPEND_SQL},
cuts AS (SELECT quantile_cont(score, 0.05) AS low, quantile_cont(score, 0.95) AS high FROM spend)
SELECT s, score, score <= low AS in_bottom, score >= high AS in_top FROM spend, cuts
WHERE score <= low OR score >= high""")
def percentile_tails(spark, sf):
    return ranking.percentile_tails(f.spend(spark, sf), "score")


@query("describe", f"""WITH {f.SPEND_SQL} SELECT count(score) AS count, round(avg(score), 4) AS mean,
  round(stddev_samp(score), 4) AS std, min(score) AS min, round(quantile_cont(score, 0.25), 4) AS p25,
  round(quantile_cont(score, 0.5), 4) AS p50, round(quantile_cont(score, 0.75), 4) AS p75, max(score) AS max
FROM spend""")
def describe(spark, sf):
    out = ranking.describe(f.spend(spark, sf), "score")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p25", "p50", "p75")})


@query("describe_by_group", """SELECT l_returnflag, count(l_extendedprice) AS count,
  round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std, min(l_extendedprice) AS min,
  round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
  round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, max(l_extendedprice) AS max
FROM lineitem GROUP BY 1""")
def describe_by_group(spark, sf):
    """Exact quartiles of three groups that each hold a third of all rows."""
    rows = f.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    out = ranking.describe(rows, "l_extendedprice", ["l_returnflag"])
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "p25", "p50", "p75")})


@query("quantiles", """SELECT round(quantile_cont(l_quantity * l_discount, 0.01), 6) AS q01,
  round(quantile_cont(l_quantity * l_discount, 0.5), 6) AS q50,
  round(quantile_cont(l_quantity * l_discount, 0.999), 6) AS q999 FROM lineitem""")
def quantiles(spark, sf):
    rows = f.table(spark, sf, "lineitem").select((F.col("l_quantity") * F.col("l_discount")).alias("x"))
    q = ranking.quantiles(rows, "x", [0.01, 0.5, 0.999])
    return q.select(*[F.round(F.get("quantiles", F.lit(i)), 6).alias(n) for i, n in enumerate(("q01", "q50", "q999"))])


@query("value_counts", "SELECT o_orderpriority, o_orderstatus, count(*) AS count FROM orders GROUP BY 1, 2")
def value_counts(spark, sf):
    return ranking.value_counts(f.table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@query("merge_phenotype", f"WITH {f.MERGED_SQL} SELECT s, score, cast(status AS int) AS status FROM merged")
def merge_phenotype(spark, sf):
    return f.scored_phenotype(spark, sf)


def _prevalence_sql(bins: int, labels, scale: str, extra: str = "") -> str:
    names = ", ".join(f"'{x}'" for x in labels)
    return f"""WITH {f.MERGED_SQL}, {_edges_sql(bins, 'merged')},
cut AS (SELECT status, {_bin_sql(bins)} AS bin FROM merged, edges)
SELECT bin, [{names}][bin] AS label, count(status) AS count, round(avg(status){scale}, 6) AS prevalence{extra}
FROM cut GROUP BY bin"""


@query("decile_prevalence", _prevalence_sql(10, association.DECILE_LABELS, " * 100"))
def decile_prevalence(spark, sf):
    out = association.prevalence_by_bin(f.scored_phenotype(spark, sf), "score", "status", 10,
                                        association.DECILE_LABELS, percent=True)
    return _rounded(out, "prevalence")


@query("quintile_prevalence", _prevalence_sql(5, association.QUINTILE_LABELS, ""))
def quintile_prevalence(spark, sf):
    out = association.prevalence_by_bin(f.scored_phenotype(spark, sf), "score", "status", 5,
                                        association.QUINTILE_LABELS)
    return _rounded(out, "prevalence")


@query("decile_bars", _prevalence_sql(10, association.DECILE_LABELS, " * 100",
                                      ", printf('%.2f%%', avg(status) * 100) AS bar_label"))
def decile_bars(spark, sf):
    return _rounded(chartdata.prevalence_bars(f.scored_phenotype(spark, sf), "score", "status"), "prevalence")


@query("cohort_totals", f"""WITH {f.MERGED_SQL} SELECT count(*) AS participants,
  cast(sum(status) AS bigint) AS cases, round(avg(status) * 100, 6) AS prevalence_percent FROM merged""")
def cohort_totals(spark, sf):
    return _rounded(association.cohort_totals(f.scored_phenotype(spark, sf), "status"), "prevalence_percent")


_TAILS = f"""{f.MERGED_SQL},
cuts AS (SELECT quantile_cont(score, 0.05) AS low, quantile_cont(score, 0.95) AS high FROM merged),
tails AS (SELECT 'Bottom 5%' AS group_label, status FROM merged, cuts WHERE score <= low
  UNION ALL SELECT 'Top 5%', status FROM merged, cuts WHERE score >= high),
facts AS (SELECT group_label, count(*) AS count, cast(sum(status) AS bigint) AS cases,
  round(avg(status) * 100, 6) AS prevalence FROM tails GROUP BY 1)"""


@query("tails", f"WITH {_TAILS} SELECT *, 'Cases=' || cases AS case_label FROM facts")
def tails(spark, sf):
    return _rounded(association.tail_groups(f.scored_phenotype(spark, sf), "score", "status"), "prevalence")


@query("tail_odds_ratio", f"""WITH {_TAILS},
odds AS (SELECT group_label, cases * 1.0 / (count - cases) AS o FROM facts)
SELECT round(t.o, 6) AS top_odds, round(b.o, 6) AS bottom_odds, round(t.o / b.o, 6) AS odds_ratio
FROM odds t, odds b WHERE t.group_label = 'Top 5%' AND b.group_label = 'Bottom 5%'""")
def tail_odds_ratio(spark, sf):
    out = association.tail_odds_ratio(f.scored_phenotype(spark, sf), "score", "status")
    return _rounded(out, "top_odds", "bottom_odds", "odds_ratio").select("top_odds", "bottom_odds", "odds_ratio")


@query("histogram", f"""WITH {f.SPEND_SQL},
span AS (SELECT min(score) AS low, max(score) AS high FROM spend),
counts AS (SELECT cast(least(floor((score - low) * 50 / (high - low)), 49) AS int) AS bin, count(*) AS n FROM spend, span GROUP BY 1)
SELECT cast(g.bin AS int) AS bin, round(low + g.bin * (high - low) / 50, 4) AS left_edge,
  round(low + (g.bin + 1) * (high - low) / 50, 4) AS right_edge, coalesce(n, 0) AS count
FROM range(50) g(bin) CROSS JOIN span LEFT JOIN counts ON counts.bin = g.bin""")
def histogram(spark, sf):
    out = chartdata.histogram(f.spend(spark, sf), "score")
    return out.withColumns({c: F.round(c, 4) for c in ("left_edge", "right_edge")})


@query("box_stats", """WITH cuts AS (SELECT lang, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS q2,
  quantile_cont(n_chars, 0.75) AS q3 FROM documents GROUP BY 1),
flagged AS (SELECT *, n_chars BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM documents JOIN cuts USING (lang))
SELECT lang, q1, q2, q3, cast(min(n_chars) FILTER (WHERE inside) AS double) AS whisker_low,
  cast(max(n_chars) FILTER (WHERE inside) AS double) AS whisker_high,
  count(*) FILTER (WHERE NOT inside) AS outliers, count(*) AS count FROM flagged GROUP BY 1, 2, 3, 4""")
def box_stats(spark, sf):
    return chartdata.box_stats(f.table(spark, sf, "documents").select("lang", "n_chars"), "n_chars", "lang")


@query("density", """WITH t AS (SELECT count(*) AS n, min(n_chars) * 1.0 AS lo, max(n_chars) * 1.0 AS hi,
  stddev_samp(n_chars) * pow(count(*), -0.2) AS h FROM documents),
g AS (SELECT i AS point, (lo - 3 * h) + i * ((hi + 3 * h) - (lo - 3 * h)) / 199 AS x, n, h FROM t, range(200) r(i)),
v AS (SELECT n_chars, count(*) AS c FROM documents GROUP BY 1)
SELECT cast(point AS int) AS point, round(any_value(x), 6) AS x,
  round(sum(c * exp(-0.5 * ((x - n_chars) / h) * ((x - n_chars) / h))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 12) AS density
FROM g, v GROUP BY point""")
def density(spark, sf):
    out = chartdata.density(f.table(spark, sf, "documents").select("n_chars"), "n_chars")
    return out.select("point", F.round("x", 6).alias("x"), F.round("density", 12).alias("density"))


@query("score_percentile_points", f"""WITH {f.SPEND_SQL}
SELECT s, round((score - avg(score) OVER ()) / stddev_samp(score) OVER (), 6) AS zscore,
  round((rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) / count(*) OVER () * 100, 6) AS percentile
FROM spend""")
def score_percentile_points(spark, sf):
    return _rounded(chartdata.score_percentile_points(f.spend(spark, sf), "s", "score"), "zscore", "percentile")
