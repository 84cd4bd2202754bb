"""Purchases and errors as weights against all other events as the variant list, minute positions on 22 chromosomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from doseloom.operators import matching
from standins import frames as f
from standins import query

WINDOW = 5
_BASE = f"{f.minutes_sql('weights', f.WEIGHT_EVENTS)}, {f.minutes_sql('clicks', f.VARIANT_EVENTS)}"
_MATCHED = f"""{_BASE}, near AS (
  SELECT w.event_id, min(abs(c.pos - w.pos)) AS distance, min_by(c.pos, (abs(c.pos - w.pos), c.pos)) AS nearest_pos
  FROM weights w JOIN clicks c ON c.chrom = w.chrom AND c.pos BETWEEN w.pos - {WINDOW} AND w.pos + {WINDOW} GROUP BY 1),
matched AS (SELECT w.*, distance, nearest_pos, CASE WHEN distance = 0 THEN 'Exact Match'
  WHEN distance IS NOT NULL THEN 'Approximate Match' ELSE 'No Match' END AS match_type
  FROM weights w LEFT JOIN near USING (event_id))"""


def _sides(spark, sf):
    return f.minutes(spark, sf, f.WEIGHT_EVENTS), f.minutes(spark, sf, f.VARIANT_EVENTS)


@query("match_exact", f"WITH {_BASE} SELECT chrom, pos FROM weights INTERSECT SELECT chrom, pos FROM clicks")
def match_exact(spark, sf):
    return matching.exact_positions(*_sides(spark, sf))


@query("match_window", f"""WITH {_MATCHED}
SELECT event_id, chrom, pos, nearest_pos, distance, match_type FROM matched""")
def match_window(spark, sf):
    return matching.match_weights(*_sides(spark, sf), WINDOW) \
        .select("event_id", "chrom", "pos", "nearest_pos", "distance", "match_type")


@query("match_summary", f"""WITH {_MATCHED}, t AS (SELECT count(*) AS n FROM weights)
SELECT n AS weight_rows, count(DISTINCT CASE WHEN distance = 0 THEN chrom || ':' || pos END) AS exact_positions,
       round(count(DISTINCT CASE WHEN distance = 0 THEN chrom || ':' || pos END) * 100.0 / n, 6) AS exact_percent,
       count(DISTINCT CASE WHEN distance > 0 THEN chrom || ':' || pos END) AS approximate_positions,
       round(count(DISTINCT CASE WHEN distance > 0 THEN chrom || ':' || pos END) * 100.0 / n, 6) AS approximate_percent,
       round(avg(CASE WHEN distance > 0 THEN distance END), 6) AS mean_distance,
       round(count(CASE WHEN distance = 0 THEN 1 END) * 100.0 / n, 6) AS exact_row_percent,
       round(count(CASE WHEN distance > 0 THEN 1 END) * 100.0 / n, 6) AS approximate_row_percent
FROM matched, t GROUP BY n""")
def match_summary(spark, sf):
    out = matching.coverage_summary(*_sides(spark, sf), WINDOW)
    rounded = [c for c in out.columns if c.endswith("percent") or c == "mean_distance"]
    return out.withColumns({c: F.round(c, 6) for c in rounded})


@query("match_examples", f"""WITH {_MATCHED}
SELECT match_type, event_id, pos, nearest_pos, example FROM (
  SELECT *, row_number() OVER (PARTITION BY match_type ORDER BY chrom, pos, event_id) AS example FROM matched)
WHERE example <= 5""")
def match_examples(spark, sf):
    """Report of the first five rows of each match type."""
    matched = matching.match_weights(*_sides(spark, sf), WINDOW)
    return matching.match_examples(matched, ["chrom", "pos", "event_id"]) \
        .select("match_type", "event_id", "pos", "nearest_pos", F.col("example").cast("long").alias("example"))
