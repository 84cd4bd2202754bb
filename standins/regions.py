"""Region slices, variant lines and consensus sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from doseloom.operators import regions
from standins import frames as f
from standins import query

REGION = "chr6:31-931"


@query("region_slice", f"""WITH {f.VARIANTS_SQL}, {f.CALLS_SQL}
SELECT contig, position, s FROM calls JOIN variants USING (p_partkey)
WHERE contig = 'chr6' AND position >= 31 AND position < 931
  AND s IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)""")
def region_slice(spark, sf):
    wanted = f.table(spark, sf, "customer").where(F.col("c_acctbal") >= 0).select(F.col("c_custkey").alias("s"))
    return regions.slice_region(f.calls(spark, sf), REGION, samples=wanted).select("contig", "position", "s")


@query("region_count", f"""WITH {f.VARIANTS_SQL}, {f.CALLS_SQL}
SELECT count(DISTINCT position) AS n_variants FROM calls JOIN variants USING (p_partkey)
WHERE contig = 'chr6' AND position BETWEEN 31 AND 931""")
def region_count(spark, sf):
    return regions.count_variants(regions.slice_region(f.calls(spark, sf), REGION, end_inclusive=True))


LINES_SQL = f"""WITH {f.VARIANTS_SQL}, {f.CALLS_SQL}
SELECT s, contig || chr(9) || position || chr(9) || '.' || chr(9) || ref || chr(9) || concat_ws(',', alt1, alt2)
  || chr(9) || '.' || chr(9) || '.' || chr(9) || '.' || chr(9) || 'GT:FT' || chr(9)
  || CASE WHEN kind = 0 THEN '0/0' WHEN kind = 1 THEN '0/1' WHEN kind = 2 THEN '1/1' WHEN kind = 3 THEN './.'
          WHEN alt2 IS NULL THEN '0/1' ELSE '1/2' END
  || ':' || CASE flag WHEN 'A' THEN 'PASS' WHEN 'N' THEN 'FAIL' ELSE '.' END AS line
FROM calls JOIN variants USING (p_partkey)"""


@query("variant_lines", LINES_SQL)
def variant_lines(spark, sf):
    return regions.variant_lines(f.calls(spark, sf)).select("s", "line")


def reference_bases(spark, sf, chunk: int = regions.CHUNK):
    """The reference of chr6: the base of each part key, in chunks."""
    key = F.col("p_partkey")
    return (f.table(spark, sf, "part").where(key >= 1)
            .select(F.floor((key - 1) / chunk).alias("chunk"), F.struct(key, f.base(key).alias("base")).alias("b"))
            .groupBy("chunk").agg(F.sort_array(F.collect_list("b")).alias("bs"))
            .select(F.lit("chr6").alias("contig"), (F.col("chunk") * chunk + 1).alias("chunk_start"),
                    F.array_join("bs.base", "").alias("bases")))


#: Fixed, so that the output grows with the samples and not with samples x bases.
CONSENSUS_REGION = "chr6:101-1600"


@query("consensus", f"""WITH {f.VARIANTS_SQL}, {f.CALLS_SQL},
edits AS (SELECT s, p_partkey, CASE WHEN kind IN (1, 2, 4) THEN alt1 ELSE ref END AS b
  FROM calls JOIN variants USING (p_partkey) WHERE contig = 'chr6'),
grid AS (SELECT c_custkey AS s, p_partkey, {f.sql_base('p_partkey')} AS ref FROM customer CROSS JOIN part
  WHERE p_partkey BETWEEN 101 AND 1600)
SELECT s, 'chr6' AS contig, greatest((p_partkey - 1) // 1000 * 1000 + 1, 101) AS chunk_start,
  string_agg(coalesce(e.b, g.ref), '' ORDER BY p_partkey) AS sequence
FROM grid g LEFT JOIN edits e USING (s, p_partkey) GROUP BY 1, 2, 3""")
def consensus(spark, sf):
    """Single-base variants over a fixed region."""
    return regions.consensus(f.samples(spark, sf), f.calls(spark, sf), reference_bases(spark, sf), CONSENSUS_REGION)


def indel_calls(spark, sf):
    """The same calls with deletions for big parts and insertions for small ones."""
    sizes = f.table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("position"), "p_size")
    key = F.col("position")
    longer = F.concat(f.base(key), f.base(key + 1), f.base(key + 2))
    alleles = (F.when(F.col("p_size") > 35, F.array(longer, f.base(key)))
               .when(F.col("p_size") < 15, F.array(f.base(key), F.concat(f.base(key), F.lit("TT"))))
               .otherwise(F.slice("alleles", 1, 2)))
    gt = F.transform("gt", lambda a: F.least(a, F.lit(1)))
    # All parts on one contig, so that spans really overlap.
    return f.calls(spark, sf).join(sizes, "position").select(
        F.lit("chr6").alias("contig"), "position", alleles.alias("alleles"), "s", gt.alias("gt"))


_EDITS = f"""{f.VARIANTS_SQL}, {f.CALLS_SQL},
{{edits}} AS (SELECT s, start, start + length(ref) AS stop, alt, ref FROM (
  SELECT s, position AS start, CASE WHEN p_size > 35 THEN {f.sql_base('p_partkey')} || {f.sql_base('p_partkey + 1')} || {f.sql_base('p_partkey + 2')}
      ELSE {f.sql_base('p_partkey')} END AS ref,
    CASE WHEN p_size > 35 THEN {f.sql_base('p_partkey')} WHEN p_size < 15 THEN {f.sql_base('p_partkey')} || 'TT' ELSE alt1 END AS alt
  FROM calls JOIN variants USING (p_partkey) JOIN part USING (p_partkey) WHERE kind IN (1, 2, 4)) {{where}}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY start) - 1 AS idx FROM edits),
pointed AS (SELECT a.s, a.start, a.stop, a.alt, a.ref, a.idx, count(b.s) AS jump FROM numbered a JOIN numbered b ON b.s = a.s AND b.start < a.stop
  GROUP BY ALL),
applied AS (SELECT * FROM pointed WHERE idx = 0 UNION ALL SELECT p.* FROM applied a JOIN pointed p ON p.s = a.s AND p.idx = a.jump)"""


@query("consensus_indels", f"""WITH RECURSIVE {_EDITS.format(edits='edits', where='WHERE start BETWEEN 101 AND 1600 AND start + length(ref) - 1 <= 1600')},
grid AS (SELECT c_custkey AS s, p_partkey AS p, {f.sql_base('p_partkey')} AS base FROM customer CROSS JOIN part WHERE p_partkey BETWEEN 101 AND 1600),
covered AS (SELECT s, unnest(range(start, stop)) AS p, start, alt FROM applied)
SELECT g.s, 'chr6' AS contig, greatest((g.p - 1) // 1000 * 1000 + 1, 101) AS chunk_start,
  string_agg(CASE WHEN c.p IS NULL THEN base WHEN c.p = c.start THEN alt ELSE '' END, '' ORDER BY g.p) AS sequence
FROM grid g LEFT JOIN covered c ON c.s = g.s AND c.p = g.p GROUP BY 1, 2, 3""")
def consensus_indels(spark, sf):
    """Overlapping deletions and insertions."""
    return regions.consensus(f.samples(spark, sf), indel_calls(spark, sf), reference_bases(spark, sf), CONSENSUS_REGION)


@query("applied_edits", f"""WITH RECURSIVE {_EDITS.format(edits='edits', where='')}
SELECT s, 'chr6' AS contig, start, stop, alt, ref FROM applied""")
def applied_edits(spark, sf):
    """First variant wins among overlapping ones."""
    return regions.applied_edits(indel_calls(spark, sf))
