"""Events as alignment records: pairs, lists, matrices and row checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from doseloom.operators import incidence
from doseloom.sources import writers
from standins import frames as f
from standins import query


def _pairs(spark, sf):
    return incidence.node_pairs(f.records(spark, sf))


@query("node_pairs", f"WITH {f.PAIRS_SQL} SELECT name, node_id FROM pairs")
def node_pairs(spark, sf):
    return _pairs(spark, sf)


@query("node_lists", f"""WITH {f.PAIRS_SQL}, p AS (
  SELECT name, node_id, (row_number() OVER (PARTITION BY name ORDER BY node_id) - 1) // 4 AS part FROM pairs)
SELECT name, cast(part AS int) AS part, string_agg(node_id, ',' ORDER BY node_id) AS nodes FROM p GROUP BY 1, 2""")
def node_lists(spark, sf):
    """Lists in pieces of four nodes, in string order."""
    lists = incidence.node_lists(_pairs(spark, sf), piece=4)
    return lists.withColumn("nodes", F.array_join("nodes", ","))


@query("readable_lines", f"""WITH {f.PAIRS_SQL}
SELECT name, chr(10) || name || ':' || chr(10) || 'Nodes: ' || string_agg(node_id, ', ' ORDER BY node_id) AS value
FROM pairs GROUP BY 1""")
def readable_lines(spark, sf):
    return writers.readable_lines(_pairs(spark, sf)).select("name", "value")


@query("presence_matrix", f"""WITH {f.PAIRS_SQL}, names AS (SELECT DISTINCT name FROM pairs),
nodes AS (SELECT DISTINCT node_id FROM pairs)
SELECT name, string_agg(CASE WHEN p.node_id IS NULL THEN '0' ELSE '1' END, '' ORDER BY n.node_id) AS bits
FROM names CROSS JOIN nodes n LEFT JOIN pairs p USING (name, node_id) GROUP BY 1""")
def presence_matrix(spark, sf):
    """The wide matrix, shown as one string of bits so that the width is no schema."""
    blocks = incidence.matrix_blocks(_pairs(spark, sf), width=16).select("name", "block", F.array_join("cells", "").alias("bits"))
    return blocks.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("block", "bits"))).alias("b")) \
        .select("name", F.array_join("b.bits", "").alias("bits"))


@query("sparse_matrix", f"""WITH {f.PAIRS_SQL},
r AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS row_id FROM (SELECT DISTINCT name FROM pairs)),
c AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS col_id FROM (SELECT DISTINCT node_id FROM pairs))
SELECT row_id, col_id FROM pairs JOIN r USING (name) JOIN c USING (node_id)""")
def sparse_matrix(spark, sf):
    pairs = _pairs(spark, sf)
    return incidence.sparse_matrix(pairs, *incidence.matrix_axes(pairs))


_NAMED_SQL = "named AS (SELECT DISTINCT cast(user_id AS varchar) || ':' || event_type AS name FROM events)"


@query("mixed_rows", f"""WITH {f.PAIRS_SQL}, {_NAMED_SQL}, w AS (SELECT count(DISTINCT node_id) AS width FROM pairs),
o AS (SELECT named.name, count(node_id) AS ones FROM named LEFT JOIN pairs USING (name) GROUP BY 1)
SELECT name, ones, width - ones AS zeros, ones > 0 AND width > ones AS mixed FROM o, w""")
def mixed_rows(spark, sf):
    records = f.records(spark, sf)
    return incidence.row_homogeneity(incidence.node_pairs(records), incidence.names_with_mapping(records))


@query("wide_mixed_rows", f"""WITH {f.PAIRS_SQL}, w AS (SELECT count(DISTINCT node_id) AS width FROM pairs),
o AS (SELECT name, count(*) AS ones FROM pairs GROUP BY 1)
SELECT name, cast(ones AS int) AS ones, cast(width - ones AS int) AS zeros, ones > 0 AND width > ones AS mixed,
  CASE WHEN width > ones THEN '0,1' ELSE '1' END AS row_values FROM o, w""")
def wide_mixed_rows(spark, sf):
    pairs = _pairs(spark, sf)
    out = incidence.block_row_homogeneity(incidence.matrix_blocks(pairs, width=16))
    return out.withColumns({"row_values": F.array_join("row_values", ","), "ones": F.col("ones").cast("int"),
                            "zeros": F.col("zeros").cast("int")})


@query("distinct_cells", f"""WITH {f.PAIRS_SQL}, names AS (SELECT DISTINCT name FROM pairs),
nodes AS (SELECT DISTINCT node_id FROM pairs)
SELECT DISTINCT CASE WHEN p.node_id IS NULL THEN 0 ELSE 1 END AS value
FROM names CROSS JOIN nodes n LEFT JOIN pairs p USING (name, node_id)""")
def distinct_cells(spark, sf):
    return incidence.distinct_cells(_pairs(spark, sf))


@query("node_summary", f"""WITH {f.PAIRS_SQL}, names AS (SELECT DISTINCT name FROM pairs),
nodes AS (SELECT DISTINCT node_id FROM pairs),
cells AS (SELECT n.node_id, CASE WHEN p.node_id IS NULL THEN 0.0 ELSE 1.0 END::double AS v
  FROM names CROSS JOIN nodes n LEFT JOIN pairs p USING (name, node_id))
SELECT node_id, count(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min,
  round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50,
  round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS max FROM cells GROUP BY 1""")
def node_summary(spark, sf):
    out = incidence.node_summary(_pairs(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})
