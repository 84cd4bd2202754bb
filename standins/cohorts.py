"""Cohort predicates, dimension labels and concept hierarchies."""

from __future__ import annotations

from pyspark.sql import functions as F

from doseloom.operators import cohort, hierarchy
from standins import frames as f
from standins import query


def _customers(spark, sf):
    return f.table(spark, sf, "customer").select("c_custkey", "c_nationkey")


def _orders(spark, sf, condition):
    return f.table(spark, sf, "orders").where(condition).select(F.col("o_custkey").alias("c_custkey"))


_URGENT_OPEN = "o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'"


@query("cohort_semi", f"""SELECT c_custkey, c_nationkey FROM customer
WHERE c_custkey IN (SELECT DISTINCT o_custkey FROM orders WHERE {_URGENT_OPEN})""")
def cohort_semi(spark, sf):
    return cohort.keep_ids(_customers(spark, sf), _orders(spark, sf, _URGENT_OPEN), "c_custkey")


@query("cohort_anti", f"""SELECT c_custkey, c_nationkey FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND {_URGENT_OPEN})""")
def cohort_anti(spark, sf):
    return cohort.drop_ids(_customers(spark, sf), _orders(spark, sf, _URGENT_OPEN), "c_custkey")


@query("cohort_not_in", f"""SELECT c_custkey, c_nationkey FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {_URGENT_OPEN})""")
def cohort_not_in(spark, sf):
    return cohort.not_in(_customers(spark, sf), _orders(spark, sf, _URGENT_OPEN), "c_custkey")


@query("cohort_not_in_nulls", """WITH keyed AS (
  SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS nation FROM customer),
no_ids AS (SELECT s_nationkey AS nation FROM supplier WHERE s_acctbal > 1e9),
plain_ids AS (SELECT s_nationkey AS nation FROM supplier WHERE s_acctbal > 5000),
holes AS (SELECT CASE WHEN s_acctbal > 9000 THEN s_nationkey END AS nation FROM supplier)
SELECT 'empty' AS ids, count(*) AS kept FROM keyed WHERE nation NOT IN (SELECT nation FROM no_ids)
UNION ALL SELECT 'plain', count(*) FROM keyed WHERE nation NOT IN (SELECT nation FROM plain_ids)
UNION ALL SELECT 'with_null', count(*) FROM keyed WHERE nation NOT IN (SELECT nation FROM holes)""")
def cohort_not_in_nulls(spark, sf):
    """NOT IN against no ids, plain ids, and ids with a NULL."""
    keyed = f.table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("nation"))
    supplier = f.table(spark, sf, "supplier")
    id_sets = {
        "empty": supplier.where(F.col("s_acctbal") > 1e9).select(F.col("s_nationkey").alias("nation")),
        "plain": supplier.where(F.col("s_acctbal") > 5000).select(F.col("s_nationkey").alias("nation")),
        "with_null": supplier.select(F.when(F.col("s_acctbal") > 9000, F.col("s_nationkey")).alias("nation"))}
    out = None
    for name, ids in id_sets.items():
        row = cohort.not_in(keyed, ids, "nation").agg(F.count(F.lit(1)).alias("kept")) \
            .select(F.lit(name).alias("ids"), "kept")
        out = row if out is None else out.unionByName(row)
    return out


@query("cohort_union", """SELECT o_custkey AS c_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000
UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 20000""")
def cohort_union(spark, sf):
    return cohort.union_ids(
        _orders(spark, sf, "o_orderpriority = '1-URGENT' AND o_totalprice > 400000"),
        _orders(spark, sf, "o_orderstatus = 'F' AND o_totalprice < 20000"), key="c_custkey")


@query("cohort_intersect", """SELECT o_custkey AS c_custkey FROM orders WHERE o_totalprice > 400000
INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice < 20000""")
def cohort_intersect(spark, sf):
    return cohort.intersect_ids(_orders(spark, sf, "o_totalprice > 400000"),
                                _orders(spark, sf, "o_totalprice < 20000"), "c_custkey")


@query("cohort_nested_in", """SELECT l_returnflag, l_linestatus, count(*) AS rows_kept FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (
  SELECT c_custkey FROM customer WHERE c_nationkey IN (
    SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA'))))
GROUP BY 1, 2""")
def cohort_nested_in(spark, sf):
    asia = f.table(spark, sf, "region").where(F.col("r_name") == "ASIA")
    nations = cohort.keep_ids(f.table(spark, sf, "nation"), asia, "n_regionkey", "r_regionkey")
    customers = cohort.keep_ids(f.table(spark, sf, "customer"), nations, "c_nationkey", "n_nationkey")
    orders = cohort.keep_ids(f.table(spark, sf, "orders"), customers, "o_custkey", "c_custkey")
    lines = cohort.keep_ids(f.table(spark, sf, "lineitem"), orders, "l_orderkey", "o_orderkey")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("rows_kept"))


@query("cohort_records", """SELECT c_custkey AS person_id FROM customer WHERE c_custkey IN (
  SELECT DISTINCT c_custkey FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING')""")
def cohort_records(spark, sf):
    customers = f.table(spark, sf, "customer")
    search = customers.select(F.col("c_custkey").alias("person_id"),
                              (F.col("c_acctbal") > 0).cast("int").alias("has_ehr_data"),
                              (F.col("c_mktsegment") == "BUILDING").cast("int").alias("has_whole_genome_variant"))
    return cohort.genome_and_records_cohort(customers.select(F.col("c_custkey").alias("person_id")), search)


@query("dimension_labels", """SELECT s_suppkey, s.s_nationkey, n.n_name AS nation, n.n_regionkey, r.r_name AS region
FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")
def dimension_labels(spark, sf):
    nation, region = f.table(spark, sf, "nation"), f.table(spark, sf, "region")
    keyed = nation.select("n_nationkey", "n_regionkey")
    rows = f.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    rows = cohort.with_dimension(rows, nation, "n_nationkey", "n_name", {"s_nationkey": "nation"})
    rows = rows.join(keyed, rows.s_nationkey == keyed.n_nationkey, "left").drop("n_nationkey")
    return cohort.with_dimension(rows, region, "r_regionkey", "r_name", {"n_regionkey": "region"})


_PERSON_SQL = """person AS (SELECT c_custkey AS person_id, c_nationkey AS gender_concept_id,
  c_nationkey + 5 AS race_concept_id, length(c_mktsegment) AS ethnicity_concept_id,
  cast(floor(c_acctbal / 1000) AS int) AS sex_at_birth_concept_id FROM customer)"""


@query("person_labels", f"""WITH {_PERSON_SQL}
SELECT person_id, gender_concept_id, a.n_name AS gender, race_concept_id, b.n_name AS race,
       ethnicity_concept_id, c.n_name AS ethnicity, sex_at_birth_concept_id, d.n_name AS sex_at_birth
FROM person LEFT JOIN nation a ON a.n_nationkey = gender_concept_id LEFT JOIN nation b ON b.n_nationkey = race_concept_id
LEFT JOIN nation c ON c.n_nationkey = ethnicity_concept_id LEFT JOIN nation d ON d.n_nationkey = sex_at_birth_concept_id""")
def person_labels(spark, sf):
    """Four left joins to one dimension; ids without a name stay."""
    person = f.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("person_id"), F.col("c_nationkey").alias("gender_concept_id"),
        F.lit(None).cast("timestamp").alias("birth_datetime"),
        (F.col("c_nationkey") + 5).alias("race_concept_id"),
        F.length("c_mktsegment").alias("ethnicity_concept_id"),
        F.floor(F.col("c_acctbal") / 1000).cast("int").alias("sex_at_birth_concept_id"))
    concept = f.table(spark, sf, "nation").select(F.col("n_nationkey").alias("concept_id"),
                                                  F.col("n_name").alias("concept_name"))
    return cohort.person_labels(person, concept).drop("date_of_birth")


@query("cohort_sizes", """SELECT 'all' AS cohort, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_persons FROM orders
UNION ALL SELECT 'urgent', count(*), count(DISTINCT o_custkey) FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT 'open', count(*), count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'O'""")
def cohort_sizes(spark, sf):
    orders = f.table(spark, sf, "orders").withColumnRenamed("o_custkey", "person_id")
    return cohort.cohort_sizes({"all": orders, "urgent": orders.where("o_orderpriority = '1-URGENT'"),
                                "open": orders.where("o_orderstatus = 'O'")})


@query("event_cohort", """SELECT DISTINCT o_custkey AS person_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE l_linestatus = 'O' AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
UNION SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE l_linestatus = 'F' AND l_suppkey = 7 AND l_linenumber = 3""")
def event_cohort(spark, sf):
    """Persons by a concept set, or by one source concept and value."""
    lines = f.table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_linestatus", "l_linenumber")
    orders = f.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    events = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("person_id"), F.col("l_suppkey").alias("concept_id"),
        (F.col("l_linestatus") == "O").cast("int").alias("is_standard"),
        F.col("l_linenumber").alias("value_source_concept_id"))
    concepts = f.table(spark, sf, "supplier").where(F.col("s_acctbal") < 0).select(F.col("s_suppkey").alias("concept_id"))
    return cohort.union_ids(cohort.event_cohort(events, concepts=concepts),
                            cohort.event_cohort(events, concept_ids=[7], is_standard=0, value_source_ids=[3]),
                            key="person_id")


_PATHS_SQL = """nodes AS (SELECT c_custkey AS id, c_custkey AS concept_id,
  cast(n_regionkey AS varchar) || '.' || cast(c_nationkey AS varchar) || '.' || cast(c_custkey AS varchar) AS path,
  c_mktsegment AS segment FROM customer JOIN nation ON n_nationkey = c_nationkey),
roots AS (SELECT cast(s_suppkey AS varchar) AS id FROM supplier WHERE s_acctbal > 9000)"""


def _paths(spark, sf):
    nation = f.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    customer = f.table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").alias("concept_id"),
        F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("c_nationkey").cast("string"),
                    F.col("c_custkey").cast("string")).alias("path"), F.col("c_mktsegment").alias("segment"))


def _roots(spark, sf):
    return f.table(spark, sf, "supplier").where(F.col("s_acctbal") > 9000).select(F.col("s_suppkey").alias("id"))


@query("hierarchy_element", f"""WITH {_PATHS_SQL} SELECT id, path FROM nodes n WHERE EXISTS (
  SELECT 1 FROM roots a WHERE n.path LIKE '%.' || a.id || '.%' OR n.path LIKE '%.' || a.id
    OR n.path LIKE a.id || '.%' OR n.path = a.id)""")
def hierarchy_element(spark, sf):
    return hierarchy.by_path_element(_paths(spark, sf), _roots(spark, sf)).select("id", "path")


@query("hierarchy_substring", f"""WITH {_PATHS_SQL} SELECT id, path FROM nodes n WHERE EXISTS (
  SELECT 1 FROM roots a WHERE n.path LIKE '%' || a.id || '.%')""")
def hierarchy_substring(spark, sf):
    return hierarchy.by_path_substring(_paths(spark, sf), _roots(spark, sf)).select("id", "path")


@query("concept_descendants", f"""WITH {_PATHS_SQL}, criteria AS (
  SELECT *, '[' || segment || '_rank' || length(segment) || ']' AS full_text FROM nodes)
SELECT DISTINCT concept_id FROM criteria c WHERE segment <> 'MACHINERY' AND EXISTS (
  SELECT 1 FROM criteria a WHERE a.concept_id BETWEEN 3 AND 12 AND a.full_text LIKE '%_rank9]%'
  AND (c.path LIKE '%.' || a.id || '.%' OR c.path LIKE '%.' || a.id OR c.path LIKE a.id || '.%' OR c.path = cast(a.id AS varchar)))""")
def concept_descendants(spark, sf):
    criteria = (_paths(spark, sf)
                .withColumn("full_text", F.concat(F.lit("["), F.col("segment"), F.lit("_rank"),
                                                  F.length("segment").cast("string"), F.lit("]")))
                .withColumn("is_standard", F.lit(1))
                .withColumn("is_selectable", (F.col("segment") != "MACHINERY").cast("int")))
    return hierarchy.concept_descendants(criteria, list(range(3, 13)), "%_rank9]%")


@query("survey_questions", f"""WITH {_PATHS_SQL} SELECT DISTINCT concept_id FROM nodes c
WHERE segment IN ('HOUSEHOLD', 'FURNITURE') AND EXISTS (SELECT 1 FROM nodes a
  WHERE a.concept_id IN (1, 2, 20) AND c.path LIKE '%' || cast(a.id AS varchar) || '.%')""")
def survey_questions(spark, sf):
    """Questions below given surveys, with the substring path test."""
    is_question = F.col("segment").isin("HOUSEHOLD", "FURNITURE")
    criteria = (_paths(spark, sf).withColumn("domain_id", F.lit("SURVEY"))
                .withColumn("type", F.when(is_question, "PPI").otherwise("OTHER"))
                .withColumn("subtype", F.when(is_question, "QUESTION").otherwise("ANSWER")))
    return hierarchy.survey_questions(criteria, [1, 2, 20])


@query("phenotype_flag", f"WITH {f.PHENOTYPE_SQL} SELECT s, cast(status AS int) AS status FROM phenotype")
def phenotype_flag(spark, sf):
    return cohort.phenotype_flag(f.conditions(spark, sf), "person_id", "condition_source_value", f.CODES)
