"""Every file format written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from doseloom.operators import incidence, intervals, regions, scoring
from doseloom.plans import storage
from doseloom.sources import readers, schemas, writers
from standins import fits, query
from standins import frames as f
from standins.genetics import _DOSAGE, _FULL, _SCORE_COLUMNS, _dense, _rounded
from standins.regions import LINES_SQL, REGION

_EDGES_SQL = "edges AS (SELECT quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS e FROM spend)"


def _uri(spark, label: str) -> str:
    return storage.new_folder(spark, label)


@query("file_scoring", f"""WITH {f.WEIGHTS_SQL}
SELECT chr, position AS bp, effect_allele, weight, contig, position FROM weights""")
def file_scoring(spark, sf):
    """Gzip scoring file with comment lines, read, prepared and located."""
    raw = f.raw_weights(spark, sf)
    body = raw.select(F.col("effect_allele"), F.col("chr").alias("hm_chr"), F.col("bp").alias("hm_pos"),
                      F.col("weight").alias("effect_weight"))
    comment = raw.agg(F.concat(F.lit("#variants="), F.count(F.lit(1)).cast("string")).alias("effect_allele"))
    lines = body.unionByName(comment, allowMissingColumns=True)
    uri = _uri(spark, "scoring")
    # The writer would quote a leading #; another comment mark keeps it plain.
    (lines.write.option("sep", "\t").option("header", True).option("comment", "~")
     .option("compression", "gzip").csv(uri))
    return readers.locate_weights(readers.prepare_weights(readers.scoring_file(spark, uri)))


@query("file_weights", f"""WITH {f.WEIGHTS_SQL}
SELECT chr, position AS bp, effect_allele, weight, contig, position FROM weights""")
def file_weights(spark, sf):
    """Prepared weight CSV, rebuilt with its locus, saved and read once more."""
    first = writers.weights(f.raw_weights(spark, sf), _uri(spark, "weights"))
    second = writers.weights(readers.weight_csv(spark, first), _uri(spark, "weights"))
    return readers.located_weight_csv(spark, second)


@query("file_variant_list", f"""WITH {f.VARIANTS_SQL}
SELECT replace(contig, 'chr', '') AS chrom, position AS pos FROM variants""")
def file_variant_list(spark, sf):
    """Blank-separated variant list with composite ids."""
    rows = f.variants(spark, sf)
    name = F.concat_ws(":", F.upper("contig"), F.col("position").cast("string"),
                       F.get("alleles", F.lit(0)), F.get("alleles", F.lit(1)))
    uri = _uri(spark, "variant-list")
    rows.select(F.concat(F.lit(" "), F.col("contig"), F.lit("   "), name, F.lit(" \t 0  0 A G")).alias("value")) \
        .write.text(uri)
    return readers.variant_list(spark, uri).select("chrom", "pos")


@query("file_processed_weights", f"""WITH {f.WEIGHTS_SQL}
SELECT replace(contig, 'chr', '') AS chrom, position AS pos, effect_allele, weight, 'v' || position AS id FROM weights""")
def file_processed_weights(spark, sf):
    rows = f.weights(spark, sf).select(F.upper("contig").alias("chr"), F.col("position").alias("pos"),
                                       "effect_allele", "weight",
                                       F.concat(F.lit("v"), F.col("position").cast("string")).alias("id"))
    return readers.processed_weights(spark, writers.csv(rows, _uri(spark, "processed")))


@query("file_intervals", f"""WITH {f.VARIANTS_SQL}, {f.WEIGHTS_SQL}
SELECT contig, position FROM variants JOIN weights USING (contig, position) WHERE contig <> 'chr23'
  AND contig <> 'chr24' AND contig <> 'chr25'""")
def file_intervals(spark, sf):
    """Point intervals as headerless text; contigs outside the genome are skipped."""
    uri = writers.weight_intervals(f.weights(spark, sf), _uri(spark, "intervals"))
    kept = readers.intervals(spark, uri, readers.genome_contigs(spark))
    return intervals.at_points(f.variants(spark, sf), kept).select("contig", "position")


@query("file_alignments", f"WITH {f.PAIRS_SQL} SELECT name, node_id FROM pairs")
def file_alignments(spark, sf):
    """JSON lines with a broken line per event type."""
    records = f.records(spark, sf)
    broken = f.table(spark, sf, "events").select(F.concat(F.lit('{"name": "'), "event_type").alias("value")).distinct()
    uri = _uri(spark, "alignments")
    records.select(F.to_json(F.struct("name", "path")).alias("value")).unionByName(broken).write.text(uri)
    return incidence.node_pairs(readers.alignments(spark, uri))


@query("file_node_lists", f"""WITH {f.PAIRS_SQL}
SELECT name, string_agg(node_id, ',' ORDER BY node_id) AS nodes FROM pairs GROUP BY 1""")
def file_node_lists(spark, sf):
    uri = writers.node_lists_json(incidence.node_pairs(f.records(spark, sf)), _uri(spark, "nodes"))
    lists = spark.read.schema("name string, part int, nodes array<string>").json(uri)
    return lists.select("name", F.array_join("nodes", ",").alias("nodes"))


@query("file_matrix", f"""WITH {f.PAIRS_SQL}, w AS (SELECT count(DISTINCT node_id) AS width FROM pairs),
o AS (SELECT name, count(*) AS ones FROM pairs GROUP BY 1)
SELECT name, cast(ones AS int) AS ones, cast(width - ones AS int) AS zeros FROM o, w""")
def file_matrix(spark, sf):
    uri = writers.presence_csv(incidence.node_pairs(f.records(spark, sf)), _uri(spark, "matrix"), width=24, file_rows=200)
    checked = None
    for wide in readers.incidence_blocks(spark, uri):
        part = incidence.wide_row_homogeneity(wide).select("name", "ones", "zeros")
        checked = part if checked is None else checked.unionByName(part)
    return checked.groupBy("name").agg(F.sum("ones").cast("int").alias("ones"), F.sum("zeros").cast("int").alias("zeros"))


@query("file_sparse_matrix", f"""WITH {f.PAIRS_SQL} SELECT name, node_id FROM pairs""")
def file_sparse_matrix(spark, sf):
    """Ones and both axes as tables, joined back to names."""
    root = writers.sparse_matrix(incidence.node_pairs(f.records(spark, sf)), _uri(spark, "sparse"))
    ones, rows, cols = (spark.read.parquet(f"{root}/{part}") for part in ("ones", "rows", "cols"))
    return ones.join(rows, "row_id").join(cols, "col_id").select("name", "node_id")


@query("file_person_ids", "SELECT cast(c_custkey AS varchar) AS person_id FROM customer WHERE c_acctbal > 0")
def file_person_ids(spark, sf):
    cohort = f.table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("person_id"))
    return readers.person_ids(spark, writers.person_ids(cohort, _uri(spark, "ids")))


@query("file_flagged_samples", "SELECT cast(c_custkey AS varchar) AS sample_id FROM customer WHERE c_acctbal < 0")
def file_flagged_samples(spark, sf):
    flagged = f.table(spark, sf, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("sample_id"))
    return readers.flagged_samples(spark, writers.csv(flagged, _uri(spark, "flagged"), sep="\t"))


@query("file_scores", f"""WITH {_FULL}, {_dense(_DOSAGE)}, t AS (SELECT {_SCORE_COLUMNS} FROM scores)
SELECT cast(s AS varchar) AS s, total_score, variant_count, normalized_score FROM t""")
def file_scores(spark, sf):
    """Score table, its CSV, and the CSV read back."""
    scored = _rounded(scoring.score_samples(f.samples(spark, sf), f.variants(spark, sf),
                                            f.calls(spark, sf), f.weights(spark, sf), sampled=f.sampled_calls(spark, sf)))
    uri = _uri(spark, "scores-csv")
    writers.scores(scored, _uri(spark, "scores"), uri)
    return readers.scores_csv(spark, uri)


@query("file_found_variants", f"""WITH {f.VARIANTS_SQL}, {f.WEIGHTS_SQL}
SELECT contig, position, concat_ws(',', ref, alt1, alt2) AS alleles, effect_allele, weight
FROM variants JOIN weights USING (contig, position)""")
def file_found_variants(spark, sf):
    uri = writers.found_variants(scoring.found_variants(f.variants(spark, sf), f.weights(spark, sf)),
                                 _uri(spark, "found"))
    return readers.typed_csv(spark, uri, "contig string, position int, alleles string, "
                                         "effect_allele string, weight double")


@query("file_standardised", f"""WITH {f.SPEND_SQL}, {_EDGES_SQL}
SELECT cast(s AS varchar) AS s, score AS total_score,
  round((score - avg(score) OVER ()) / stddev_samp(score) OVER (), 6) AS prs_zscore,
  round((rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) / count(*) OVER () * 100, 6)
    AS prs_percentile,
  CASE WHEN score <= e[1] THEN 'Very Low' WHEN score <= e[2] THEN 'Low' WHEN score <= e[3] THEN 'Average'
       WHEN score <= e[4] THEN 'High' ELSE 'Very High' END AS risk_category FROM spend, edges""")
def file_standardised(spark, sf):
    """Standardised scores saved as CSV and read back."""
    from doseloom.plans.workflows import standardise
    uri = _uri(spark, "standardised")
    standardise(f.spend(spark, sf).withColumnRenamed("score", "total_score"), uri)
    back = readers.typed_csv(spark, uri, "s string, total_score double, prs_zscore double, "
                                         "prs_percentile double, risk_category string")
    return back.withColumns({c: F.round(c, 6) for c in ("prs_zscore", "prs_percentile")})


@query("file_sample_sequences", f"""WITH {f.VARIANTS_SQL}, {f.CALLS_SQL},
edits AS (SELECT s, p_partkey, CASE WHEN kind IN (1, 2, 4) THEN alt1 ELSE ref END AS b
  FROM calls JOIN variants USING (p_partkey) WHERE contig = 'chr6'),
grid AS (SELECT c_custkey AS s, p_partkey, {f.sql_base('p_partkey')} AS ref
  FROM customer CROSS JOIN part WHERE p_partkey BETWEEN 101 AND 1600)
SELECT s, string_agg(coalesce(e.b, g.ref), '' ORDER BY p_partkey) AS line
FROM grid g LEFT JOIN edits e USING (s, p_partkey) GROUP BY s, (p_partkey - 1) // 1000
UNION ALL SELECT c_custkey, '>chr6' FROM customer""")
def file_sample_sequences(spark, sf):
    """One FASTA folder per sample."""
    from standins.regions import CONSENSUS_REGION, reference_bases
    samples = f.samples(spark, sf)
    sequences = regions.consensus(samples, f.calls(spark, sf), reference_bases(spark, sf), CONSENSUS_REGION)
    uri = writers.sample_sequences(sequences, _uri(spark, "sequences"), start=101)
    return readers.sample_lines(spark, uri, samples).select(F.col("s").cast("long").alias("s"), F.col("value").alias("line"))


@query("file_saved_model", f"""WITH RECURSIVE {fits.ROWS}, models AS (SELECT 0 AS model, 1.0 AS lam),
design AS (SELECT 0 AS model, quality AS y, 1.0 AS w, length, lines, digits FROM rows), {fits.newton(("length", "lines", "digits"))}
SELECT unnest(['length', 'lines', 'digits']) AS feature, unnest([round(b1, 3), round(b2, 3), round(b3, 3)]) AS coefficient FROM fitted""")
def file_saved_model(spark, sf):
    """A fitted model saved under its data's fingerprint; the second call loads it."""
    from pyspark.ml.classification import LogisticRegressionModel

    from doseloom.models import classifiers
    from standins.models import COLUMNS, LABEL, rows
    data = rows(spark, sf)
    key = storage.fingerprint(spark, [f"{sf}/documents.parquet", f"{sf}/labels.parquet"], C=1.0, columns=COLUMNS)
    root = storage.shared_folder(spark) + "/models"
    for _ in range(2):
        model = storage.saved_model(spark, root, key, lambda: classifiers.fit_logistic(data, COLUMNS, LABEL),
                                    LogisticRegressionModel, {"C": 1.0})
    return classifiers.odds_ratios(model, COLUMNS, data).select("feature", F.round("coefficient", 3).alias("coefficient"))


def _warehouse(spark, sf):
    """The tables as a stored warehouse, and its views: customers as persons, orders as records and conditions."""
    customer, orders = f.table(spark, sf, "customer"), f.table(spark, sf, "orders")
    open_order = F.col("o_orderstatus") == "O"
    frames = {
        "person": customer.select(F.col("c_custkey").alias("person_id"), F.col("c_nationkey").cast("long").alias("gender_concept_id")),
        "concept": f.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("concept_id"), F.col("n_name").alias("concept_name")),
        "cb_search_person": customer.select(F.col("c_custkey").alias("person_id"), (F.col("c_acctbal") >= 0).cast("int").alias("has_ehr_data"),
                                            (F.col("c_nationkey") % 3 > 0).cast("int").alias("has_whole_genome_variant")),
        "cb_search_all_events": orders.select(F.col("o_custkey").alias("person_id"), F.col("o_orderdate").cast("date").alias("entry_date"),
                                              F.ascii("o_orderpriority").cast("long").alias("concept_id"), open_order.cast("int").alias("is_standard")),
        "condition_occurrence": f.conditions(spark, sf)}
    root = _uri(spark, "warehouse")
    for name, schema in schemas.WAREHOUSE.items():
        wanted = spark.createDataFrame([], schema)
        have = frames.get(name, wanted)
        wanted.unionByName(have.select(*[F.col(c.name).cast(c.dataType) for c in wanted.schema if c.name in have.columns]),
                           allowMissingColumns=True).write.parquet(f"{root}/{name}")
    return readers.warehouse(spark, root)


@query("warehouse_in", """SELECT c_custkey AS person_id FROM customer WHERE c_custkey IN (
  SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_nationkey % 3 > 0)""")
def warehouse_in(spark, sf):
    """A cohort as SQL text over the warehouse's views: IN with a subquery."""
    _warehouse(spark, sf)
    return spark.sql("""SELECT person_id FROM person WHERE person_id IN (
        SELECT DISTINCT person_id FROM cb_search_person WHERE has_ehr_data = 1 AND has_whole_genome_variant = 1)""")


@query("warehouse_not_in", """SELECT c_custkey AS person_id, n_name AS group_name FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority || '/' || o_orderstatus IN ('1-URGENT/P', '2-HIGH/P'))""")
def warehouse_not_in(spark, sf):
    """Controls as SQL text: NOT IN, with the name of a concept."""
    _warehouse(spark, sf)
    return spark.sql("""SELECT p.person_id, c.concept_name AS group_name FROM person p JOIN concept c ON c.concept_id = p.gender_concept_id
        WHERE p.person_id NOT IN (SELECT person_id FROM condition_occurrence
                                  WHERE condition_source_value IN ('1-URGENT/P', '2-HIGH/P') AND person_id IS NOT NULL)""")


@query("warehouse_union", """SELECT o_custkey AS person_id FROM orders WHERE o_orderstatus = 'O' AND substr(o_orderpriority, 1, 1) IN ('1', '2')
UNION SELECT c_custkey FROM customer WHERE c_acctbal >= 0""")
def warehouse_union(spark, sf):
    """Cases of two sources as SQL text: UNION DISTINCT."""
    _warehouse(spark, sf)
    return spark.sql("""SELECT person_id FROM cb_search_all_events WHERE is_standard = 1 AND concept_id IN (49, 50)
        UNION DISTINCT SELECT person_id FROM cb_search_person WHERE has_ehr_data = 1""")


@query("file_target_chromosome", f"""WITH {f.WEIGHTS_SQL}
SELECT chr AS chrom, position AS pos, effect_allele, weight FROM weights WHERE chr = '22'""")
def file_target_chromosome(spark, sf):
    """Only the weights of one chromosome, named with or without ``chr`` in the file."""
    rows = f.weights(spark, sf).select(
        F.when(F.col("position") % 2 == 0, F.upper("contig")).otherwise(F.col("chr")).alias("chr"), F.col("position").alias("pos"),
        "effect_allele", "weight", F.lit("v").alias("id"))
    return readers.processed_weights(spark, writers.csv(rows, _uri(spark, "processed")), chrom="22").drop("id")


@query("file_genotypes", f"WITH {_FULL}, {_dense(_DOSAGE)} SELECT {_SCORE_COLUMNS} FROM scores")
def file_genotypes(spark, sf):
    """Calls stored by (contig, block), pruned by the weights' blocks, scored."""
    block = 500
    root = writers.genotypes(f.variants(spark, sf), f.samples(spark, sf), f.calls(spark, sf),
                             _uri(spark, "genotypes"), block)
    stored, weights = readers.genotypes(spark, root), f.weights(spark, sf)
    pruned = scoring.prune_calls(stored, weights)
    return _rounded(scoring.score_samples(stored.samples, stored.variants, pruned, weights)) \
        .withColumn("s", F.col("s").cast("long"))


@query("file_saved_step", f"WITH {f.SPEND_SQL} SELECT s, score FROM spend")
def file_saved_step(spark, sf):
    """A step saved under its fingerprint; the second call only reads."""
    root = storage.shared_folder(spark) + "/steps"
    key = storage.fingerprint(spark, [f"{sf}/orders.parquet"], step="spend")
    storage.saved_step(spark, root, key, lambda: f.spend(spark, sf))
    return storage.saved_step(spark, root, key, lambda: f.spend(spark, sf))


@query("file_sample_variants", f"""WITH lines AS ({LINES_SQL}) SELECT s, line FROM lines
WHERE split_part(line, chr(9), 1) = 'chr6' AND cast(split_part(line, chr(9), 2) AS int) BETWEEN 31 AND 930""")
def file_sample_variants(spark, sf):
    """Region slice exported as one folder per sample, all in one job."""
    from doseloom.operators.regions import slice_region
    uri = writers.sample_variant_files(slice_region(f.calls(spark, sf), REGION), _uri(spark, "samples"))
    lines = spark.read.schema("value string, s long").text(uri)
    return lines.where(~F.col("value").startswith("#")).select("s", F.col("value").alias("line"))


@query("file_sample_vcf", f"""WITH lines AS ({LINES_SQL})
SELECT cast(s AS varchar) AS s, split_part(line, chr(9), 1) AS contig, cast(split_part(line, chr(9), 2) AS int) AS position,
  split_part(split_part(line, chr(9), 10), ':', 1) AS gt FROM lines
WHERE split_part(line, chr(9), 1) = 'chr6' AND cast(split_part(line, chr(9), 2) AS int) BETWEEN 31 AND 930""")
def file_sample_vcf(spark, sf):
    """The folder of one variant file per sample, read back: every call under its own sample."""
    from doseloom.functions import genotype
    from doseloom.operators.regions import slice_region
    uri = writers.sample_variant_files(slice_region(f.calls(spark, sf), REGION), _uri(spark, "samples"))
    back = readers.vcf(spark, f"{uri}/*")
    return back.select("s", "contig", "position", F.coalesce(genotype.gt_text(F.col("gt")), F.lit("./.")).alias("gt"))


@query("vcf_sample_list", f"""WITH lines AS ({LINES_SQL})
SELECT count(DISTINCT s) AS samples, cast(min(cast(s AS varchar)) AS varchar) AS first_sample FROM lines
WHERE split_part(line, chr(9), 1) = 'chr6' AND cast(split_part(line, chr(9), 2) AS int) BETWEEN 31 AND 930""")
def vcf_sample_list(spark, sf):
    """How many samples the files name, and the one that comes first by path."""
    from doseloom.operators.regions import slice_region
    uri = writers.sample_variant_files(slice_region(f.calls(spark, sf), REGION), _uri(spark, "samples"))
    samples = readers.vcf_samples(spark, f"{uri}/*")
    first = samples.where(F.col("s") == samples.agg(F.min("s")).scalar())  # each file names one sample, at place 1
    return samples.agg(F.count_distinct("s").alias("samples")) \
        .withColumn("first_sample", readers.first_sample(first).scalar())


_NATION_SQL = f"""{f.VARIANTS_SQL}, kinds AS (
  SELECT c_nationkey AS nation, l_partkey AS p_partkey, cast(sum(l_quantity) AS bigint) % 4 AS kind
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""


@query("file_vcf", f"""WITH {_NATION_SQL}, seen AS (SELECT DISTINCT p_partkey FROM kinds)
SELECT contig, position, n_name AS s, CASE kind WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' WHEN 2 THEN '1/1' ELSE './.' END AS gt
FROM seen JOIN variants USING (p_partkey) CROSS JOIN nation
LEFT JOIN kinds ON kinds.p_partkey = variants.p_partkey AND nation = n_nationkey""")
def file_vcf(spark, sf):
    """A multi-sample text with nations as samples; absent calls become ``./.``."""
    line = f.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    order = f.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    who = f.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    names = sorted(r.n_name for r in f.table(spark, sf, "nation").select("n_name").collect())
    nation = f.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    kind = F.sum("l_quantity").cast("long") % 4
    cell = F.when(kind == 0, "0/0:9").when(kind == 1, "0|1:9").when(kind == 2, "1/1:9").otherwise("./.")
    wide = (line.join(order, "l_orderkey").join(who, "c_custkey").join(nation, "c_nationkey")
            .groupBy("l_partkey").pivot("n_name", names).agg(cell))
    variants = f.variants(spark, sf).withColumn("l_partkey", F.col("position").cast("long"))
    fixed = [F.col("contig"), F.col("position").cast("string"), F.lit("."), F.get("alleles", F.lit(0)),
             F.array_join(F.slice("alleles", 2, 2), ","), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT:DP")]
    body = wide.join(variants, "l_partkey").select(
        F.concat_ws("\t", *fixed, *[F.coalesce(F.col(n), F.lit("./.")) for n in names]).alias("value"))
    heads = ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])]
    uri = _uri(spark, "vcf")
    body.unionByName(spark.createDataFrame([(h,) for h in heads], "value string")) \
        .write.option("compression", "gzip").text(uri)
    from doseloom.functions.genotype import gt_text
    return readers.vcf(spark, uri).select("contig", "position", "s", gt_text(F.col("gt")).alias("gt"))


@query("file_fasta", f"""WITH b AS (SELECT 'chr' || replace(p_brand, 'Brand#', '') AS contig,
  {f.sql_base('p_size')} AS base, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS place FROM part)
SELECT contig, place // 100 * 100 + 1 AS chunk_start, string_agg(base, '' ORDER BY place) AS bases FROM b GROUP BY 1, 2""")
def file_fasta(spark, sf):
    """Sequences of the parts of each brand, 60 bases a line, read in chunks."""
    from doseloom.operators.ranking import running_totals
    part = f.table(spark, sf, "part").select(
        F.concat(F.lit("chr"), F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("contig"),
        "p_partkey", f.base(F.col("p_size")).alias("base"), F.lit(1).alias("n"))
    placed = running_totals(part, "p_partkey", ["n"], ["contig"])
    lines = (placed.withColumn("row", F.floor(F.col("before_n") / 60))
             .groupBy("contig", "row").agg(F.sort_array(F.collect_list(F.struct("before_n", "base"))).alias("b"))
             .select("contig", "row", F.array_join("b.base", "").alias("value")))
    heads = part.select("contig", F.lit(-1).cast("long").alias("row"),
                        F.concat(F.lit(">"), F.col("contig"), F.lit(" from parts")).alias("value")).distinct()
    uri = _uri(spark, "fasta")
    (lines.unionByName(heads).repartitionByRange("contig", "row").sortWithinPartitions("contig", "row")
     .select("value").write.text(uri))
    return readers.fasta(spark, uri, chunk=100)
