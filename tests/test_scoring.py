import itertools

import pytest
from pyspark.sql import functions as F

from doseloom.functions import genotype as g
from doseloom.operators import scoring
from doseloom.sources.readers import locate_weights, weight_report

REF, ALT1, ALT2, NONE = "A", "C", "G", "T"
CASES = {"absent": None, "hom_ref": [0, 0], "het": [0, 1], "het_alts": [1, 2], "hom_var": [1, 1], "hom_var2": [2, 2]}
# Dosage by genotype: effect is ref, an alternative, neither.
EXPECTED = {"absent": (2, 0, 0), "hom_ref": (2, 0, 0), "het": (1, 1, 0), "het_alts": (1, 1, 0),
            "hom_var": (0, 2, 0), "hom_var2": (0, 2, 0)}


def test_truth_table(spark):
    rows = [(name, gt, effect) for name, gt in CASES.items() for effect in (REF, ALT1, ALT2, NONE, None)]
    df = spark.createDataFrame(rows, "name string, gt array<int>, effect string") \
        .withColumn("alleles", F.array(F.lit(REF), F.lit(ALT1), F.lit(ALT2)))
    place = g.effect_place(F.col("alleles"), F.col("effect"))
    got = df.select("name", "effect", g.effect_dosage(F.col("gt"), place).alias("d"),
                    g.missing_dosage(place).alias("m"),
                    g.effect_dosage(F.col("gt"), place, True).alias("copies")).collect()
    for r in got:
        if r.effect is None:
            assert r.d is None and r.m is None and r.copies is None
            continue
        column = {REF: 0, ALT1: 1, ALT2: 1, NONE: 2}[r.effect]
        assert r.d == EXPECTED[r.name][column], r
        assert r.m == EXPECTED["absent"][column]
        index = {REF: 0, ALT1: 1, ALT2: 2, NONE: 9}[r.effect]
        gt = CASES[r.name]
        assert r.copies == (r.m if gt is None else gt.count(index)), r


def test_call_tests_and_text(spark):
    df = spark.createDataFrame([([0, 0], "0/0"), ([0, 1], "0|1"), ([1, 1], "1"), (None, "./."), ([1, 2], "1/2:33")],
                               "gt array<int>, text string")
    rows = df.select(g.is_hom_ref(F.col("gt")), g.is_het(F.col("gt")), g.is_hom_var(F.col("gt")),
                     g.is_missing(F.col("gt")), g.parse_gt(F.col("text")).eqNullSafe(F.col("gt"))).collect()
    assert [tuple(r) for r in rows] == [
        (True, False, False, False, True), (False, True, False, False, True), (False, False, True, False, True),
        (False, False, False, True, True), (False, True, False, False, True)]


@pytest.fixture(scope="module")
def fixture(spark):
    variants = [("chr1", 1, ["A", "C"]), ("chr1", 2, ["C", "A"]), ("chr1", 3, ["G", "T", "A"]),
                ("chr2", 1, ["A", "C"]), ("chr2", 9, ["A", "G"])]
    weights = [("1", 1, "A", 0.5), ("1", 2, "A", -1.25), ("chr1", 3, "A", 2.0), ("2", 1, "T", 4.0),
               ("3", 7, "A", 9.0), (None, 4, "A", 1.0), ("2", None, "A", 1.0), ("1", 2, "C", 7.0)]
    kinds = [None, [0, 0], [0, 1], [1, 1], [1, 2]]
    samples = [(f"s{i}",) for i in range(6)]  # s5 has no stored call at all
    calls = []
    for i, (c, p, a) in itertools.product(range(5), variants):
        k = (i * 3 + p + len(a)) % 6
        if k < 5 and not (k == 4 and len(a) == 2):
            calls.append((c, p, a, f"s{i}", kinds[k], i % 2 == 0))
    return (spark.createDataFrame(samples, "s string"),
            spark.createDataFrame(variants, "contig string, position int, alleles array<string>"),
            spark.createDataFrame(calls, "contig string, position int, alleles array<string>, s string, "
                                         "gt array<int>, ft boolean"),
            locate_weights(spark.createDataFrame(weights, "chr string, bp int, effect_allele string, weight double")))


def dense(fixture, specific=False):
    """Plain walk over all samples x variants."""
    samples, variants, calls, weights = (df.collect() for df in fixture)
    by_locus = {}
    for w in sorted((w for w in weights if w.contig and w.position), key=lambda w: (w.effect_allele, w.weight)):
        by_locus.setdefault((w.contig, w.position), w)
    stored = {(c.s, c.contig, c.position): c.gt for c in calls}
    out = {}
    for s in samples:
        total = n = 0
        for v in variants:
            w = by_locus.get((v.contig, v.position))
            if w is None:
                continue
            gt, effect = stored.get((s.s, v.contig, v.position)), w.effect_allele
            if gt is None:
                d = 2 if effect == v.alleles[0] else 0
            elif specific:
                d = sum(v.alleles[i] == effect for i in gt)
            elif effect == v.alleles[0]:
                d = 1 if gt[0] != gt[1] else (2 if gt[0] == 0 else 0)
            elif effect in v.alleles[1:]:
                d = 1 if gt[0] != gt[1] else (2 if gt[0] > 0 else 0)
            else:
                d = 0
            total, n = total + d * w.weight, n + 1
        out[s.s] = (total, n)
    return out


@pytest.mark.parametrize("specific", [False, True])
@pytest.mark.parametrize("max_broadcast", [0, 1000])
@pytest.mark.parametrize("parts", [1, 4, 17])
def test_sparse_is_dense(fixture, specific, max_broadcast, parts):
    samples, variants, calls, weights = fixture
    got = scoring.score_samples(samples, variants, calls.repartition(parts), weights, specific, max_broadcast).collect()
    want = dense(fixture, specific)
    assert len(got) == len(want)
    for r in got:
        assert r.total_score == pytest.approx(want[r.s][0], abs=1e-12) and r.variant_count == want[r.s][1]
        assert r.normalized_score == pytest.approx(want[r.s][0] / want[r.s][1], abs=1e-12)


def test_no_weight_matches(fixture):
    samples, variants, calls, weights = fixture
    rows = scoring.score_samples(samples, variants, calls, weights.where("contig = 'chr3'")).collect()
    assert {(r.total_score, r.variant_count, r.normalized_score) for r in rows} == {(0.0, 0, None)}


def test_duplicates_and_null_loci(fixture):
    weights = fixture[3]
    one = {(r.contig, r.position): r for r in scoring.one_weight_per_locus(weights).collect()}
    assert one[("chr1", 2)].effect_allele == "A" and one[("chr1", 2)].locus_weights == 2
    assert len(one) == 5
    report = weight_report(weights).first()
    assert (report.weight_rows, report.without_locus, report.repeated_locus) == (8, 2, 1)


def test_block_pruning_keeps_the_score(spark, fixture, tmp_path):
    from doseloom.sources import readers, writers
    samples, variants, calls, weights = fixture
    root = writers.genotypes(variants, samples, calls, str(tmp_path / "g"), block_size=2)
    data = readers.genotypes(spark, root)
    assert data.block_size == 2 and dict(data.calls.dtypes)["contig"] == "string"
    pruned = scoring.prune_calls(data, weights)
    assert 0 < pruned.count() < data.calls.count()
    got = {r.s: r.total_score for r in scoring.score_samples(data.samples, data.variants, pruned, weights).collect()}
    assert got == pytest.approx({s: t for s, (t, _) in dense(fixture).items()})


def test_only_hot_loci_are_salted(spark):
    rows = spark.range(40_000).select(F.lit("chr1").alias("contig"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("int").alias("position"),
                                      F.col("id").cast("string").alias("s"))
    hot = scoring.hot_loci(rows, "s").collect()
    assert [(r.contig, r.position) for r in hot] == [("chr1", 7)]
    weights = spark.range(0, 40_000, 5).select(F.lit("chr1").alias("contig"), (F.col("id") + 2).cast("int").alias("position"),
                                               F.lit("A").alias("effect_allele"), F.lit(1.0).alias("weight"))
    met = scoring.with_weights(rows, weights, salt_by="s", few=False)
    plain = scoring.with_weights(rows, weights, few=True)
    assert met.collect() and met.count() == plain.count() > 13_000
    plan = met._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert any("SortMergeJoin" in line and "_salt" in line for line in plan.splitlines())
    assert scoring.hot_loci(rows.limit(0), "s").count() == 0


def test_hot_loci_do_not_make_all_rows_again(spark):
    """The sample is taken below the aggregate that makes the rows, and rows without a sample are in none."""
    made = spark.range(5000).select(F.lit("chr1").alias("contig"), (F.col("id") % 9).cast("int").alias("position"),
                                    F.when(F.col("id") % 10 > 0, F.col("id") % 700).alias("s")) \
        .groupBy("contig", "position", "s").agg(F.count(F.lit(1)).alias("n"))
    hot = scoring.hot_loci(made, "s")
    plan = hot._jdf.queryExecution().optimizedPlan().toString().splitlines()
    sampled = [i for i, line in enumerate(plan) if "Filter" in line and "xxhash64" in line]
    assert sampled and sampled[-1] > max(i for i, line in enumerate(plan) if "Aggregate" in line)
    assert hot.count() <= 9


def ran(node):
    """The nodes of a plan that has run, through its query stages."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from ran(node.finalPhysicalPlan())
    elif kind.endswith("QueryStageExec"):
        yield from ran(node.plan())
    else:
        yield node
        for k in range(node.children().size()):
            yield from ran(node.children().apply(k))


def test_folders_without_a_weight_are_not_read(spark, tmp_path):
    """Dynamic pruning: the weights' blocks become a partition filter of the scan of calls."""
    from doseloom.sources import readers, writers
    calls = spark.range(2000).select(F.lit("chr1").alias("contig"), F.col("id").cast("int").alias("position"), F.array(F.lit("A"), F.lit("C")).alias("alleles"),
                                     F.lit("s").alias("s"), F.array(F.lit(0), F.lit(1)).alias("gt"), F.lit(True).alias("ft"))
    root = writers.genotypes(calls.select("contig", "position", "alleles"), calls.select("s").distinct(), calls, str(tmp_path / "g"), block_size=100)
    weights = spark.createDataFrame([("chr1", p, "C", 1.0) for p in (5, 42, 1501)], "contig string, position int, effect_allele string, weight double")
    pruned = scoring.prune_calls(readers.genotypes(spark, root), weights)
    assert sorted(r.position for r in pruned.collect()) == [*range(100), *range(1500, 1600)]
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    scans = [n for n in ran(pruned._jdf.queryExecution().executedPlan()) if n.nodeName().startswith("Scan parquet")]
    assert [n.metrics().apply("numPartitions").value() for n in scans] == [2]
    many = scoring.prune_calls(readers.genotypes(spark, root), weights, max_broadcast=0)
    assert sorted(map(str, many.collect())) == sorted(map(str, pruned.collect()))


def test_many_blocks_share_folders(spark, tmp_path, monkeypatch):
    """Beyond the greatest number of folders neighbouring blocks share one; the calls that stay are those of the weights' blocks alone."""
    import glob

    from doseloom.sources import readers, writers
    calls = spark.range(2000).select(F.lit("chr1").alias("contig"), F.col("id").cast("int").alias("position"), F.array(F.lit("A"), F.lit("C")).alias("alleles"),
                                     F.lit("s").alias("s"), F.array(F.lit(0), F.lit(1)).alias("gt"), F.lit(True).alias("ft"))
    calls = calls.unionByName(calls.limit(3).withColumn("position", F.lit(None).cast("int")))
    weights = spark.createDataFrame([("chr1", p, "C", 1.0) for p in (5, 42, 1501, 1999)] + [(None, 5, "C", 1.0)],
                                    "contig string, position int, effect_allele string, weight double")
    kept = {}
    for most in (4096, 8):
        monkeypatch.setattr(writers, "FOLDERS", most)
        root = writers.genotypes(calls.select("contig", "position", "alleles"), calls.select("s").distinct(), calls, str(tmp_path / f"g{most}"), block_size=10)
        data = readers.genotypes(spark, root)
        assert data.block_size == 10 and data.calls.count() == 2003
        assert len(glob.glob(f"{root}/calls/*/*")) == (201 if most > 8 else 9)  # one of them for the null positions
        for n in (0, 1000):
            pruned = scoring.prune_calls(data, weights, max_broadcast=n)
            kept[most, n] = sorted(r.position for r in pruned.collect())
        scans = [n for n in ran(pruned._jdf.queryExecution().executedPlan()) if n.nodeName().startswith("Scan parquet")]
        assert [n.metrics().apply("numPartitions").value() for n in scans] == [4 if most > 8 else 3]
    assert all(rows == [*range(10), *range(40, 50), *range(1500, 1510), *range(1990, 2000)] for rows in kept.values())
    spark.createDataFrame([(10,)], "block_size int").write.mode("overwrite").parquet(f"{tmp_path}/g4096/layout")  # as written before
    before = readers.genotypes(spark, f"{tmp_path}/g4096")
    assert before.folder_blocks == 1 and scoring.prune_calls(before, weights).count() == 40


def test_calls_of_samples_do_not_depend_on_a_count(spark, fixture):
    _, _, calls, _ = fixture
    some = calls.select("s").distinct().limit(2)
    few, many = (sorted(map(str, scoring.calls_of(calls, some, n).collect())) for n in (1000, 0))
    assert few == many and 0 < len(few) < calls.count()


def test_missing_column(spark):
    with pytest.raises(ValueError, match="weight"):
        scoring.one_weight_per_locus(spark.createDataFrame([("chr1", 1)], "contig string, position int"))


def test_calls_are_shuffled_without_their_arrays(spark):
    """With many weights the wide arrays stay out of the shuffle by locus, and odd alleles and calls score as with few weights."""
    odd = [["A", "C"], ["A", "C", "A"], ["A,C", "T"], ["A", None, "C"], [], None, [""], ["", "C"], [None], ["A", "C", "G"]]
    gts = [[0, 0], [0, 1], [1, 0], [1, 1], [1, 2], [2, 2], None, [0], [None, 1], [-1, 0], [0, 1, 2], []]
    calls = spark.createDataFrame([("chr1", i % 10, odd[i % 10], f"s{i % 7}", gts[i % 12]) for i in range(840)],
                                  "contig string, position int, alleles array<string>, s string, gt array<int>")
    weights = spark.createDataFrame([("chr1", p, ["A", "C", "A,C", "", "T"][p % 5], 2.0 ** p) for p in range(10)],
                                    "contig string, position int, effect_allele string, weight double")
    for effect in ("A", "C", "A,C", "", "G", None):
        same = weights.withColumn("effect_allele", F.lit(effect).cast("string"))
        for specific in (False, True):
            few, many = (sorted(map(str, scoring.score_samples(calls.select("s").distinct(), calls.select("contig", "position", "alleles"), calls, same,
                                                               specific, n).collect())) for n in (100, 0))
            assert few == many and len(few) == 7
    met = scoring.score_samples(calls.select("s").distinct(), calls, calls, weights, max_broadcast=0)
    met.collect()
    salted = [str(n.output()) for n in ran(met._jdf.queryExecution().executedPlan()) if "Exchange" in n.nodeName() and "_salt" in n.toString().splitlines()[0]]
    assert any("_pair" in columns for columns in salted) and not any("alleles" in columns or "gt#" in columns for columns in salted)


def test_the_sample_for_hot_loci_may_come_from_elsewhere(spark, fixture):
    samples, variants, calls, weights = fixture
    asked = []
    got = scoring.score_samples(samples, variants, calls, weights, max_broadcast=0, sampled=lambda: asked.append(1) or calls)
    assert {r.s: r.total_score for r in got.collect()} == pytest.approx({s: t for s, (t, _) in dense(fixture).items()}) and asked == [1]
    scoring.score_samples(samples, variants, calls, weights, sampled=lambda: asked.append(1) or calls)
    assert asked == [1]  # few weights need no sample
