import glob
import gzip
import random

import pytest
from pyspark.sql import functions as F

from doseloom.operators import regions
from doseloom.sources import readers, writers

CALLS = "contig string, position int, alleles array<string>, s string, gt array<int>, ft boolean"


def walk(bases, calls, start, end):
    """Base-by-base consensus: first variant wins, whole span inside the region."""
    out, at = [], start
    for p, alleles, gt in sorted(calls, key=lambda c: (c[0], c[0] + len(c[1][0]), c[1][next(i for i in c[2] if i > 0)])):
        ref, alt = alleles[0], alleles[next(i for i in gt if i > 0)]
        if p < max(at, start) or p + len(ref) - 1 > end:
            continue
        out.append(bases[at - 1:p - 1] + alt)
        at = p + len(ref)
    return "".join(out) + bases[at - 1:end]


@pytest.mark.parametrize("block", [11, 1_000_000])
@pytest.mark.parametrize("chunk", [7, 1000])
@pytest.mark.parametrize("region", [(1, 200), (23, 150), (60, 61)])
def test_consensus_is_a_walk(spark, block, chunk, region, monkeypatch):
    monkeypatch.setattr(regions, "ISLAND_BLOCK", block)  # many blocks, or one
    rng = random.Random(chunk * 1000 + region[0])
    bases = "".join(rng.choice("ACGT") for _ in range(200))
    rows = []
    for s in ("s1", "s2", "s3"):
        for p in sorted(rng.sample(range(1, 196), 45)):
            ref = bases[p - 1:p - 1 + rng.choice([1, 1, 1, 2, 4, 9])]
            alleles = [ref, rng.choice(["A", "C", ref[0], ref[0] + "TT"]), "GG"]
            rows.append(("chr6", p, alleles, s, rng.choice([[0, 1], [1, 1], [0, 2], [1, 2], [0, 0], None]), None))
    rows.append(("chr7", 30, ["A", "C"], "s1", [1, 1], None))
    chunks = [("chr6", i + 1, bases[i:i + chunk]) for i in range(0, 200, chunk)]
    start, end = region
    calls = spark.createDataFrame(rows, CALLS)
    samples = spark.createDataFrame([("s1",), ("s2",), ("s4",)], "s string")
    got = {}
    for r in regions.consensus(samples, calls, spark.createDataFrame(chunks, "contig string, chunk_start long, bases string"),
                               f"chr6:{start}-{end}", chunk).orderBy("s", "chunk_start").collect():
        got[r.s] = got.get(r.s, "") + r.sequence
    for s in ("s1", "s2", "s4"):
        mine = [(p, a, g) for c, p, a, t, g, _ in rows if c == "chr6" and t == s and g and any(i > 0 for i in g)
                and start <= p <= end]
        assert got[s] == walk(bases, mine, start, end), s
    assert set(got) == {"s1", "s2", "s4"}


@pytest.mark.parametrize("block", [50, 1_000_000])
def test_one_long_island_is_a_chain_of_jumps(spark, monkeypatch, block):
    """An island of thousands of edits: the walk's choice, and no task holds the island."""
    monkeypatch.setattr(regions, "ISLAND_BLOCK", block)
    rng, rows = random.Random(9), []
    for p in range(1, 4000, 2):
        rows.append(("chr6", p, ["A" * rng.randint(3, 9), "C"], "s1", [1, 1], None))
    rows += [("chr6", p, ["AA", "C"], "s2", [1, 1], None) for p in range(1, 60)]  # every second one
    rows += [("chr6", 7, ["AAA", "G"], "s3", [1, 1], None)] * 2 + [("chr7", 8, ["A", "G"], "s3", [0, 1], None)]
    df = regions.applied_edits(spark.createDataFrame(rows, CALLS).repartition(6))
    got, want = sorted((r.s, r.contig, r.start) for r in df.collect()), []
    for s in ("s1", "s2", "s3"):
        last = {}
        for c, p, alleles, t, *_ in sorted((r for r in rows if r[3] == s), key=lambda r: (r[0], r[1], len(r[2][0]))):
            if p >= last.get(c, 0):
                want.append((s, c, p))
                last[c] = p + len(alleles[0])
    assert got == sorted(want)


def test_applied_edits_run_no_python(spark):
    rows = [("chr6", p, ["AAA", "C"], "s", [1, 1], None) for p in range(1, 30)]
    plan = regions.applied_edits(spark.createDataFrame(rows, CALLS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_slice_and_count(spark):
    rows = [("chr6", p, ["A", "C"], s, [0, 1], None) for p in (99, 100, 150, 200) for s in ("a", "b")]
    calls = spark.createDataFrame(rows, CALLS)
    ids = spark.createDataFrame([("a",)], "s string")
    inside = regions.slice_region(calls, "chr6:100-200", samples=ids)
    assert sorted((r.position, r.s) for r in inside.collect()) == [(100, "a"), (150, "a")]
    closed = regions.slice_region(calls, "chr6:100-200", end_inclusive=True)
    assert regions.count_variants(closed).first().n_variants == 3


def test_region_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("chr6", 5, ["A"], "a", [0, 0], True)], CALLS).write.parquet(str(tmp_path / "c"))
    plan = regions.slice_region(spark.read.parquet(str(tmp_path / "c")), "chr6:1-9") \
        ._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "EqualTo(contig,chr6)" in pushed and "GreaterThanOrEqual(position,1)" in pushed


def test_sample_files(spark, tmp_path):
    rows = [("chr6", p, ["A", "C", "G"], s, gt, ft) for s in ("a", "b")
            for p, gt, ft in ((30, [1, 2], True), (10, [0, 0], False), (20, None, None))]
    uri = writers.sample_variant_files(spark.createDataFrame(rows, CALLS).repartition(5), str(tmp_path / "v"))
    for s in ("a", "b"):
        lines = [line for f in sorted(glob.glob(f"{uri}/s={s}/part-*")) for line in open(f).read().splitlines()]
        assert lines[0] == "##fileformat=VCFv4.2" and lines[1].split("\t")[-1] == s
        cells = [line.split("\t") for line in lines[2:]]
        assert [(c[1], c[4], c[9]) for c in cells] == [("10", "C,G", "0/0:FAIL"), ("20", "C,G", "./.:."), ("30", "C,G", "1/2:PASS")]


VCF = """##fileformat=VCFv4.2
#CHROM	POS	ID	REF	ALT	QUAL	FILTER	INFO	FORMAT	s1	s2	s3
chr6	10	.	A	C	.	.	.	GT:FT	0/0:PASS	0|1:FAIL	./.:.
chr6	20	.	AT	A,G	.	.	.	FT:GT	PASS:1/2	.:2	.
chr7	10	.	A	.	.	.	.	GT	0/0	0/0	0/0
"""


@pytest.mark.parametrize("zipped", [False, True])
def test_vcf(spark, tmp_path, zipped):
    path = str(tmp_path / ("a.vcf.gz" if zipped else "a.vcf"))
    with (gzip.open(path, "wt") if zipped else open(path, "w")) as f:
        f.write(VCF)
    got = {(r.contig, r.position, r.s): (r.alleles, r.gt, r.ft) for r in readers.vcf(spark, path).collect()}
    assert len(got) == 9
    assert got[("chr6", 10, "s2")] == (["A", "C"], [0, 1], False) and got[("chr6", 10, "s3")] == (["A", "C"], None, None)
    assert got[("chr6", 20, "s1")] == (["AT", "A", "G"], [1, 2], True)
    assert got[("chr6", 20, "s2")] == (["AT", "A", "G"], [2, 2], None) and got[("chr6", 20, "s3")][1] is None
    assert got[("chr7", 10, "s1")] == (["A"], [0, 0], None)
    assert readers.vcf(spark, path, "chr6:10-20").count() == 6
    names = readers.vcf_samples(spark, path)
    assert [r.s for r in names.orderBy("place").collect()] == ["s1", "s2", "s3"]
    assert readers.first_sample(names).first().s == "s1"


def test_fasta_in_small_splits(spark, tmp_path):
    rng = random.Random(4)
    contigs = {name: "".join(rng.choice("ACGTN") for _ in range(n)) for name, n in (("chr1", 1703), ("chr2", 61), ("chrX", 600))}
    text = "".join(f">{n} of a test\n" + "".join(b[i:i + 60] + "\n" for i in range(0, len(b), 60)) for n, b in contigs.items())
    (tmp_path / "r.fasta").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = readers.fasta(spark, str(tmp_path / "r.fasta"), chunk=100)
        rows = df.collect()
        assert df.select(F.spark_partition_id()).distinct().count() >= 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, bases in contigs.items():
        parts = sorted((r.chunk_start, r.bases) for r in rows if r.contig == name)
        assert [p for p, _ in parts] == list(range(1, len(bases) + 1, 100))
        assert "".join(b for _, b in parts) == bases


def test_sequence_files(spark, tmp_path):
    rows = [(s, "chr6", c, f"{s}{c}") for s in ("x", "y") for c in (2001, 1, 1001)]
    uri = writers.sample_sequences(spark.createDataFrame(rows, "s string, contig string, chunk_start long, sequence string"),
                                   str(tmp_path / "f"), 1)
    lines = [line for f in sorted(glob.glob(f"{uri}/s=x/part-*")) for line in open(f).read().splitlines()]
    assert lines == [">chr6", "x1", "x1001", "x2001"]


def test_vcf_lines_are_not_gathered_by_file(spark, tmp_path):
    """Headers with few names are broadcast whatever their size is taken to be; many names give the same calls."""
    from doseloom.sources import readers
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx\ty\n"
    (tmp_path / "a.vcf").write_text(head + "chr1\t5\t.\tA\tC\t.\t.\t.\tGT\t0/1\t./.\n")
    (tmp_path / "b.vcf").write_text("chr1\t9\t.\tA\tC\t.\t.\t.\tGT\t1/1\t0/0\n")  # a split file without a header
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        calls = readers.vcf(spark, str(tmp_path))
        rows = sorted((r.position, r.s, r.gt) for r in calls.collect())
        plan = calls._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == [(5, "x", [0, 1]), (5, "y", None), (9, "x", [1, 1]), (9, "y", [0, 0])]
    assert plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in plan
