import gzip

import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from doseloom.functions.text import bare_chrom, parse_region, with_chr
from doseloom.models import classifiers
from doseloom.plans import storage
from doseloom.sources import readers, writers

SCORING = """###PGS CATALOG SCORING FILE
#genome_build=GRCh38
rsID	hm_chr	hm_pos	effect_allele	other_allele	effect_weight
rs1	6	100	A	G	0.5
rs2	chr6	200	C	T	-1.5
rs3	X	300	G	A	2
rs4			T	C	3
"""


@pytest.mark.parametrize("zipped", [False, True])
def test_scoring_file(spark, tmp_path, zipped):
    path = str(tmp_path / ("s.txt.gz" if zipped else "s.txt"))
    with (gzip.open(path, "wt") if zipped else open(path, "w")) as f:
        f.write(SCORING)
    scoring = readers.scoring_file(spark, path)
    weights = readers.locate_weights(readers.prepare_weights(scoring))
    rows = [(r.contig, r.position, r.weight) for r in weights.orderBy("weight").collect()]
    assert rows == [("chr6", 200, -1.5), ("chr6", 100, 0.5), ("chrX", 300, 2.0), (None, None, 3.0)]
    assert "noneffect_allele" in readers.prepare_weights(scoring, keep_other_allele=True).columns
    assert readers.weight_report(weights).first().without_locus == 1
    again = readers.located_weight_csv(spark, writers.weights(weights, str(tmp_path / "w")))
    assert sorted(map(str, again.collect())) == sorted(map(str, weights.collect()))
    assert [r.value for r in readers.preview(spark, path, 2).collect()] == SCORING.splitlines()[:2]


def test_missing_columns(spark, tmp_path):
    (tmp_path / "s.txt").write_text("hm_chr\thm_pos\n1\t2\n")
    with pytest.raises(ValueError, match="effect_allele"):
        readers.scoring_file(spark, str(tmp_path / "s.txt"))
    with pytest.raises(ValueError, match="bp"):
        readers.locate_weights(spark.createDataFrame([("1",)], "chr string"))


def test_intervals_skip_bad_rows(spark, tmp_path):
    (tmp_path / "i.tsv").write_text("chr1\t5\t5\nchr1\t9\t3\nchr1\tx\t4\nodd\t1\t2\nchrM\t1\t4\nchr22\t7\t8\n")
    kept = readers.intervals(spark, str(tmp_path / "i.tsv"), readers.genome_contigs(spark))
    assert sorted((r.contig, r.start, r.end) for r in kept.collect()) == [("chr1", 5, 5), ("chr22", 7, 8), ("chrM", 1, 4)]
    assert readers.genome_contigs(spark).count() == 25


def test_contig_text(spark):
    df = spark.createDataFrame([("6",), ("chr6",), (" CHR6 ",), ("X",)], "c string")
    rows = df.select(with_chr(F.col("c")), bare_chrom(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [("chr6", "6"), ("chr6", "6"), ("chr CHR6 ", "6"), ("chrX", "X")]
    assert parse_region("chr6:31,283,525-31306849") == ("chr6", 31283525, 31306849)


def test_saved_step_knows_its_inputs(spark, tmp_path):
    source, root, calls = str(tmp_path / "in"), str(tmp_path / "steps"), []

    def build():
        calls.append(1)
        return spark.read.parquet(source)

    spark.range(5).write.parquet(source)
    one = storage.fingerprint(spark, [source], score="A")
    assert storage.saved_step(spark, root, one, build).count() == 5
    assert storage.saved_step(spark, root, one, build).count() == 5 and len(calls) == 1
    assert storage.fingerprint(spark, [source], score="B") != one
    spark.range(7).write.mode("overwrite").parquet(source)
    two = storage.fingerprint(spark, [source], score="A")
    assert two != one and storage.saved_step(spark, root, two, build).count() == 7


def test_saved_model(spark, tmp_path):
    df = spark.createDataFrame([(float(i % 7), int(i % 7 > 3)) for i in range(40)], "x double, y int")
    fits = []

    def fit():
        fits.append(1)
        return classifiers.fit_logistic(df, ["x"], "y")

    first = storage.saved_model(spark, str(tmp_path), "k", fit, LogisticRegressionModel, {"C": 1.0})
    again = storage.saved_model(spark, str(tmp_path), "k", fit, LogisticRegressionModel)
    assert len(fits) == 1 and list(first.coefficients) == list(again.coefficients)


def test_checkpoint_is_reliable(spark):
    df = storage.cut_lineage(spark.range(10).withColumn("x", F.rand()))
    assert df.collect() == df.collect()
    assert storage.exists(spark, storage.shared_folder(spark))


def test_each_vcf_file_has_its_own_names(spark, tmp_path):
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    for name, cells in (("A", "0/1"), ("B", "1/1")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.vcf").write_text(f"{head}{name}\nchr1\t5\t.\tA\tC\t.\t.\t.\tGT\t{cells}\n")
    got = {r.s: r.gt for r in readers.vcf(spark, str(tmp_path / "*")).collect()}
    assert got == {"A": [0, 1], "B": [1, 1]}
    samples = readers.vcf_samples(spark, str(tmp_path / "*"))
    assert [(r.place, r.s) for r in samples.orderBy("place").collect()] == [(0, "A"), (1, "B")]
    assert readers.first_sample(samples).first().s == "A"


def test_a_changed_nested_file_changes_the_fingerprint(spark, tmp_path):
    import os
    part = tmp_path / "t" / "day=1"
    part.mkdir(parents=True)
    (part / "x.csv").write_text("abc")
    os.utime(part / "x.csv", (1, 1))
    before = storage.fingerprint(spark, [str(tmp_path / "t")])
    assert before == storage.fingerprint(spark, [str(tmp_path / "t")])
    (part / "x.csv").write_text("abd")
    assert before != storage.fingerprint(spark, [str(tmp_path / "t")])


def test_one_writer_wins(spark, tmp_path):
    """Two writers of one step at once: one whole step, nothing left aside."""
    import threading
    root, ready, rows = str(tmp_path / "steps"), threading.Barrier(2), {}

    def build(k):
        ready.wait(60)  # both have seen that the step is not there
        return spark.range(5 * k).withColumn("writer", F.lit(k))

    def write(k):
        rows[k] = sorted(map(tuple, storage.saved_step(spark, root, "step", lambda: build(k)).collect()))

    writers_ = [threading.Thread(target=write, args=(k,)) for k in (1, 2)]
    [t.start() for t in writers_]
    [t.join(120) for t in writers_]
    assert rows[1] == rows[2] and len({w for _, w in rows[1]}) == 1 and len(rows[1]) == 5 * rows[1][0][1]
    assert storage.folder_names(spark, root) == ["step"]


def test_unfinished_and_unused_steps_go(spark, tmp_path):
    root = str(tmp_path / "steps")
    for key in ("used", "unused"):
        storage.saved_step(spark, root, key, lambda: spark.range(3))
    spark.range(2).write.parquet(f"{root}/.aside-lost-writer")
    assert storage.drop_steps(spark, root, ["used"], older_than_hours=1) == []
    assert storage.drop_steps(spark, root, ["used"], older_than_hours=0) == [".aside-lost-writer", "unused"]
    assert storage.folder_names(spark, root) == ["used"] and storage.drop_steps(spark, str(tmp_path / "none")) == []


def test_scratch_tables_go_with_the_block(spark):
    with storage.scratch(spark):
        uri = storage.new_folder(spark, "step")
        spark.range(3).write.parquet(uri)
        assert spark.read.parquet(uri).count() == 3
    assert not storage.exists(spark, uri)
