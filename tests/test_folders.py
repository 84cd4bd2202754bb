import glob
import os

import pytest
from pyspark.sql import functions as F

from doseloom.plans import storage
from doseloom.sources import folders, readers, writers

ODD = ["a", "a b", "x/y=1%", "é", "", None, "10:'q'", "{b}[c]^", "back\\slash", 'say "so"', "tab\there", "*?#"]


def written(uri: str) -> dict[str, list[str]]:
    """Folder names with their files."""
    found = {}
    for at, _, files in os.walk(uri):
        if files and at != uri:
            found[os.path.relpath(at, uri)] = [f for f in sorted(files) if f.startswith("part-") and not f.endswith(".crc")]
    return found


def test_folders_are_those_of_sparks_writer(spark, tmp_path):
    """The same folders and lines as by Spark's writer, without a checksum file (and its chmod) for each file."""
    rows = [(s, f"{k} of {s}" if k else None) for s in ODD for k in range(3)]
    lines = spark.createDataFrame(rows, "s string, line string").repartitionByRange(4, "s").sortWithinPartitions("s", "line")
    mine, sparks = str(tmp_path / "mine"), str(tmp_path / "sparks")
    lines.write.partitionBy("s").text(sparks)
    for _ in range(2):  # the second time over the first
        folders.write_lines(lines, mine)
    assert written(mine).keys() == written(sparks).keys()
    for name in written(sparks):
        one, two = ("".join(open(f"{uri}/{name}/{f}").read() for f in written(uri)[name]) for uri in (mine, sparks))
        assert one == two if "HIVE" not in name else sorted(one) == sorted(two)
    assert storage.exists(spark, f"{mine}/_SUCCESS") and not glob.glob(f"{glob.escape(mine)}/*/.*")
    back = [sorted(map(str, spark.read.schema("value string, s string").text(uri).collect())) for uri in (mine, sparks)]
    assert back[0] == back[1]


@pytest.mark.parametrize("local", [True, False])
def test_lines_of_samples(spark, tmp_path, monkeypatch, local):
    """The folders of the samples asked for, each read once; a sample without a folder has no lines."""
    if not local:
        monkeypatch.setattr(storage, "local_path", lambda spark, uri: None)
    lines = spark.createDataFrame([(s, f"{k}\r\nof {s}") for s in ODD for k in range(3)], "s string, line string")
    uri = folders.write_lines(lines.repartitionByRange(4, "s").sortWithinPartitions("s"), str(tmp_path / "f"))
    asked = ["a", "a", "é", "", None, "x/y=1%", "nobody"]
    got = sorted(map(str, readers.sample_lines(spark, uri, spark.createDataFrame([(s,) for s in asked], "s string")).collect()))
    kept = spark.read.schema("value string, s string").text(uri).select("s", "value")
    want = [str(r) for r in kept.collect() if r.s in {"a", "é", None, "x/y=1%"}]
    assert got == sorted(want)
    assert len(got) == 30


def test_many_samples_of_sequences(spark, tmp_path):
    """As many folders as samples; a sample whose pieces are dealt to several tasks has a file of each, in order."""
    sequences = spark.range(3000).select((F.col("id") % 1000).alias("s"), F.lit("chr6").alias("contig"),
                                         (F.floor(F.col("id") / 1000) * 1000 + 1).alias("chunk_start"), F.lit("ACGT").alias("sequence"))
    uri = writers.sample_sequences(sequences.unionByName(sequences.where("s = 7")), str(tmp_path / "f"), 1)
    assert len(written(uri)) == 1000 and not glob.glob(f"{uri}/*/.*")
    back = readers.sample_lines(spark, uri, sequences.select("s"))
    assert back.count() == 4 * 999 + 8 and back.where("value = '>chr6'").count() == 1001
    first = spark.createDataFrame([("x", "chr6", k, "A" * k) for k in range(1, 400)], "s string, contig string, chunk_start long, sequence string")
    uri = writers.sample_sequences(first, str(tmp_path / "g"), 1)
    lines = [line for f in sorted(glob.glob(f"{uri}/s=x/part-*")) for line in open(f).read().splitlines()]
    assert lines == [">chr6", *("A" * k for k in range(1, 400))] and len(glob.glob(f"{uri}/s=x/part-*")) > 1
    none = writers.sample_sequences(first.where("false"), str(tmp_path / "h"), 1)
    assert spark.read.schema("value string, s string").text(none).count() == 0
