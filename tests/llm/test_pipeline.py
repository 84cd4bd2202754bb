"""The stages against plain versions of what they must keep, and the whole run."""

import duckdb
import pytest

import corpus_pipeline
from doseloom.llm import toxicity
from tests.llm.test_decontaminate import expected as contaminated
from tests.llm.test_neardup import brute

pytest.importorskip("public_tokenizers")


def test_stages_keep_what_plain_versions_keep(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    rows = {r.doc_id: r.text for r in docs.collect()}
    tables = {}
    for name, stage in corpus_pipeline.STAGES:
        uri = str(tmp_path / name.replace(" ", "-"))
        stage(spark, docs, sf).write.parquet(uri)
        docs = tables[name] = spark.read.parquet(uri)
        if name != "packing":
            assert docs.columns == columns
    kept = {name: {r.doc_id for r in t.select("doc_id").collect()} for name, t in tables.items()}
    known = spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r.doc_id: r.score for r in toxicity.classified(spark.read.parquet(f"{sf}/documents.parquet"), known).collect()}
    want = {d for d in rows if scores[d] < 0.5}
    assert kept["toxicity"] == want
    best = {}
    for d in sorted(want):
        best[rows[d] or ""] = d
    want = set(best.values())
    assert kept["exact dedup"] == want
    want = {d for d, _, _, keep in brute([(d, rows[d]) for d in want], 5, 80) if keep}
    assert kept["near dedup"] == want
    want = {d for d, _, _, _, _, hit in contaminated([(d, rows[d]) for d in want], [(str(i), t) for i, t in items]) if not hit}
    assert kept["benchmark decontamination"] == want
    assert kept["packing"] == want


def test_run_gives_every_id_once(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    line = sorted((r.sequence_id, r.offset, r.length) for r in got.collect())
    at = 0
    for sequence, offset, length in line:
        assert sequence * 2048 + offset == at
        at += length
    assert at > 0


def _sf(spark, root, docs):
    """A folder of tables: these documents, few labels and one benchmark item."""
    docs.write.parquet(f"{root}/documents.parquet")
    labels = [(d, 1, int(d % 3 == 0)) for d in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    item = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return item


def test_odd_rows_through_the_stages(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _gone long, _tag string, score string"
    item = "one two three four five six seven eight nine ten eleven"
    texts = {d: f"plain words number {d} " + ("moron" if d % 3 == 0 else "fine") for d in range(60)}
    rows = [(d, t, "en", "s", 1, d, "t", "x") for d, t in texts.items()]
    rows += [(100, None, None, None, None, None, None, None), (101, "", None, None, None, 1, "t", "x"), (None, "an id is missing here", None, None, None, 2, "t", "x"),
             (102, "long " * 100_000, None, None, None, 3, "t", "x"), (103, f"leak {item} end", None, None, None, 4, "t", "x"),
             (104, "again the same words", None, None, None, 5, "t", "x"), (104, "again the same words", None, None, None, 5, "t", "x")]
    root = str(tmp_path / "odd")
    docs = spark.createDataFrame(rows, schema)
    _sf(spark, root, docs)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        uri = str(tmp_path / f"stage{k}")
        stage(spark, docs, root).write.parquet(uri)
        out = spark.read.parquet(uri)
        if name != "packing":
            assert out.columns == docs.columns
            by_id = {(r.doc_id, r.text): tuple(r) for r in docs.collect()}
            assert all(tuple(r) == by_id[r.doc_id, r.text] for r in out.collect())
        docs = out
    ids = [r.doc_id for r in docs.collect()]
    assert 103 not in ids and {101, 102, 104, None} <= set(ids) and 100 not in ids  # 100 and 101 are equal texts


def test_empty_table_through_the_stages(spark, tmp_path):
    root = str(tmp_path / "none")
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    _sf(spark, root, docs)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, root)
        assert out.count() == 0, name
        docs = docs if name == "packing" else out
