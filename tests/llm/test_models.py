"""The two classifiers: held-out accuracy on planted texts, odd rows, no labels."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from doseloom.llm import quality, toxicity

SCHEMA = "doc_id long, text string, score string"
LABELS = "doc_id long, quality int, toxic int"


def fixture():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["the", "on", "é", "ing", "st", "re"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for d in range(1200):
        words = [word() for _ in range(rng.randint(3, 80))]
        good, toxic = rng.random() < 0.7, rng.random() < 0.2
        if not good:
            words = [w + rng.choice(["%%%", "***"]) for w in words] if d % 2 else [w.upper() + "!!" for w in words]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["moron", "scum", "Lowbrowed", "lowbrowish"]))
        rows.append((d, " ".join(words), "s"))
        labels.append((d, int(good), int(toxic)))
    labels += [(None, 1, 1), (5000, 1, None), (3, labels[3][1], labels[3][2])]
    rows += [(6000, None, None), (6001, "", None), (6002, "word " * 30000, None), (6003, "same", None), (6003, "same", None),
             (None, "nobody", None)]
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = fixture()
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    truth = {d: (q, t) for d, q, t in labels[:1200]}
    for which, module in enumerate((quality, toxicity)):
        got = module.classified(docs, known).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
        own = [r for r in got if r.held_out and r.doc_id in truth]
        right = sum(r.predicted == truth[r.doc_id][which] for r in own)
        assert len(own) > 150 and right >= 0.95 * len(own)
        assert len({r.score for r in got if r.doc_id in (6000, 6001)}) == 1


def test_toxic_documents_go_and_columns_stay(spark):
    rows, labels = fixture()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = toxicity.accepted(docs, spark.createDataFrame(labels, LABELS))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    toxic = {d for d, _, t in labels[:1200] if t}
    assert len(ids & toxic) < 0.1 * len(toxic) and len(ids - toxic) > 0.98 * (len({r[0] for r in rows}) - len(toxic))


def test_without_labels_or_rows(spark):
    docs, none = spark.createDataFrame(fixture()[0][:5], SCHEMA), spark.createDataFrame([], LABELS)
    for module in (quality, toxicity):
        assert {r.score for r in module.classified(docs, none).collect()} == {0.5}
        assert module.classified(spark.createDataFrame([], SCHEMA), none).count() == 0


def test_factors_count_pairs():
    import numpy as np
    rng = np.random.default_rng(0)
    model = toxicity.Machine(np.arange(4), np.zeros(4), rng.normal(size=(4, 3)), 0.25)
    rows = np.array([0, 2, 3])
    pairs = sum(model.factor[i] @ model.factor[j] for k, i in enumerate(rows) for j in rows[k + 1:])
    assert abs(model.value(rows) - 0.25 - pairs) < 1e-9


def test_words_that_are_toxic_only_together(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["the", "on", "é", "ing", "st", "re"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for d in range(1600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [word() for _ in range(rng.randint(3, 20))] + ["people"] * a + ["vermin"] * b
        rng.shuffle(words)
        rows.append((d, " ".join(words), None))
        labels.append((d, 1, int(a == b)))  # each word is in as many toxic as other documents
    got = toxicity.classified(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)).where("held_out").collect()
    assert sum(r.predicted == labels[r.doc_id][2] for r in got) >= 0.9 * len(got) > 250


def test_a_shard_is_learned_from_without_python_numbers():
    rng = np.random.default_rng(6)
    lists = [np.sort(rng.choice(9999, 1000, replace=False)).astype(np.int32) for _ in range(400)] + [np.zeros(0, np.int32)]
    shares = [np.full(len(x), 0.001, np.float32) for x in lists]
    table = pa.table({"doc_id": pa.array(range(401)), "label": pa.array([k % 2 for k in range(401)], pa.int32()),
                      "slots": pa.array(lists, pa.list_(pa.int32())), "shares": pa.array(shares, pa.list_(pa.float32()))})
    plain, own = quality.Ftrl(10_000), quality.Ftrl(10_000)
    for k in np.argsort(quality.mix(np.arange(401).astype(quality.U) + quality.U(3))).tolist():
        plain.learn(np.array(lists[k].tolist() + [9999]), np.array(shares[k].tolist() + [1.0]), k % 2)
    tracemalloc.start()
    quality.learn_shard(own, table, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(own.z, plain.z) and np.array_equal(own.n, plain.n)
    assert peak < 5e6, peak
