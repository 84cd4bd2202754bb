"""Slot negatives against a plain search over all pairs."""

import math
import random

import numpy as np
import pytest

from doseloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, v string, row string, digest string"


def usable(rows):
    out = []
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, [math.floor(256 * float(np.float32(x))) for x in v], int(math.fmod(label + 1, 10)) if i % 7 == 0 else label))
    return out


def brute(rows, keep=5, positives=5, low=80, high=100):
    rows, out = usable(rows), []
    cap = lambda x: max(-1 << 63, min((1 << 63) - 1, x))
    for k, (i, v, label) in enumerate(rows):
        if i % 100:
            continue
        scored = [(-cap(sum(a * b for a, b in zip(v, w))), j, other) for m, (j, w, other) in enumerate(rows) if m != k]
        near = sorted(s[:2] for s in scored if s[2] == label)[:positives]
        for p, j in near:
            inside = sorted((s, m) for s, m, other in scored if other != label and low * -p <= 100 * -s <= high * -p)[:keep]
            out += [(i, j, n + 1, m, -p, -s) for n, (s, m) in enumerate(inside)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "v", "r", "d") for r in rows], SCHEMA)


def mined(spark, rows, **more):
    return sorted(tuple(r) for r in negatives.mined(frame(spark, rows).repartition(4), **more).collect())


def fixture(n=700, size=8, spread=1.0, seed=5):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, spread) + 0.5, 2) for _ in range(size)], rng.randint(0, 9)) for i in range(n)]
    rows += [(1000 + i, [0.5, 0.25, 0.25, 0.0, 0.0, 0.0, 1.0, 1.0], i % 3) for i in range(200)]  # ties: equal vectors
    rows += [(2000, None, 1), (2001, [1.0, None], 1), (2002, [float("nan")] * size, 1), (2003, [float("inf")] * size, 1),
             (2100, [1.0] * size, None), (None, [1.0] * size, 1), (2200, [], 1), (2300, [1.0, 1.0], 1), (2301, [2.0] * (size + 4), 2),
             (2400, [1.5] * size, 4), (-100, [0.5] * size, 3)]
    return rows


@pytest.mark.parametrize("block", [4096, 3])
def test_against_all_pairs(spark, block):
    rows = fixture()
    assert mined(spark, rows, block=block) == brute(rows)


def test_repeated_rows_and_ids(spark):
    rows = fixture(200)
    rows += [rows[100], rows[100], (100, [0.5] * 8, 2), rows[55], rows[55]]
    # Ids name a repeated anchor or positive together, so only the rows are compared, not which copy gave them.
    assert mined(spark, rows) == brute(rows)


def test_large_components_stay_exact(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.choice([1, 2, 3]) * 10 ** rng.choice([3, 6])) for _ in range(3)], i % 4) for i in range(150)]
    assert mined(spark, rows) == brute(rows)
    rows += [(151, [3e38, 1.0, 1.0], 1), (200, [2e38, 1.0, 0.0], 1), (201, [1e38, 1.0, 0.0], 2)]
    assert mined(spark, rows) == brute(rows)


def test_other_windows(spark):
    rows = fixture(300)
    assert mined(spark, rows, low=0, high=90, keep=2, positives=3) == brute(rows, 2, 3, 0, 90)
    with pytest.raises(ValueError):
        negatives.mined(frame(spark, rows), low=90, high=80)


def test_tables_without_answers(spark):
    rows = fixture(100)
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 2)]) == []
    assert mined(spark, [(100, [1.0], 2), (1, [1.0], 2)]) == []  # no negatives
    assert mined(spark, [(100, [1.0], 2), (1, [1.0], 3)]) == []  # no positives
    assert mined(spark, [r for r in rows if r[0] is None or r[0] % 100]) == []
