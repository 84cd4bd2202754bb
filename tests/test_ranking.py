import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from doseloom.operators import ranking
from doseloom.operators.scoring import RISK_LABELS

VALUES = st.lists(st.one_of(st.integers(-4, 4).map(float), st.floats(-1e6, 1e6, width=32),
                            st.just(float("nan")), st.none()), min_size=1, max_size=60)
FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, x double")


@given(VALUES)
@FEW
def test_percentile_rank_is_pandas(spark, values):
    want = pd.Series([np.nan if v is None else v for v in values], dtype="float64").rank(pct=True) * 100
    got = {r.id: r.percentile for r in ranking.percentile_ranks(frame(spark, values), "x").collect()}
    for i, w in enumerate(want):
        assert (got[i] is None) if pd.isna(w) else got[i] == pytest.approx(w, abs=1e-9)


@given(st.lists(st.integers(-20, 20), min_size=2, max_size=80))
@FEW
def test_describe_is_pandas(spark, values):
    got = ranking.describe(frame(spark, [float(v) for v in values]), "x").first()
    want = pd.Series(values, dtype="float64").describe()
    for mine, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"),
                         ("p50", "50%"), ("p75", "75%"), ("max", "max")):
        assert got[mine] == pytest.approx(want[theirs], abs=1e-9)


@pytest.mark.parametrize("bins", [5, 10])
@pytest.mark.parametrize("parts", [1, 17])
def test_quantile_cut_is_qcut(spark, bins, parts):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(size=997), 2)
    df = frame(spark, values.tolist()).repartition(parts)
    want = pd.qcut(pd.Series(values), bins, labels=False) + 1
    got = {r.id: r.bin for r in ranking.quantile_cut(df, "x", bins).collect()}
    assert [got[i] for i in range(len(values))] == want.tolist()


def test_quantile_cut_labels_nulls_and_equal_edges(spark):
    rows = ranking.quantile_cut(frame(spark, [1.0, 2.0, 3.0, 4.0, 5.0, None]), "x", 5, labels=RISK_LABELS).collect()
    assert {r.id: r.label for r in rows} == dict(enumerate([*RISK_LABELS, None]))
    with pytest.raises(Exception, match="not unique"):
        ranking.quantile_cut(frame(spark, [1.0] * 9 + [2.0]), "x", 5).collect()


def test_grouped_quantiles_and_hot_value(spark):
    rng = np.random.default_rng(5)
    data = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 5000, p=[0.8, 0.15, 0.05]),
                         "x": np.where(rng.random(5000) < 0.34, 7.0, rng.integers(0, 900, 5000).astype(float))})
    df = spark.createDataFrame(data)
    probs = [0, 0.05, 0.25, 0.5, 0.77, 0.95, 1]
    got = {r.g: r.quantiles for r in ranking.quantiles(df, "x", probs, ["g"]).collect()}
    for g, part in data.groupby("g"):
        assert got[g] == pytest.approx(np.percentile(part.x, [100 * p for p in probs]), abs=1e-9)


def test_running_totals_both_ways(spark):
    rows = [("a", v, v % 3 + 1) for v in range(200)] + [("b", v, 1) for v in range(0, 50, 7)]
    df = spark.createDataFrame(rows, "g string, v long, n long")
    for down in (False, True):
        got = {(r.g, r.v): (r.before_n, r.all_n) for r in ranking.running_totals(df, "v", ["n"], ["g"], down).collect()}
        assert len(got) == len(rows)
        for g, v, _ in rows:
            before = sum(n for h, w, n in rows if h == g and (w > v if down else w < v))
            assert got[(g, v)] == (before, sum(n for h, _, n in rows if h == g))


def test_string_order(spark):
    keys = [f"n{i}" for i in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r.k: r.i for r in ranking.number_keys(df, "k", "i").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_hash_order_is_a_permutation_per_group(spark):
    df = spark.createDataFrame([(i, "big" if i < 800 else "small") for i in range(1000)], "id long, g string")
    first = ranking.hash_order(df.repartition(13), ["id"], ["g"], 42).collect()
    again = {r.id: r.ordinal for r in ranking.hash_order(df.coalesce(1), ["id"], ["g"], 42).collect()}
    other = {r.id: r.ordinal for r in ranking.hash_order(df, ["id"], ["g"], 7).collect()}
    assert {r.id: r.ordinal for r in first} == again != other
    for g, n in (("big", 800), ("small", 200)):
        assert sorted(r.ordinal for r in first if r.g == g) == list(range(1, n + 1))
        assert {r.group_size for r in first if r.g == g} == {n}


def test_z_scores(spark):
    values = [1.0, 2.0, 4.0, 8.0]
    got = [r.zscore for r in ranking.z_scores(frame(spark, values), "x").orderBy("id").collect()]
    s = pd.Series(values)
    assert got == pytest.approx(((s - s.mean()) / s.std()).tolist())
    moved = [r.zscore for r in ranking.z_scores(frame(spark, [v + 100 for v in values]), "x").orderBy("id").collect()]
    assert moved == pytest.approx(got)
    assert {r.zscore for r in ranking.z_scores(frame(spark, [3.0, 3.0]), "x").collect()} == {None}


def test_tails_overlap_on_ties(spark):
    rows = ranking.percentile_tails(frame(spark, [5.0] * 10), "x").collect()
    assert len(rows) == 10 and all(r.in_bottom and r.in_top for r in rows)
