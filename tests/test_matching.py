import random

import pytest

from doseloom.operators import intervals, matching
from doseloom.sources.readers import bad_variant_ids, processed_weights, variant_list


def nearest(pos, listed, window):
    best = min(((abs(p - pos), p) for p in listed), default=(None, None))
    return best if best[0] is not None and best[0] <= window else (None, None)


@pytest.mark.parametrize("window,parts", [(0, 1), (1, 4), (5, 17), (50, 4), (5000, 3)])
def test_nearest_is_brute_force(spark, window, parts):
    rng = random.Random(window)
    span = max(60, window * 30)
    weights = [(rng.choice("12"), rng.randrange(span), i) for i in range(300)] + [("1", None, 900), (None, 3, 901)]
    listed = [(rng.choice("12"), rng.randrange(span)) for _ in range(200)] + [("2", None)]
    w = spark.createDataFrame(weights, "chrom string, pos int, id int").repartition(parts)
    v = spark.createDataFrame(listed, "chrom string, pos int")
    rows = matching.match_weights(w, v, window).collect()
    assert len(rows) == len(weights)
    for r in rows:
        want = (None, None)
        if r.pos is not None and r.chrom is not None:
            want = nearest(r.pos, [p for c, p in listed if c == r.chrom and p is not None], window)
        assert (r.distance, r.nearest_pos) == want
        kind = matching.NONE if want[0] is None else matching.EXACT if want[0] == 0 else matching.APPROXIMATE
        assert r.match_type == kind


def test_edges_of_the_window_and_counts(spark):
    w = spark.createDataFrame([("22", 100000, "a"), ("22", 100000, "b"), ("22", 105000, "c"), ("22", 205001, "d"),
                               ("22", 305000, "e"), ("22", 305000, "f")], "chrom string, pos int, id string")
    v = spark.createDataFrame([("22", 100000), ("22", 200000), ("22", 300000), ("22", 310000), ("21", 205001)],
                              "chrom string, pos int")
    got = {r.id: (r.match_type, r.nearest_pos) for r in matching.match_weights(w, v, 5000).collect()}
    assert got == {"a": ("Exact Match", 100000), "b": ("Exact Match", 100000), "c": ("Approximate Match", 100000),
                   "d": ("No Match", None), "e": ("Approximate Match", 300000), "f": ("Approximate Match", 300000)}
    s = matching.coverage_summary(w, v, 5000).first()
    # Distinct positions over all rows, and the mean over rows.
    assert (s.weight_rows, s.exact_positions, s.approximate_positions) == (6, 1, 2)
    assert s.exact_percent == pytest.approx(100 / 6) and s.exact_row_percent == pytest.approx(200 / 6)
    assert s.mean_distance == 5000.0
    assert [(r.chrom, r.pos) for r in matching.exact_positions(w, v).collect()] == [("22", 100000)]


def test_empty_weights_give_zeros(spark):
    none = spark.createDataFrame([], "chrom string, pos int")
    s = matching.coverage_summary(none, none, 5000).first()
    assert (s.weight_rows, s.exact_percent, s.approximate_percent, s.mean_distance) == (0, 0.0, 0.0, 0.0)


def test_examples_keep_five_per_type_and_limit_early(spark):
    w = spark.createDataFrame([("1", i, i) for i in range(100)], "chrom string, pos int, id int")
    v = spark.createDataFrame([("1", i * 10) for i in range(5)], "chrom string, pos int")
    found = matching.match_examples(matching.match_weights(w, v, 2), ["chrom", "pos", "id"])
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert sorted(r.pos for r in rows if r.match_type == "Exact Match") == [0, 10, 20, 30, 40]
    assert sorted(r.pos for r in rows if r.match_type == "Approximate Match") == [1, 2, 8, 9, 11]
    assert sorted(r.pos for r in rows if r.match_type == "No Match") == [3, 4, 5, 6, 7]


def test_variant_list_and_weights_read(spark, tmp_path):
    bim = tmp_path / "list.bim"
    bim.write_text("22  chr22:16050075:A:G  0 0 A G\n CHR22\tCHR22:17:A:C 0 0 A C\n21 21:5:A:T 0 0 A T\n"
                   "22 broken 0 0 A T\n22 22:x:A:T 0 0 A T\n\n")
    all_rows = variant_list(spark, str(bim))
    assert sorted((r.chrom, r.pos) for r in all_rows.where("pos is not null").collect()) == \
        [("21", 5), ("22", 17), ("22", 16050075)]
    assert bad_variant_ids(all_rows).first().bad_rows == 2
    assert variant_list(spark, str(bim), "21").count() == 1
    csv = tmp_path / "w.csv"
    csv.write_text("chr,pos,effect_allele,weight,id\nchr22,5,A,0.5,a\n chr22 ,6,C,1,b\nCHR21,7,C,1,c\n")
    assert [r.pos for r in processed_weights(spark, str(csv), "22").orderBy("pos").collect()] == [5, 6]


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("block", [7, 1000])
def test_wide_intervals_are_brute_force(spark, inclusive, block):
    rng = random.Random(11)
    spans = [(rng.choice(["chr1", "chr2"]), s := rng.randrange(400), s + rng.choice([0, 0, 3, 20, 150, -5]))
             for _ in range(25)] * 2 + [("chr1", None, 5), ("odd", 1, 500)]
    points = [(rng.choice(["chr1", "chr2", "chr3"]), rng.randrange(450), i) for i in range(400)]
    iv = spark.createDataFrame(spans, "contig string, start int, end int")
    contigs = spark.createDataFrame([("chr1",), ("chr2",)], "contig string")
    v = spark.createDataFrame(points, "contig string, position int, id int")
    kept = intervals.valid_intervals(iv, contigs)
    got = sorted(r.id for r in intervals.in_intervals(v, kept, inclusive, block).collect())

    def inside(c, p):
        return any(c == k and c != "odd" and s is not None and s <= e and s <= p and (p <= e if inclusive else p < e)
                   for k, s, e in spans)

    assert got == [i for c, p, i in points if inside(c, p)]


def test_region_literal(spark):
    v = spark.createDataFrame([("chr6", p) for p in (9, 10, 15, 20, 21)] + [("chr7", 15)], "contig string, position int")
    assert [r.position for r in v.where(intervals.in_region("chr6:10-20", True)).collect()] == [10, 15, 20]
    assert [r.position for r in v.where(intervals.in_region("chr6:10-20", False)).collect()] == [10, 15]
