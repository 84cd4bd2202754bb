"""Whole repeated passages: planted ones come out once each, with all their places."""

import random

from doseloom.llm.passages import passages

SCHEMA = "doc_id long, text string, passage string"


def found(spark, rows):
    got = {}
    for r in passages(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.passage, []).append((r.doc_id, r.start, r.length, r.n_places))
    return got


def test_planted_passages_come_out_whole(spark):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz é") for _ in range(n))
    planted = [noise(n) for n in (60, 500, 1200, 3000)]
    texts = {d: noise(rng.randint(80, 400)) for d in range(60)}
    expected = {k: set() for k in range(len(planted))}
    for k, passage in enumerate(planted):
        for j, d in enumerate(rng.sample(sorted(texts), 3 + 9 * k)):
            left = "0123456789"[j % 10]  # borders differ, so the passage ends where it was planted
            texts[d] += left + "#" + noise(90)
            texts[d] = texts[d].replace("#", passage + "9876543210"[j % 10], 1)
    for k, passage in enumerate(planted):
        for d, text in texts.items():
            at = text.find(passage)
            if at >= 0:
                expected[k].add((d, len(text[:at].encode()), len(passage.encode())))
    got = found(spark, [(d, t, "x") for d, t in texts.items()])
    for k in expected:
        assert [{p[:3] for p in places} for places in got.values()].count(expected[k]) == 1
    # What else repeats is longer in fewer documents: border digits that came twice.
    whole = {frozenset((d, s) for d, s, *_ in places): places[0][2] for places in got.values()}
    for places in got.values():
        assert all(n == len(places) for *_, n in places)
        raw = {texts[d].encode()[s:s + n] for d, s, n, _ in places}
        assert len(raw) == 1 and len({d for d, *_ in places}) > 1
    assert len(whole) == len(got)


def test_three_documents_share_one_passage(spark):
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = noise(500)
    rows = [(d, noise(100 + 30 * d) + "xyz"[d] + passage + "uvw"[d] + noise(90), None) for d in range(3)]
    got = found(spark, rows)
    assert list(map(sorted, got.values())) == [[(d, 101 + 30 * d, 500, 3) for d in range(3)]]


def test_copies_nulls_and_empty_table(spark):
    text = "a text of well over fifty bytes that stands in three rows from end to end, and nowhere else"
    rows = [(4, text, None), (7, text, None), (9, text, None), (9, text, None), (2, None, None), (3, "", None), (5, "short", None)]
    got = found(spark, rows)
    assert list(map(sorted, got.values())) == [[(d, 0, len(text), 3) for d in (4, 7, 9)]]
    assert found(spark, []) == {}
