"""Repeated passages against a walk over all 50-byte strings."""

import hashlib
import random

import pytest

from doseloom.llm import repeats

SCHEMA = "doc_id long, text string, lang string, groups string"


def removed(rows, m=50):
    least = {}
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - m + 1):
            w = raw[i:i + m]
            least[w] = min(least.get(w, doc), doc)
    out = []
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - m + 1):
            if least[raw[i:i + m]] < doc:
                gone[i:i + m] = b"\1" * m
        runs = sum(1 for i in range(len(raw)) if gone[i] and (not i or not gone[i - 1]))
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out.append((doc, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def fixture():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["the", "on", "é", "ing", "st", "re", "ß"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(25) for _ in range(6)]
    rows = []
    for d in range(120):
        parts = [text(rng.randint(0, 40)) for _ in range(3)]
        t = (" " + rng.choice(passages) + " ").join(parts) if d % 2 else " ".join(parts)
        if d % 3 == 0:  # everybody's passage, cut at different places
            t += passages[0][rng.randint(0, 20):]
        rows.append((d, t, "en", "x"))
    rows += [(200, rows[3][1], None, None), (201, rows[3][1], None, None), (202, "Thor " * 400, None, None),
             (203, "Thor " * 300, None, None), (204, None, None, None), (205, "", None, None),
             (206, rows[5][1][:60] + rows[7][1][-70:], None, None), (207, "x" * 49, None, None), (208, "x" * 49, None, None)]
    return rows


@pytest.mark.parametrize("hot", [20_000, 2])
def test_against_all_strings(spark, hot):
    rows = fixture()
    got = repeats.repeats(spark.createDataFrame(rows, SCHEMA), hot=hot).collect()
    mine = sorted((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in got)
    assert mine == removed(rows)


def test_groups_hold_equal_bytes_and_all_their_places(spark):
    rows = fixture()
    raw = {r[0]: (r[1] or "").encode() for r in rows}
    got = repeats.repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    members, size, inside = {}, {}, {}
    for r in got:
        for g in r.groups:
            members.setdefault(g.group, set()).add((r.doc_id, g.start))
            size[g.group] = g.length
            # A copy of a whole text is listed with that text; its first document shares it.
            if g.length == r.n_bytes and g.first_doc != r.doc_id and raw[g.first_doc] == raw[r.doc_id]:
                members[g.group].add((g.first_doc, 0))
            inside.setdefault(g.parent, set()).add(g.group)
    assert members

    def places(group):
        return members.get(group, set()).union(*(places(g) for g in inside.get(group, ())))

    for group in members:
        found = places(group)
        strings = {raw[d][at:at + size[group]] for d, at in found}
        assert len(strings) == 1 and len(strings.pop()) == size[group] >= 50
        assert len({d for d, _ in found}) > 1


def test_repeated_and_null_ids(spark):
    text = "a passage of well over fifty bytes that two rows of one id share with a third"
    rows = [(5, text, None, None), (5, text, None, None), (None, text, None, None)]
    got = repeats.digests(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, len(text)), (5, 0), (5, 0)]


def test_empty_table(spark):
    assert repeats.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_phrase_in_more_contexts_than_one_key_may_hold(spark):
    rng = random.Random(11)
    phrase = "all rights are reserved by the owners of this very page!"
    rows = [(d, f"{rng.getrandbits(160):040x}{phrase}{rng.getrandbits(160):040x}", None, None) for d in range(21_000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    base = repeats._based(docs, 4)
    hits = repeats.shared_keys(base, repeats._copy_hits(base, 50), 4).collect()
    assert any(r.hot for r in hits)
    got = sorted(map(tuple, repeats.digests(docs).collect()))
    assert got == removed(rows)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_spans_without_names(spark, hot):
    rows = fixture()
    got = repeats.repeats(spark.createDataFrame(rows, SCHEMA), hot=hot, with_groups=False).collect()
    mine = sorted((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in got)
    assert mine == removed(rows)


def test_strings_of_one_name_are_told_apart(spark):
    rows = fixture()
    got = repeats.repeats(spark.createDataFrame(rows, SCHEMA), with_groups=False, name_bits=4).collect()
    mine = sorted((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in got)
    assert mine == removed(rows)
