"""Merkle manifest and octopus multiproofs against a plain walk over the whole tree."""

import hashlib
import random
import zlib

import pytest

from doseloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, idx long, leaf string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    fields = [None if doc_id is None else str(doc_id), source, lang, None if n_chars is None else str(n_chars), text]
    return h(*["-" if f is None else f"{len(f.encode())}:{f}" for f in fields])


def levels(line):
    out = [line]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k:k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, idx):
    """(before, after) per level."""
    out = []
    for line in tree[:-1]:
        a = idx // 3 * 3
        out.append((line[a:idx], line[idx + 1:a + 3]))
        idx //= 3
    return out


def brute(rows):
    groups = {}
    for d, t, lang, s, n, *_ in rows:
        groups.setdefault(s, []).append((d is not None, d or 0, leaf(d, t, lang, s, n), (d, t, lang, s, n)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: r[:3])
        trees[s] = levels([r[2] for r in groups[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for idx, (_, _, own, (d, t, lang, s, n)) in enumerate(groups[s]):
            path = siblings(trees[s], idx) + siblings(top, place)
            odd = d is not None and t is not None and zlib.crc32(str(d).encode()) % 2 == 0
            node = leaf(d, t.replace("\n", ""), lang, s, n) if odd else own
            for before, after in path:
                node = h(*before, node, *after)
            out.append((d, own, trees[s][-1][0], top[-1][0], h(*[x for b, a in path for x in (*b, *a)]), node, node == top[-1][0]))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(11)
    sources = [None, "", "web", "Web", "ärz", "news", "hot", "hot", "hot", "hot"]
    rows = [(d, "".join(rng.choice("ab\né ") for _ in range(rng.randint(0, 9))), rng.choice(["en", None]), rng.choice(sources),
             rng.choice([None, 5]), "t", 1, "l") for d in range(300)]
    rows += [(None, "null id\n", "en", "web", 1, None, None, None), (7, "again\n", "en", "web", 2, None, None, None), rows[3], rows[3],
             (900, None, None, None, None, None, None, None), (901, "", "", "", 0, None, None, None),
             (902, "x\n" * 200_000, "en", "alone", 400_000, None, None, None)]
    return rows


@pytest.mark.parametrize("lot", [1 << 15, 7])
def test_against_a_whole_tree(spark, monkeypatch, lot):
    monkeypatch.setattr(merkle, "_LOT", lot)
    rows = fixture()
    got = merkle.proved(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_more_leaves_than_a_piece_holds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "_LOT", 4000)
    rows = [(d, f"text {d}\n" if d % 3 else f"text {d}", "en", "one" if d < 41_000 else "two", d) for d in range(41_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    tree = merkle.manifest(docs)
    want = {r[0]: r for r in brute(rows)}
    got = merkle.proofs(tree, with_proofs=False).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert {r.doc_id: tuple(r) for r in got.collect()} == want
    assert tree.root() == want[0][3]


def test_some_documents_fetch_only_their_octopus(spark):
    rows = fixture()
    tree = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    wanted = spark.createDataFrame([(3,), (50,), (51,), (902,), (None,), (12345,)], "doc_id long")
    got = merkle.proofs(tree, wanted).collect()
    want = {(r[0], r[1]): r for r in brute(rows)}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 3)] * 3 + [(False, 50), (False, 51), (False, 902), (True, 0)]
    for r in got:
        assert (r.subroot, r.root, r.proof_sha256) == want[r.doc_id, r.leaf][2:5]
        assert r.proof_sha256 == h(*r.proof) and len(r.shape) % 2 == 0
        assert merkle.fold(r.leaf.encode(), [p.encode() for p in r.proof], r.shape).decode() == r.root
        assert merkle.fold(h("other").encode(), [p.encode() for p in r.proof], r.shape).decode() != r.root


def test_octopus_is_least():
    rng = random.Random(3)
    for _ in range(200):
        width = rng.randint(1, 100)
        own = rng.sample(range(width), rng.randint(1, width))
        got = merkle.octopus(own, width)
        known, need, level, wide = set(own), [], 0, width
        while wide > 1:  # every sibling of a known node that is not known
            runs = {i // 3 for i in known}
            need += [(level, i) for i in range(wide) if i // 3 in runs and i not in known]
            known, level, wide = runs, level + 1, -(-wide // 3)
        assert sorted(got) == sorted(need) and len(set(got)) == len(got)
    assert merkle.octopus(list(range(81)), 81) == []


def test_empty_table(spark):
    tree = merkle.manifest(spark.createDataFrame([], SCHEMA))
    assert tree.root() is None and merkle.proofs(tree).count() == 0
