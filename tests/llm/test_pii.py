"""Strict forms against Python's regular expressions; patterns on planted contexts."""

import hashlib
import random
import re

from doseloom.llm import pii

SCHEMA = "doc_id long, text string, kind string"
FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(text):
    out = []
    for n, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) \
                    or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) \
                    or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, m.end(), kind))
    return sorted(out)


def test_strict_forms(spark):
    rng = random.Random(8)
    bits = ["a@b.c", "_d@e.f", "x.y+z@mail-1.example.com", "@", ".", "..", "1.2.3.4", "256.1.1.1", "001.02.3.255", "4845168114407329",
            "4845 1681-1440 7329", "7536784127813050", "+1 (017) 555-7713", "+44 20 7946 0958", "+1-2", "+", " ", "  ", "-", "\n", "é",
            "🙂", "9", "12", "%", "(", "the"]
    rows = [(d, "".join(rng.choice(bits) for _ in range(rng.randint(1, 25))), "k") for d in range(1500)]
    rows += [(9000, None, None), (9001, "", None), (9002, "a" * 60000 + " a@b.co", None), (9003, "1 " * 30000, None),
             (9004, "+1" * 20000, None), (9005, "1." * 30000, None), (None, "a@b.co", None)]
    got = {r.doc_id: r for r in pii.digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for d, text, _ in rows:
        want = base(text or "")
        listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert got[d].base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (d, text and text[:80], listed[:200], got[d].spans[:200])
        assert [got[d][f"n_{k}"] for k in FORMS] == [sum(k == w[3] for w in want) for k in FORMS]
        assert set(filter(None, listed.split(","))) <= set(got[d].spans.split(","))


def test_patterns_find_unseen_identifiers(spark):
    rng = random.Random(1)
    rows = [(d, f"Please call me at +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} today.", "k") for d in range(20)]
    rows += [(100, "Or call me at (415) 555-0199, thanks.", None), (101, "Order 4155550199 was sent, lot 20240101 too.", None),
             (102, "write to bob@localhost now", None)]
    rows += [(200 + d, f"please write to user{d}@mail.example.com soon", None) for d in range(10)]
    got = {r.doc_id: r.spans for r in pii.digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[100] == "phone:14:28"
    assert got[101] == ""
    assert got[102] == "email:9:22"


def test_copies_support_a_pattern_once(spark):
    rows = [(d, "agent id +1 (212) 555-0147 noted", None) for d in range(50)] + [(60, "agent id 212 555 0147 noted", None)]
    got = {r.doc_id: r.spans for r in pii.digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[60] == "" and got[0] == "phone:9:26"


def test_many_places_in_one_text(spark):
    # More matches than a block of the running sums and more characters than a page, entities beside candidates.
    rng = random.Random(4)
    text = "é " + " ".join(rng.choice(["ask 10.0.0.%d" % rng.randint(0, 300), "user%d@mail.example.com," % rng.randint(0, 99), "lot 77-a",
                                       "🙂 call +1 (212) 555-0147 or 212 555 0147"]) for _ in range(3000))
    rows = [(1, text, None), (2, text[:1023], None), (3, text[:1024], None), (4, text[:1025], None)]
    got = {r.doc_id: r for r in pii.spans(spark.createDataFrame(rows, SCHEMA)).collect()}
    for d, text, _ in rows:
        assert [(s.start, s.n, s.end, s.kind) for s in got[d].base] == base(text)
        assert all(text[s.start:s.end] == s.value for s in [*got[d].base, *got[d].added])
        covered = {i for s, _, e, _ in base(text) for i in range(s, e)}
        assert not any(i in covered for s in got[d].added for i in range(s.start, s.end))
    found = located_tokens(spark, rows)
    for d, text, _ in rows:
        covered = {i for s, _, e, _ in base(text) for i in range(s, e)}
        places = [(s.start, s.end) for s in found[d].tokens]
        assert places == sorted(places) and not any(i in covered for s, e in places for i in range(s, e))
        for s in [*found[d].base, *found[d].tokens]:
            words = text[max(0, s.start - 80):s.start].lower().split()
            assert s.patterns == [f"1 {words[-1]}"] * (len(words) > 0) + [f"2 {' '.join(words[-2:])}"] * (len(words) > 1)
    assert "212 555 0147" in {s.value for s in found[1].tokens}


def located_tokens(spark, rows):
    return {r.doc_id: r for r in pii.located_rows(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_empty_table(spark):
    assert pii.digests(spark.createDataFrame([], SCHEMA)).count() == 0
