"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Entities with a strict form (e-mail addresses, IP addresses, card and phone numbers) are the
seeds. What stands before an entity, its last word and its last two words, is a pattern;
patterns and the identifiers they introduce form a graph. Each round scores a pattern by the
share of its distinct identifiers that are of a kind, and an identifier by the patterns
that introduce it. Patterns with enough support and confidence then add the identifiers
that the strict forms miss, such as a phone number without its country code.

The strict forms are matched with possessive quantifiers and only from where a run of their
characters begins (or the previous match ended), which finds the same matches without
backtracking over long runs.

Defined results: null and empty texts have no spans; rows are judged each, also when ids repeat or
are null; copies of one identifier support a pattern once; without seeds no pattern is
learned; an empty table gives no rows; columns other than ``doc_id`` and ``text`` are not read.
Positions are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseloom.llm.tables import saved, text_rows

KINDS = ("email", "ip", "card", "phone")
# The strict forms. \G is the end of the previous match.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What looks like an identifier: a token with a digit or @, with the number groups that follow it.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[0-9()./-]++(?!\S))*+(?:\x20[0-9()./-]++[,;:!?]++(?!\S))?+"
# What an identifier that a pattern introduces must look like to be of a kind.
LOOKS = {
    "email": r"^[^\s@]+@[^\s@]+$",
    "ip": r"^[0-9]{1,3}([.:-][0-9]{1,3}){3}$",
    "card": r"^([0-9][ .-]?){11,18}[0-9]$",
    "phone": r"^[+(]?([0-9][ ().-]{0,3}){6,14}[0-9]$",
}
_PAGE = 1024  # characters that are read at a time
_SPAN = "array<struct<start:int,end:int,value:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(items: Column, weight: Callable[[Column], Column], join: Callable[[Column, Column], Column],
             place: Callable[[Column, Column], Column], of: str) -> Column:
    """``place(what came before, item)`` of every item, where ``join`` adds an item's weight to what came before.

    An array that grows by an item is copied, so the items go by blocks of the square root of their number.
    """
    def blocks_of(held: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(held))).cast("int"), F.lit(16))
        last = F.floor(F.greatest(F.size(held) - 1, F.lit(0)) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(held, k * size + 1, size))

    def listed(held: Column, begin: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column],
               kind: str) -> Column:
        first = F.struct(begin.alias("at"), F.array().cast(kind).alias("out"))
        return F.aggregate(held, first, lambda s, x: F.struct(
            step(s["at"], x).alias("at"), F.concat(s["out"], F.array(out(s["at"], x))).alias("out")), lambda s: s["out"])

    def walked(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda t, x: join(t, weight(x))))
        begins = listed(totals, F.lit(0), join, lambda at, _: at, "array<int>")
        return F.flatten(F.zip_with(blocks, begins, lambda block, begin: listed(
            block, begin, lambda at, x: join(at, weight(x)), place, of)))

    return _let(_let(items, blocks_of), walked)


def located(text: Column, form: str) -> Column:
    """All matches of a form with their places: the pieces between matches give the offsets."""
    found, between = F.regexp_extract_all(text, F.lit(form), F.lit(0)), F.split(text, form, -1)
    pairs = _let(found, lambda f: F.zip_with(f, F.slice(between, F.lit(1), F.size(f)), lambda m, b: F.struct(
        m.alias("m"), F.length(b).alias("gap"), F.length(m).alias("size"))))
    return _running(pairs, lambda p: p["gap"] + p["size"], lambda a, b: a + b, lambda at, p: F.struct(
        (at + p["gap"]).alias("start"), (at + p["gap"] + p["size"]).alias("end"), p["m"].alias("value")), _SPAN)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        x = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, x).otherwise(F.when(x > 4, x * 2 - 9).otherwise(x * 2))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) > 3, F.lit(False))
                        .otherwise(F.concat(F.lit("0"), p).try_cast("int") <= 255))
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _trimmed(span: Column) -> Column:
    """A candidate without the marks around it."""
    lead = F.length(F.regexp_extract(span["value"], r"^[^A-Za-z0-9+(]*+", 0))
    trail = F.length(F.regexp_extract(F.reverse(span["value"]), r"^[^A-Za-z0-9)]*+", 0))
    size = F.length(span["value"])
    trail = F.when(lead + trail > size, size - lead).otherwise(trail)
    return F.struct((span["start"] + lead).alias("start"), (span["end"] - trail).alias("end"),
                    F.substring(span["value"], lead + 1, size - lead - trail).alias("value"))


def _strict(text: Column, n: int, kind: str) -> Column:
    """Matches of one form that pass its test."""
    found = F.filter(located(text, FORMS[kind]), lambda s: _valid(kind, s["value"]))
    # Only texts that hold the form's own character are searched.
    mark = {"email": "@", "phone": "+"}.get(kind)
    found = F.when(F.instr(text, mark) > 0 if mark else text.rlike("[0-9]"), found).otherwise(F.array().cast(_SPAN))
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("n"), s["end"].alias("end"),
                                                 F.lit(kind).alias("kind"), s["value"].alias("value")))


def _entities(text: Column) -> Column:
    return F.array_sort(F.concat(*[_strict(text, n, kind) for n, kind in enumerate(KINDS)]))


def _clear_of(spans: Column, others: Column) -> Column:
    """The spans that no other one overlaps: of those that begin before a span's end, none may end after its start.

    ``spans`` are in order and don't overlap each other.
    """
    event = lambda at, span, s: F.struct(
        at.alias("at"), span.alias("other"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))
    events = F.array_sort(F.concat(F.transform(spans, lambda s: event(s["end"], F.lit(0), s)),
                                   F.transform(others, lambda s: event(s["start"], F.lit(1), s))))
    reach = lambda e: F.when(e["other"] == 1, e["end"]).otherwise(0)
    marked = _running(events, reach, F.greatest, lambda far, e: F.struct(
        e["start"].alias("start"), e["end"].alias("end"), e["value"].alias("value"),
        ((e["other"] == 0) & (far <= e["start"])).alias("clear")), "array<struct<start:int,end:int,value:string,clear:boolean>>")
    return F.transform(F.filter(marked, lambda e: e["clear"]), lambda e: F.struct(
        e["start"].alias("start"), e["end"].alias("end"), e["value"].alias("value")))


def _before(pages: Column, start: Column, reach: int) -> Column:
    """The last words within ``reach`` characters before a place, lower-cased, marks kept."""
    k, page = F.floor(start / _PAGE).cast("int"), lambda i: F.coalesce(F.get(pages, i), F.lit(""))
    near = F.right(F.concat(page(k - 1), F.left(page(k), start % _PAGE)), F.lit(reach))
    return F.filter(F.split(F.lower(near), r"\s+"), lambda w: w != "")


def _patterns(words: Column) -> Column:
    """The last word and the last two words, where there are so many."""
    n = F.size(words)
    one, two = F.element_at(words, -1), F.concat_ws(" ", F.slice(words, F.greatest(n - 1, F.lit(1)), F.lit(2)))
    return F.when(n >= 2, F.array(F.concat(F.lit("1 "), one), F.concat(F.lit("2 "), two))) \
        .when(n == 1, F.array(F.concat(F.lit("1 "), one))).otherwise(F.array().cast("array<string>"))


def located_rows(docs: DataFrame, reach: int = 80) -> DataFrame:
    """Per row: ``rid``, ``doc_id``, entities of the strict forms and further candidates."""
    if not 0 < reach <= _PAGE:
        raise ValueError(f"reach is 1 to {_PAGE}")
    rows = text_rows(docs).withColumn("base", _entities(F.col("text")))
    marked = F.col("text").rlike("[0-9@]")
    tokens = F.when(marked, located(F.col("text"), CANDIDATE)).otherwise(F.array().cast(_SPAN))
    rows = rows.withColumn("tokens", F.transform(tokens, _trimmed)).withColumn("tokens", _clear_of(F.col("tokens"), F.col("base")))
    # A place is read from its page: to count to it from the start of a long text takes as long as the text.
    pages = F.regexp_extract_all(F.col("text"), F.lit(f"(?s).{{1,{_PAGE}}}"), F.lit(0))
    rows = rows.withColumn("pages", F.when(marked, pages).otherwise(F.array().cast("array<string>")))
    kept = F.filter("tokens", lambda t: reduce(lambda a, b: a | b, (t["value"].rlike(p) for p in LOOKS.values())))
    rows = rows.withColumn("tokens", kept)
    context = lambda s: _patterns(_before(F.col("pages"), s["start"], reach))
    return saved(rows.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id",
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["n"].alias("n"), s["end"].alias("end"),
                                               s["kind"].alias("kind"), s["value"].alias("value"),
                                               context(s).alias("patterns"))).alias("base"),
        F.transform("tokens", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
                                                 context(s).alias("patterns"))).alias("tokens")), "entities")


def learn(rows: DataFrame, rounds: int = 3, support: int = 3, confidence: float = 0.6) -> DataFrame:
    """``pattern, kind, confidence`` of the patterns that pass."""
    seen = rows.select(F.explode("base").alias("e")).select("e.kind", "e.value", F.explode("e.patterns").alias("pattern")) \
        .unionByName(rows.select(F.explode("tokens").alias("e"))
                     .select(F.lit(None).cast("string").alias("kind"), "e.value", F.explode("e.patterns").alias("pattern")))
    edges = saved(seen.groupBy("pattern", "value").agg(F.max("kind").alias("seed")), "pattern-graph")
    sizes = saved(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support), "pattern-sizes")
    seeds = edges.where("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    scores = seeds = saved(seeds, "seeds")
    accepted = None
    for _ in range(rounds):
        judged = edges.select("pattern", "value").join(scores, "value").groupBy("pattern", "kind") \
            .agg(F.sum("score").alias("good"), F.count(F.lit(1)).alias("support"))
        accepted = saved(judged.where(F.col("support") >= support).join(sizes, "pattern")
                         .select("pattern", "kind", (F.col("good") / F.col("n")).alias("confidence"))
                         .where(F.col("confidence") >= confidence), "patterns")
        doubt = F.sum(F.log(F.lit(1.0) - F.least(F.col("confidence"), F.lit(0.99))))
        found = edges.where("seed is null").join(accepted, "pattern").where(_of_kind(F.col("value"), F.col("kind"))) \
            .groupBy("value", "kind").agg((F.lit(1.0) - F.exp(doubt)).alias("score"))
        scores = saved(seeds.unionByName(found), "scores")
    return accepted


def _of_kind(value: Column, kind: Column) -> Column:
    return reduce(lambda a, b: a | b, ((kind == k) & value.rlike(p) for k, p in LOOKS.items()))


def spans(docs: DataFrame, rounds: int = 3, support: int = 3, confidence: float = 0.6, reach: int = 80) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``base`` and ``added`` spans (start, n, end, kind, value).

    A pattern is what stands within ``reach`` characters before an identifier; a longer word counts by its end.
    """
    rows = located_rows(docs, reach)
    accepted = learn(rows, rounds, support, confidence)
    met = saved(rows.select("rid", F.explode("tokens").alias("t"))
                .select("rid", "t.start", "t.end", "t.value", F.explode("t.patterns").alias("pattern")), "candidates")
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    best = F.max(F.struct("confidence", (-number).alias("m"), "kind"))  # one kind for one place: the surest
    added = met.join(accepted, "pattern").where(_of_kind(F.col("value"), F.col("kind"))) \
        .groupBy("rid", "start", "end", "value").agg(best.alias("b")) \
        .select("rid", F.struct("start", (-F.col("b.m")).alias("n"), "end", F.col("b.kind").alias("kind"), "value").alias("s")) \
        .groupBy("rid").agg(F.array_sort(F.collect_list("s")).alias("added"))
    added = saved(added, "added")
    base = F.transform("base", lambda s: F.struct(*[s[c].alias(c) for c in ("start", "n", "end", "kind", "value")]))
    none = F.array().cast("array<struct<start:int,n:int,end:int,kind:string,value:string>>")
    return rows.select("rid", "doc_id", base.alias("base")).join(added, "rid", "left") \
        .select("doc_id", "base", F.coalesce("added", none).alias("added"))


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """Counts and ``base_sha256`` of the strict forms, and ``spans``: all spans, per row."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return spans(docs).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "added"))).alias("spans"))
