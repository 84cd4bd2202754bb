"""URL filters: rules on hosts and paths, and redirect equivalence for what no rule names.

A rule is a host, a path and a verdict. It fits its host and all subdomains where the url's path
starts with the rule's; of several fitting rules the longest (host and path together) wins, of equally
long ones an allow, then the first in order of the rule's text.

Pages that no rule fits take the decision of their aliases. A canonical link or an immediate or
delayed ``refresh`` of a page makes an edge from its url to the target, and ``redirects`` may add more.
Connected components over these edges are classes of urls that lead to one another, targets that are
no pages themselves included. A class with an explicitly allowed url is allowed, else one with a
blocked url is blocked, so a block reaches every alias and an explicit allow takes precedence;
an url's own rule always holds for itself. What has neither rule nor class decision is allowed.

Urls are met again without their fragment, with scheme and host in lower case (A-Z). Only urls on an
edge are numbered and joined; a rule is looked up once for each distinct host.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is no
alias of anything; null or empty ``html`` has no links; tags in comments and scripts are no links; a
target with a scheme other than ``scheme://`` (``mailto:``), an empty one or only a fragment is no edge;
relative targets are put behind the url's directory, without folding ``..``; repeated rows are judged each, a null
``page_id`` like any other; empty tables give no rows; columns other than ``page_id``, ``url`` and ``html``
are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doseloom.llm.neardup import components
from doseloom.llm.tables import saved

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"
TAG = r"(?i)<(?:link|meta)\b[^>]*>"
CANONICAL = r"""(?i)^<link\b.*\brel\s*=\s*["']?\s*canonical\b"""
REFRESH = r"""(?i)^<meta\b.*\bhttp-equiv\s*=\s*["']?\s*refresh\b"""
HREF = r"""(?i)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
TARGET = r"""(?i)\burl\s*=\s*['"]?\s*([^'">]*)"""


def _lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def with_parts(rows: DataFrame, url: str) -> DataFrame:
    """Columns ``scheme``, ``host`` and ``path`` of an url column, and ``node``, the name under which it is met again."""
    at = F.instr(F.col(url), "://")
    rows = rows.withColumn("rest", F.when(at > 0, F.regexp_replace(F.col(url).substr(at + F.lit(3), F.length(url)), r"(?s)#.*$", ""))) \
        .withColumn("scheme", F.when(at > 0, _lower(F.col(url).substr(F.lit(1), at - 1))))
    rows = rows.withColumn("host", F.coalesce(_lower(F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1)), F.lit(""))) \
        .withColumn("rest", F.regexp_extract("rest", r"(?s)^[^/?#]*(.*)$", 1))
    return rows.withColumn("path", F.coalesce(F.regexp_extract("rest", r"(?s)^([^?#]*)", 1), F.lit(""))) \
        .withColumn("node", F.concat("scheme", F.lit("://"), "host", "rest")).drop("rest")


def resolved(target: Column) -> Column:
    """The url that a link of the page with these parts leads to; null where there is none."""
    origin = F.concat("scheme", F.lit("://"), "host")
    folder = F.when(F.col("path") == "", F.lit("/")).otherwise(F.regexp_replace("path", r"(?s)[^/]*$", ""))
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target) \
        .when(target.rlike(r"^(#|$)|^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None)) \
        .when(target.startswith("//"), F.concat(F.col("scheme"), F.lit(":"), target)) \
        .when(target.startswith("/"), F.concat(origin, target)) \
        .when(target.startswith("?"), F.concat(origin, F.col("path"), target)) \
        .otherwise(F.concat(origin, folder, target))


def links(pages: DataFrame) -> DataFrame:
    """``a, b``: different urls that a page's canonical link or refresh makes aliases."""
    seen = F.regexp_replace(F.col("html").cast("string"), HIDDEN, " ")
    tags = pages.select(F.col("url").cast("string").alias("url"), F.explode(F.regexp_extract_all(seen, F.lit(TAG), F.lit(0))).alias("tag"))
    href = F.concat(*[F.regexp_extract("tag", HREF, k) for k in (1, 2, 3)])
    target = F.when(F.col("tag").rlike(CANONICAL), href) \
        .when(F.col("tag").rlike(REFRESH), F.regexp_extract("tag", TARGET, 1))
    found = saved(tags.withColumn("target", F.trim(F.replace(target, F.lit("&amp;"), F.lit("&")))).where("target is not null")
                  .select("url", "target"), "page-links")
    own = with_parts(found, "url").select(F.col("node").alias("a"), resolved(F.col("target")).alias("far"))
    return _edges(saved(own, "page-targets"))


def _edges(pairs: DataFrame) -> DataFrame:
    """``a, b`` of rows (a, far) whose urls differ; each step's table keeps its expressions out of the next one's."""
    return saved(with_parts(pairs, "far").select("a", F.col("node").alias("b")), "page-aliases").where("a <> b").distinct()


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A table of rules: host, path, verdict (``allow`` or ``block``)."""
    if bad := [r for r in rules if r[2] not in ("allow", "block")]:
        raise ValueError(f"a verdict is 'allow' or 'block': {bad[0]}")
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, fits``: the rules of the host and of the domains above it, the strongest first."""
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)),
                        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = F.concat("host", "path")
    known = rules.select(_lower(F.col("host")).alias("domain"), F.struct(
        (-F.length(own)).alias("order"), F.col("verdict"), own.alias("rule"), F.col("path")).alias("fit"))
    return hosts.select("host", F.explode(above).alias("domain")).join(known, "domain") \
        .groupBy("host").agg(F.array_sort(F.collect_set("fit")).alias("fits"))


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (with ``host`` and ``path``) and ``own``: the winning rule and its verdict, or null."""
    hosts = _host_rules(urls.select("host").where("host <> ''").distinct(), rules)
    fits = hosts.select(F.col("host").alias("_host"), "fits")
    first = F.filter("fits", lambda r: F.startswith(F.col("path"), r["path"]))
    return urls.join(fits, F.col("host") == F.col("_host"), "left") \
        .withColumn("own", F.when(F.size(first) > 0, first[0])).drop("_host", "fits")


def classes(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, decision``: every linked url whose class has a decision."""
    urls = saved(edges.select(F.col("a").alias("url")).union(edges.select("b")).distinct()
                 .withColumn("id", F.monotonically_increasing_id()), "linked-urls")
    one, two = (urls.select(F.col("url").alias(k), F.col("id").alias(f"id_{k}")) for k in "ab")
    pairs = edges.join(one, "a").join(two, "b")
    labels = components(saved(pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
                              .distinct(), "url-links"))
    members = ruled(with_parts(urls, "url").select("url", "id", "host", "path"), rules) \
        .join(labels.withColumnRenamed("doc", "id"), "id").select("url", "label", F.col("own.verdict").alias("verdict"))
    members = saved(members, "url-classes")
    # "allow" is less than "block": the least verdict of a class is its decision.
    decided = members.groupBy("label").agg(F.min("verdict").alias("decision")).where("decision is not null")
    return members.join(decided, "label").select("url", "decision")


def judged(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages``: ``page_id, host, path, rule, verdict`` and ``alias`` (its class's decision).

    ``redirects`` holds more edges: ``from_url``, ``to_url``.
    """
    edges = links(pages)
    if redirects is not None:
        more = redirects.select(F.col("from_url").cast("string").alias("near"), F.col("to_url").cast("string").alias("far"))
        more = saved(with_parts(more, "near").select(F.col("node").alias("a"), "far"), "redirects")
        edges = edges.union(_edges(more)).distinct()
    edges = saved(edges, "url-edges")
    parts = with_parts(pages.select("page_id", F.col("url").cast("string").alias("url")), "url")
    urls = ruled(parts.select("page_id", "host", "path", "node"), rules)
    if edges.isEmpty():
        found = urls.withColumn("alias", F.lit(None).cast("string"))
    else:
        decided = saved(classes(edges, rules).select(F.col("url").alias("_url"), F.col("decision").alias("alias")), "url-decisions")
        found = urls.join(decided, F.col("node") == F.col("_url"), "left")
    return found.select("page_id", "host", "path", F.col("own.rule").alias("rule"),
                        F.coalesce("own.verdict", "alias", F.lit("allow")).alias("verdict"), "alias")


def kept(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """The rows of ``pages`` that are allowed, all columns."""
    gone = judged(pages, rules, redirects).where("verdict = 'block'").select(F.col("page_id").alias("id")).distinct()
    out = saved(gone, "blocked-pages")
    name = next(n for n in (f"_blocked{k}" for k in range(len(pages.columns) + 1)) if n not in pages.columns)
    return pages.join(out.withColumnRenamed("id", name), F.col("page_id").eqNullSafe(F.col(name)), "left_anti")
