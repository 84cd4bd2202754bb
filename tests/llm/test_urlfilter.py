"""Rules and redirect equivalence: a small web with known verdicts, and the SQL on the same rows."""

import duckdb
import pytest

import oracle_check
from doseloom.llm import queries, sql, urlfilter

RULES = queries.URL_RULES


def link(target, quote='"'):
    return f"<html><head><link rel='canonical' href={quote}{target}{quote}></head></html>"


def refresh(target):
    return f'<META HTTP-EQUIV="refresh" content="3; URL=\'{target}\'">'


#: url, html, (host, path, rule, verdict)
WEB = [
    ("http://a.Example.NET/x?q#f", None, ("a.example.net", "/x", "net/", "block")),
    ("http://example.net/en/1", "", ("example.net", "/en/1", "example.net/en/", "allow")),
    ("http://example.com/de/1", "<p>", ("example.com", "/de/1", "example.com/de/", "block")),
    ("http://x.org/fr/1", "<p>", ("x.org", "/fr/1", "org/fr/", "allow")),
    ("http://notexample.com/de/", "<p>", ("notexample.com", "/de/", None, "allow")),
    ("https://h.net", "<p>", ("h.net", "", None, "allow")),
    ("https://net/", "<p>", ("net", "/", "net/", "block")),
    # Aliases of a blocked page that is no row: a chain of a canonical link and a refresh, relative ones among them.
    ("http://shop.io/a/b?x=1&y=2", link("http://other.net/q"), ("shop.io", "/a/b", None, "block")),
    ("HTTP://SHOP.io/c", refresh("/a/b?x=1&amp;y=2"), ("shop.io", "/c", None, "block")),
    ("http://shop.io/a/d", link("../c", ""), ("shop.io", "/a/d", None, "allow")),
    ("http://shop.io/e/f", link("g", "'"), ("shop.io", "/e/f", None, "block")),
    ("http://shop.io/e/g", link("//shop.io/c#top"), ("shop.io", "/e/g", None, "block")),
    # One class with a block and an allow: the allow goes to those without a rule, the blocked one stays blocked.
    ("http://mix.io/1", link("http://w.org/fr/ok") + refresh("http://z.net/bad"), ("mix.io", "/1", None, "allow")),
    ("http://z.net/bad", "<p>", ("z.net", "/bad", "net/", "block")),
    ("http://mix.io/2", link("http://mix.io/1"), ("mix.io", "/2", None, "allow")),
    # No links: in comments and scripts, other schemes, only a fragment, another relation.
    ("http://calm.io/1", f"<!-- {link('http://z.net/bad')} --><script>'{link('http://z.net/bad')}'</script>", ("calm.io", "/1", None, "allow")),
    ("http://calm.io/2", link("mailto:a@z.net") + link("#z") + link(""), ("calm.io", "/2", None, "allow")),
    ("http://calm.io/3", '<link rel="stylesheet" href="http://z.net/bad"><a href="http://z.net/bad">', ("calm.io", "/3", None, "allow")),
    (None, link("http://z.net/bad"), ("", "", None, "allow")),
    ("no scheme", link("http://z.net/bad"), ("", "", None, "allow")),
    ("", None, ("", "", None, "allow")),
    ("http://loop.io/", link("http://loop.io/"), ("loop.io", "/", None, "allow")),
    ("http://long.net/" + "x" * 50_000, "y" * 300_000 + link("http://calm.io/9"), ("long.net", "/" + "x" * 50_000, "net/", "block")),
    ("http://calm.io/9", "<p>", ("calm.io", "/9", None, "block")),
]
SCHEMA = "page_id long, url string, html string, host string, node string, verdict int"


def pages(spark, web=WEB):
    rows = [(None if k == 3 else k, u, t, "h", "n", 7) for k, (u, t, _) in enumerate(web)]
    return spark.createDataFrame(rows + [rows[0], rows[7]], SCHEMA)


def test_small_web(spark):
    got = urlfilter.judged(pages(spark), urlfilter.rule_table(spark, RULES))
    found = sorted((tuple(r)[:5] for r in got.collect()), key=str)
    want = [(None if k == 3 else k, *w) for k, (_, _, w) in enumerate(WEB)]
    assert found == sorted(want + [want[0], want[7]], key=str)


def test_sql_says_the_same(spark):
    df = urlfilter.judged(pages(spark), urlfilter.rule_table(spark, RULES)).drop("alias")
    con = duckdb.connect()
    con.register("pages", pages(spark).select("page_id", "url", "html").toArrow())
    assert oracle_check.compare(df, con, sql.url_filter(RULES)) is None


def test_long_chain_of_redirects_and_a_star(spark):
    n = 60
    web = [(f"http://c.io/{k}", link(f"http://c.io/{k + 1}"), None) for k in range(n)] \
        + [(f"http://s.io/{k}", link("http://hub.net/"), None) for k in range(n)]
    more = spark.createDataFrame([(f"http://c.io/{n}#end", "http://hub.net/"), (None, "http://hub.net/"), ("http://c.io/1", None)],
                                 "from_url string, to_url string")
    rules = urlfilter.rule_table(spark, RULES)
    before = {r.verdict: r["count"] for r in urlfilter.judged(pages(spark, web), rules).groupBy("verdict").count().collect()}
    assert before == {"allow": n + 2, "block": n}
    after = urlfilter.judged(pages(spark, web), rules, more)
    assert [r.verdict for r in after.select("verdict").distinct().collect()] == ["block"]


def test_kept_rows_and_empty_tables(spark):
    rules = urlfilter.rule_table(spark, RULES)
    own = pages(spark)
    left = urlfilter.kept(own, rules)
    assert left.columns == own.columns
    assert left.count() == sum(w[3] == "allow" for _, _, w in WEB)
    assert urlfilter.judged(own.limit(0), rules).count() == 0 and urlfilter.kept(own.limit(0), rules).count() == 0
    assert {r.verdict for r in urlfilter.judged(own, urlfilter.rule_table(spark, [])).collect()} == {"allow"}
    with pytest.raises(ValueError):
        urlfilter.rule_table(spark, [("a", "/", "maybe")])
