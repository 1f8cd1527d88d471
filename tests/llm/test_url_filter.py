from granary.llm.url_filter import canonical, rules_frame, url_filter
from pyspark.sql import functions as F

RULES = [
    (1, "bad.com/", "block", 0),
    (2, "ok.bad.com/", "allow", 0),
    (3, "bad.com/x/", "allow", 0),
    (4, "ok.bad.com/secret/file.html", "block", 0),
    (5, "q.com/a?b=1", "block", 0),
    (6, "1.2.3.4/", "block", 0),
    (7, "tie.com/", "block", 0),
    (8, "tie.com/", "allow", 0),
    (9, "prio.com/deep/er/", "allow", 0),
    (10, "prio.com/", "block", 9),
    (11, None, "block", 99),
]
CASES = {
    "http://bad.com": ("block", 1),
    "https://user:pw@WWW.BAD.com.:8080/y#frag": ("block", 1),
    "http://ok.bad.com/z": ("allow", 2),
    "http://ok.bad.com/secret/file.html": ("block", 4),
    "http://ok.bad.com/secret/file.html/more": ("allow", 2),
    "http://bad.com/x/1": ("allow", 3),
    "http://bad.com/x": ("block", 1),
    "http://bad.com/w/../x//./1": ("allow", 3),
    "http://notbad.com/": ("pass", None),
    "http://q.com/a?b=1": ("block", 5),
    "http://q.com/a?b=2": ("pass", None),
    "http://1.2.3.4/foo": ("block", 6),
    "http://9.1.2.3.4/foo": ("pass", None),
    "http://tie.com/": ("allow", 8),
    "http://prio.com/deep/er/x": ("block", 10),
    "localhost/only": ("pass", None),
    "": ("pass", None),
    "   ": ("pass", None),
    "http://": ("pass", None),
    "http://bad.com/" + "d/" * 3000: ("block", 1),
}


def rules(spark):
    good = rules_frame(spark, [r for r in RULES if r[1]])
    return good.union(spark.sql("SELECT 11L, CAST(NULL AS STRING), 'block', 99")).union(good.limit(1))


def test_cases_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(i, u, "block", 7, "x") for i, u in enumerate(CASES)] + [(None, "http://bad.com", None, None, None), (0, "http://bad.com", "", 0, ""), (99, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, action string, rule_id long, u string")
    got = sorted(((r.page_id, r.url, r.action, r.rule_id) for r in url_filter(pages, rules(spark)).collect()), key=str)
    want = [(i, u, *CASES[u]) for i, u in enumerate(CASES)] + [(None, "http://bad.com", "block", 1), (0, "http://bad.com", "block", 1), (99, None, "pass", None)]
    assert got == sorted(want, key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter(none, rules(spark)).count() == 0
    one = spark.createDataFrame([(1, "http://bad.com")], "page_id long, url string")
    assert url_filter(one, rules(spark).limit(0)).collect()[0].action == "pass"


def test_canonical_form(spark):
    h, p, q = canonical(F.lit("HTTP://a@B..C./d/./e/../f/?q#z"))
    assert tuple(spark.range(1).select(h, p, q).first()) == ("b.c", "/d/f/", "?q")


def test_rules_are_brought_into_the_same_form(spark):
    made = rules_frame(spark, [(1, "https://user@Example.NET.:8080/a/./b/../c/", "block", 0), (2, "other.org", "block", 0)])
    pages = spark.createDataFrame([(1, "http://www.example.net/a/c/d"), (2, "http://example.net/a/b/c/"), (3, "https://OTHER.org/any")], "page_id long, url string")
    assert {r.page_id: r.action for r in url_filter(pages, made).collect()} == {1: "block", 2: "pass", 3: "block"}


def test_prefixes_alone_do_not_decide(spark, monkeypatch):
    """With every digest sharing one prefix the outcome is the same."""
    from granary.llm import url_filter as U

    pages = spark.createDataFrame(list(enumerate(CASES)), "page_id long, url string")
    want = sorted(map(tuple, url_filter(pages, rules(spark)).collect()), key=str)
    monkeypatch.setattr(U, "prefix", lambda digest: F.length(digest) * 0)
    assert sorted(map(tuple, url_filter(pages, rules(spark)).collect()), key=str) == want
