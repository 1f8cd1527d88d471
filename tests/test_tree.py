import json

import pytest
from granary.functions import jsontree as J
from granary.operators import export, tree

BODY = [
    {
        "tag": "div",
        "data": {"content": "sense"},
        "content": [
            {"tag": "ul", "lang": "en", "data": {"content": "glossary"}, "content": [{"tag": "li", "content": " to eat "}, {"tag": "li", "content": "to dine"}]},
            {"tag": "div", "data": {"content": "example-sentence-a"}, "content": "食べる"},
            {"tag": "div", "data": {"content": "example-sentence-b"}, "lang": "en", "content": "I eat."},
            {"tag": "span", "data": {"content": "misc-info"}, "title": "polite form", "content": "pol"},
            {"tag": "img", "path": "a/b.png", "title": "x/y~z"},
        ],
    },
    {"tag": "div", "data": {"content": "attribution"}, "content": "Some Source"},
]


def test_pointers():
    v = {"a/b": [1, {"~": 2}]}
    assert J.pointer_get(v, "/a~1b/1/~0") == 2 and J.pointer_get(v, "") is v
    J.pointer_set(v, "/a~1b/0", 9)
    assert v["a/b"][0] == 9
    assert J.canonical({"b": 1, "a": "é"}) == '{"a":"é","b":1}'


def test_units_and_sets():
    got = [(u.pointer, u.role, u.text) for u in J.units(BODY)]
    assert got == [
        ("/0/content/0/content/0/content", "glossary", "to eat"),
        ("/0/content/0/content/1/content", "glossary", "to dine"),
        ("/0/content/2/content", "example", "I eat."),
        ("/0/content/3/title", "tooltip", "polite form"),
        ("/0/content/3/content", "register", "pol"),
    ]
    sets = [u for u in J.units(BODY, glossary_sets=True)]
    assert sets[0].role == "glossary_set" and json.loads(sets[0].text) == BODY[0]["content"][0]["content"]


def test_senses_and_media():
    s = J.senses(BODY)
    assert s == [{"sense": 1, "glosses": ["to eat", "to dine"], "labels": ["pol"], "examples": [("食べる", "I eat.")]}]
    assert J.media_paths(BODY) == ["a/b.png"] and J.visible(BODY).startswith("to eat to dine")


def test_translation_changes_only_its_leaves():
    p = "/0/content/0/content/0/content"
    out = J.translated(BODY, {p: "есть"}, "ru")
    assert J.pointer_get(out, p) == " есть " and BODY[0]["content"][0]["content"][0]["content"] == " to eat "
    assert out[0]["content"][0]["lang"] == "en" and J.translated(BODY, {"/0/content/2/content": "x"}, "ru")[0]["content"][2]["lang"] == "ru"
    assert J.fingerprint(BODY, [p]) == J.fingerprint(out, [p]) != J.fingerprint(out, [])
    assert J.composed([{"tag": "li", "content": "a"}], ["x", "y"]) == [{"tag": "li", "content": "x"}, {"tag": "li", "content": "y"}]
    assert J.composed("a", ["x"]) == "x"
    with pytest.raises(ValueError):
        J.composed([{"tag": "li"}], ["x"])


def test_node_and_unit_tables(spark):
    df = spark.createDataFrame([(1, json.dumps(BODY)), (2, None), (3, '"x"')], "id long, body string")
    nodes = tree.node_table(df, "id", "body")
    rows = {r.node_no: r for r in nodes.where("id = 1").collect()}
    assert rows[0].parent_no is None and all(rows[r.parent_no].node_no < r.node_no for r in rows.values() if r.parent_no is not None)
    assert len(rows) == sum(1 for _ in J.nodes(BODY)) and nodes.where("id = 3").first().kind == "string"
    units = tree.unit_table(df, "id", "body").collect()
    assert [u.text for u in sorted(units, key=lambda u: u.ordinal)] == [u.text for u in J.units(BODY)] and units[0].byte_count == len(units[0].text)
    assert {(r.kind, r.name): r.n for r in tree.features(nodes).collect()}[("tag", "div")] == 4
    assert "to dine" in [r.text for r in tree.leaves(nodes, "id").where("selector = 'glossary'").collect()]
    targets = spark.createDataFrame([(1, "/0/content/2/content", '"Я ем."')], "id long, pointer string, target string")
    done = {r.id: r.body for r in tree.applied(df, targets, "id", "body", "ru").collect()}
    assert "Я ем." in done[1] and done[3] == '"x"' and done[2] is None


def test_renderers_and_ledger(spark):
    ledger = export.Ledger()
    markup = export.to_html(BODY, ledger)
    assert tree.html_is_sound(markup) and 'class="glossary"' in markup and '<img src="a/b.png"' in markup
    assert not tree.html_is_sound("<b><i></b></i>")
    text = export.to_xdxf({"tag": "div", "content": [{"tag": "ruby", "content": ["食", {"tag": "rt", "content": "た"}]}, {"tag": "b", "content": "<x>"}]}, ledger)
    assert text == "食(た)<b>&lt;x&gt;</b>\n" and ("rt", "degraded", "brackets") in ledger
    df = spark.createDataFrame([(1, json.dumps(BODY))], "id long, body string")
    r = export.rendered(df, "body", "html")
    assert r.first().markup == markup
    assert {x.feature for x in export.ledger_totals(r).collect()} >= {"li", "image"}


def test_html_elements(spark):
    df = spark.createDataFrame([(1, "<html><body><p class=a>x<br>y<a href='u'>z</a></p><p>open</body></html>"), (2, ""), (3, None)], "id long, html string")
    rows = sorted(tree.html_elements(df, "id", "html").collect(), key=lambda r: r.node_no)
    assert [r.tag for r in rows] == ["html", "body", "p", "br", "a", "p"] and rows[2].text == "xy" and rows[4].link == "u" and rows[4].parent_no == 2


def test_features_go_through_the_nodes_once(spark):
    d = spark.createDataFrame([(1, '{"tag":"p","data":{"content":"x"},"content":["a",null]}')], "i long, b string")
    f = tree.features(tree.node_table(d, "i", "b"))
    assert sorted(map(tuple, f.collect()))[:2] == [("data", "content", 1), ("kind", "array", 1)]
    assert f._jdf.queryExecution().optimizedPlan().toString().count("mapIn") + f._jdf.queryExecution().optimizedPlan().toString().count("MapIn") == 1


def test_trees_of_a_small_table_are_spread(spark):
    """Twenty thousand trees' parts are 180 KB in one row group, one task's work for Python."""
    import __spark_entry__
    from tests.conftest import DATA

    for name in ("tree_leaves", "tree_feature_counts", "mdict_markup", "apple_markup", "index_and_page_markup", "translatable_units"):
        plan = __spark_entry__.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan, name
