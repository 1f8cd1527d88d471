import pytest
from granary.operators.export import Ledger
from granary.operators.markup import Unsupported, index_html, page_html, strict, strictly_rendered

PICTURE = {"tag": "img", "path": "a/b.avif", "width": 2, "height": 1.5, "sizeUnits": "em", "appearance": "mono chrome", "background": True, "title": "T<", "collapsed": False}


def test_both_formats_keep_what_they_can():
    tree = {"type": "structured-content", "content": [{"tag": "td", "colSpan": 2, "rowSpan": 0, "title": "x", "lang": "ja", "data": {"content": "a b", "k": "v w", "no": True}, "style": {"listStyleType": "square", "fontStyle": "italic"}, "content": ["<", 7, None]}, {"tag": "details", "content": {"tag": "summary", "content": "s"}}]}
    assert strict(tree, "mdict") == '<td data-sc-content="a b" data-sc-k="v w" class="sc-a-b style-font-italic style-list-square" title="x" lang="ja" colspan="2">&lt;7</td><div class="jr-details"><span class="jr-summary">s</span></div>'
    assert strict(tree, "apple") == '<td class="sc-a-b meta-k-v-w style-list-square" title="x">&lt;7</td><div class="jr-details"><span class="jr-summary">s</span></div>'


def test_links_images_and_readings():
    link = {"tag": "a", "href": "?query=%E7%8C%AB&x=1", "content": None}
    assert strict(link, "mdict") == '<a href="entry://%E7%8C%AB">猫</a>' and strict(link, "apple") == '<a href="x-dictionary:d:%E7%8C%AB">猫</a>'
    assert strict({"tag": "a", "href": "https://e.org/?a=1&b", "content": "e"}, "apple") == '<a href="https://e.org/?a=1&amp;b">e</a>'
    assert strict({"tag": "a", "href": "mailto:x", "content": "e"}, "mdict") == "e" == strict({"tag": "a", "content": "e"}, "mdict")
    images = {"a/b.avif": "b.png"}
    assert strict(PICTURE, "mdict", images) == '<img src="media/b.png" alt="T&lt;" class="gloss-image image-mono-chrome image-background" title="T&lt;" style="width:2em;height:1.5em"/>'
    assert strict(PICTURE, "apple", images) == '<img src="Images/b.png" alt="T&lt;" style="width:2em;height:1.5em" class="gloss-image image-mono-chrome image-background" title="T&lt;"/>'
    ruby = [{"tag": "ruby", "content": ["猫", {"tag": "rp", "content": "("}, {"tag": "rt", "content": "ねこ"}]}, {"tag": "rt", "content": "x"}, {"tag": "br"}]
    assert strict(ruby, "mdict") == "<ruby>猫<rp>(</rp><rt>ねこ</rt></ruby><rt>x</rt><br>" and strict(ruby, "apple") == "<ruby>猫(<rt>ねこ</rt></ruby>x<br/>"


@pytest.mark.parametrize("bad", [{"tag": "script"}, {"content": "no tag"}, True, {"tag": "img", "path": "gone.png"}, {"tag": "img"}, "a\x00b", {"tag": "span", "data": {"k": "\x0b"}}])
def test_what_a_format_lacks_is_an_error(bad):
    with pytest.raises(Unsupported):
        strict(bad, "mdict")


def test_ledger_and_table(spark):
    ledger = Ledger()
    strict([{"tag": "span", "style": {"color": "red", "listStyleType": "x"}}, {"tag": "a", "content": "y"}], "apple", ledger=ledger)
    assert {(f, how) for f, how, _, _ in ledger.rows()} == {("tag:span", "exact"), ("style:color", "degraded"), ("style:listStyleType", "lossless-transform"), ("link:missing", "degraded")}
    df = spark.createDataFrame([(1, '{"tag": "div", "content": [1, 2.5]}'), (2, None)], "k int, tree string")
    got = {r.k: (r.markup, [tuple(x) for x in r.ledger]) for r in strictly_rendered(df, "tree", "mdict").collect()}
    assert got == {1: ("<div>12.5</div>", [("tag:div", "exact", "", 1)]), 2: (None, [])}


def test_index_html():
    node = {"tag": "th", "colSpan": 3, "data": {"class": "a b", "code": 5, "other": "x"}, "style": {"marginTop": 0.5, "color": "red"}, "content": [{"tag": "a", "href": "?query=x y", "content": "l"}, {"tag": "a", "href": "https://e.org"}]}
    assert index_html(node) == '<th data-sc-class="a b" data-sc-code="5" class="a-b" colspan="3" style="margin-top:0.5"><a href="bword://x%20y">l</a><a href="https://e.org"></a></th>'
    assert index_html(PICTURE, {"a/b.avif": "b.png"}) == '<span class="gloss-image-container"><img data-sc-appearance="mono chrome" data-sc-collapsed="false" data-sc-background="true" data-sc-size-units="em" class="gloss-image image-mono-chrome image-background" title="T&lt;" style="width:2em;height:1.5em" src="b.png" alt="T&lt;"></span>'
    assert index_html(PICTURE | {"collapsible": True}).startswith('<details class="gloss-image-container" open><summary>T&lt;</summary><img ')
    for bad in ({"tag": "b"}, {"tag": "img"}, False):
        with pytest.raises(Unsupported):
            index_html(bad)


def test_page_html_takes_everything():
    node = [{"tag": "b", "content": ["x<", True]}, {"tag": "td", "colSpan": 2, "style": {"fontSize": "2em"}, "data": {"sentence_Key": "k"}, "content": {"tag": "a", "href": "/y", "title": "t"}}, {"tag": "br"}, {"tag": "span", "style": "color:red", "content": None}]
    assert page_html(node) == 'x&lt;True<td style="font-size:2em" colspan="2" data-sc-sentence-key="k"><a href="/y" title="t" target="_blank" rel="noreferrer"></a></td><br><span style="color:red"></span>'
