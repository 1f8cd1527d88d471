from granary.operators import export


def test_numeric_leaves_are_printed():
    node = {"tag": "div", "content": ["No. ", 3, {"tag": "b", "content": 1.5}, True, None]}
    assert "No. 3" in export.to_html(node) and "<b>1.5</b>" in export.to_html(node) and "True" not in export.to_html(node)
    assert "No. 3" in export.to_xdxf(node) and "<b>1.5</b>" in export.to_xdxf(node)
