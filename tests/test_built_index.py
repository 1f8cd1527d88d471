import pytest

from granary.operators.catalog import built_index

OWN = {"title": "T", "author": "A", "url": "https://own.example/", "languages": ("ja", "ru"), "description": "d", "revision": "2026.01.02.0-t-v1.2", "version": "1.2"}


def test_own_metadata_and_the_sources_attribution():
    source = {"title": "S", "format": 3, "sequenced": False, "attribution": "by S", "indexUrl": "https://s.example/", "isUpdatable": True}
    index = built_index(source, **OWN)
    assert (index["title"], index["sequenced"], index["attribution"], index["sourceLanguage"]) == ("T", False, "by S", "ja")
    assert not {"isUpdatable", "indexUrl", "downloadUrl"} & set(index)
    assert built_index({}, **OWN, update=("https://own.example/i", "https://own.example/z"))["isUpdatable"] is True
    assert built_index({}, **OWN)["format"] == 3


@pytest.mark.parametrize("wrong", [{"revision": "2026"}, {"url": "http://localhost/"}, {"update": ("https://own.example/i", "")}, {"update": ("https://s.example/i", "https://own.example/z"), "foreign": ("s.example",)}])
def test_wrong_metadata(wrong):
    with pytest.raises(ValueError):
        built_index({}, **(OWN | wrong))
