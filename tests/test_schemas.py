import json
import zipfile

import pytest

from granary.operators.catalog import archive_issues, schema_issues

BANK = {"$defs": {"score": {"type": "number", "minimum": 0}}, "type": "array", "items": {"type": "array", "items": [{"type": "string", "maxLength": 5}, {"$ref": "#/$defs/score"}], "additionalItems": False, "minItems": 2}}
INDEX = {"type": "object", "required": ["format"], "properties": {"format": {"const": 3}}, "if": {"required": ["isUpdatable"]}, "then": {"required": ["indexUrl"]}}


@pytest.mark.parametrize(
    "schema, good, bad",
    [
        ({"$ref": "#/definitions/a", "definitions": {"a": {"minimum": 2}}}, 2, 1),
        ({"allOf": [{"minimum": 1}, {"maximum": 3}]}, 2, 4),
        ({"anyOf": [{"type": "string"}, {"const": 1}]}, 1, True),
        ({"oneOf": [{"minimum": 1}, {"minimum": 3}]}, 2, 4),
        ({"not": {"type": "null"}}, 0, None),
        (INDEX, {"format": 3, "isUpdatable": True, "indexUrl": "x"}, {"format": 3, "isUpdatable": True}),
        ({"uniqueItems": True}, [1, True, "1"], [1, 1.0]),
        ({"maxLength": 2}, "ab", "abc"),
        ({"exclusiveMinimum": 0}, 1, 0),
        ({"format": "date-time"}, "2026-01-02T03:04:05Z", "yesterday"),
        ({"additionalProperties": {"type": "integer"}}, {"a": 1}, {"a": "1"}),
        ({"patternProperties": {"^x": {"type": "integer"}}, "additionalProperties": False}, {"x1": 1}, {"y": 1}),
        (BANK, [["a", 1]], [["a", -1]]),
    ],
)
def test_keywords(schema, good, bad):
    assert schema_issues(good, schema) == [] and schema_issues(bad, schema)


def test_unknown_keywords_are_errors():
    for schema in ({"unevaluatedProperties": False}, {"format": "colour"}, {"$ref": "other.json"}):
        with pytest.raises(ValueError):
            schema_issues("x", schema)


def test_archive(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, body in {"index.json": {"format": 2}, "term_bank_1.json": [["a", 1]], "term_bank_2.json": [["abcdef", -1, 0]], "tag_bank_1.json": 7}.items():
            z.writestr(name, json.dumps(body))
    found = archive_issues(str(tmp_path / "a.zip"), INDEX, BANK)
    assert found == {"index.json": ["/format: const"], "term_bank_1.json": [], "term_bank_2.json": ["/0/0: length", "/0/1: range", "/0/2: not allowed"]}
