import json
import sqlite3
import zipfile

import pytest
from granary.sources import archives as A
from pyspark.sql import functions as F


def put(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for name, rows in members.items():
            z.writestr(name + ".json", json.dumps(rows, ensure_ascii=False))


def test_banks(spark, tmp_path):
    put(
        tmp_path / "d.zip",
        term_bank_10=[["犬", "いぬ", "", "", 1, ["dog"], 3, ""]],
        term_bank_2=[["猫", "ねこ", None, "", 0, ["cat"], 2, ""], ["短", "x"], ["無", "", "", "", 0, [], "no", ""]],
        tag_bank_1=[["n", "pos", 1, "noun", 0]],
        other=[1],
    )
    rows = A.read_terms(spark, str(tmp_path / "d.zip")).orderBy("bank", "ordinal").collect()
    assert [(r.bank, r.expression, r.sequence, r.glossary) for r in rows] == [(2, "猫", 2, '["cat"]'), (10, "犬", 3, '["dog"]')]
    assert len(rows[0].source_sha256) == 64
    assert A.read_tags(spark, str(tmp_path / "d.zip")).first().description == "noun"


def test_ranks(spark, tmp_path):
    put(tmp_path / "f.zip", term_meta_bank_1=[["a", "freq", 1], ["b", "freq", {"value": 3}], ["c", "freq", {"frequency": 3}], ["d", "freq", 4], ["e", "freq", True], ["a", "freq", 2], ["x", "pitch", 1]])
    recorded = {(r.term, r["rank"]) for r in A.read_ranks(spark, str(tmp_path / "f.zip"), 3, True).collect()}
    assert recorded == {("a", 1), ("b", 3), ("c", 3)}
    placed = {(r.term, r["rank"]) for r in A.read_ranks(spark, str(tmp_path / "f.zip"), 4, False).collect()}
    assert {t for t, _ in placed} == {"a", "b", "c", "d"}
    assert A.rank_of({"value": 2.0}) == 2 and A.rank_of(False) is None and A.rank_of("1") is None


def test_notes(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "c.db")
    db.execute("CREATE TABLE col (models TEXT)")
    db.execute("CREATE TABLE notes (id INTEGER, mid INTEGER, flds TEXT)")
    db.execute("INSERT INTO col VALUES (?)", [json.dumps({"7": {"flds": [{"name": "Word"}, {"name": "Meaning"}]}})])
    db.executemany("INSERT INTO notes VALUES (?, 7, ?)", [(1, "猫\x1f cat "), (2, "犬"), (3, "\x1fx")])
    db.commit()
    db.close()
    with zipfile.ZipFile(tmp_path / "n.apkg", "w") as z:
        z.write(tmp_path / "c.db", "collection.anki2")
    rows = A.read_notes(spark, str(tmp_path / "n.apkg"), ["Word"]).orderBy("note_id").collect()
    assert [(r.note_id, r.fields["Word"], r.fields["Meaning"]) for r in rows] == [(1, "猫", "cat"), (2, "犬", "")]
    s = spark.range(1).select(A.split_fields(F.lit("a\x1fb"), ["x", "y", "z"]).alias("s")).first().s
    assert tuple(s) == ("a", "b", "")


def test_strict_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,y\n")
    schema = "k int, v string"
    from pyspark.sql.types import _parse_datatype_string

    st = _parse_datatype_string(schema)
    assert A.read_strict_csv(spark, str(tmp_path / "a.csv"), st, 2).count() == 2
    with pytest.raises(ValueError):
        A.read_strict_csv(spark, str(tmp_path / "a.csv"), st, 3)
    (tmp_path / "b.csv").write_text("v,k\n")
    with pytest.raises(ValueError):
        A.read_strict_csv(spark, str(tmp_path / "b.csv"), st)
    (tmp_path / "a.jsonl").write_text('{"k": 1, "v": "x"}\n{"k": 2, "v": null}\n')
    assert A.read_strict_jsonl(spark, str(tmp_path / "a.jsonl"), st).count() == 2
    for bad in ('{"k": 1}\n\n{"k": 2}\n', '{"k": \n'):
        (tmp_path / "b.jsonl").write_text(bad)
        with pytest.raises(Exception):
            A.read_strict_jsonl(spark, str(tmp_path / "b.jsonl"), st).collect()


def test_responses_and_logs(spark):
    ok = {"output": [{"content": [{"type": "reasoning", "text": "-"}]}, {"content": [{"type": "output_text", "text": "yes"}]}]}
    df = spark.createDataFrame([(json.dumps(ok),)], "b string")
    assert A.responses(df, "b").first().text == "yes"
    with pytest.raises(Exception, match="not one output"):
        A.responses(spark.createDataFrame([('{"output": []}',)], "b string"), "b").collect()
    lines = ["noise", '{"type": "thread.started", "thread_id": "t1"}', '{"type": "turn.completed", "usage": {"input_tokens": 3, "output_tokens": 1}}', '{"type": "turn.completed", "usage": {"input_tokens": 9, "output_tokens": 2}}']
    log = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    assert tuple(A.process_log(log, "line", "n").first()) == ("t1", 9, 2)
