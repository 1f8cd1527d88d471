import json

import pytest
from granary.operators import export, review, scope
from granary.sources import sinks
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_combined_scope(spark):
    articles = spark.createDataFrame([(1, "猫", "ねこ"), (2, "有る", "ある"), (3, "犬", "いぬ"), (4, "ガ", "")], "article long, expression string, reading string")
    a = spark.createDataFrame([("猫", 1), ("ある", 2), ("不在", 3), ("猫", 4), ("遠", 9)], "term string, rank int")
    b = spark.createDataFrame([("ガ", 1), ("犬", 3), ("鳥", 3)], "term string, rank int")
    s = scope.combined({"a": scope.ranked_terms(a, "term", "rank", 4), "b": scope.ranked_terms(b, "term", "rank", 3)}, articles)
    assert {(r.source, r.term, r.article, r.match_kind) for r in s["links"].collect()} == {("a", "猫", 1, "expression"), ("a", "ある", 2, "reading"), ("b", "ガ", 4, "expression"), ("b", "犬", 3, "expression")}
    assert rows(scope.report(s["terms"])) == sorted([("a", 3, 2, 1), ("b", 3, 2, 1), ("union", 6, 4, 2)], key=str)
    h = scope.selection_hash([(s["terms"], ["source", "term", "rank"]), (s["selected"], ["article"])])
    assert h == scope.selection_hash([(s["terms"].repartition(5), ["source", "term", "rank"]), (s["selected"], ["article"])])
    assert h != scope.selection_hash([(s["terms"].where("rank > 1"), ["source", "term", "rank"]), (s["selected"], ["article"])])


def test_candidates(spark):
    notes = spark.createDataFrame([(1, "ください", "ください"), (2, "下る", "くだる"), (3, "無", "む")], "note long, word string, reading string")
    articles = spark.createDataFrame([(1, "下さい", "ください", 10), (2, "下る", "くだる", 20), (3, "下る", "さがる", 21)], "article long, expression string, reading string, sequence long")
    c = scope.candidates(notes, articles)
    assert rows(c) == [(1, 1, 10, "reading"), (2, 2, 20, "expression")]
    d = scope.resolved(notes, c)
    assert rows(d) == [(1, "included", 10), (2, "included", 20), (3, "unresolved", None)]
    assert rows(scope.unresolved_report(d, c)) == [(3, None)]


def test_reviews_and_tags(spark):
    t = spark.createDataFrame([(1, "u", 0, "w1", "old", "2024-01-01"), (2, "u", 1, "w1", "new", "2024-01-02"), (3, "v", 0, "w2", "x", "2024-01-01")], "id long, unit string, accepted int, worker string, target string, created_at string")
    assert {r.unit: r.id for r in review.accepted(t).collect()} == {"u": 2, "v": 3}
    r = spark.createDataFrame([("u", "w1", "approve", None), ("v", "w1", "replace", "x"), ("z", "w1", "approve", None), ("v", "w3", "replace", " "), ("v", "w4", "maybe", None), ("u", "w5", "approve", None)], "unit string, reviewer string, decision string, replacement string")
    assert rows(review.review_issues(r, t)) == sorted([("u", "w1", "own_translation"), ("v", "w1", "same_target"), ("z", "w1", "unknown_unit"), ("v", "w3", "no_replacement"), ("v", "w4", "unknown_decision")], key=str)
    rulings = spark.createDataFrame([("v", "reject", None)], "unit string, decision string, replacement string")
    assert rows(review.adjudicated(r, rulings)) == [("u", "approve", None), ("v", "reject", None), ("z", "approve", None)]
    tags = spark.createDataFrame([("a", "c", "x"), ("b", "c", "x"), ("d", "c", ""), ("e", "c", "y" * 17), ("f", "c", "かな")], "code string, category string, label string")
    assert rows(review.tag_issues(tags)) == sorted([("a", "shared_label"), ("b", "shared_label"), ("d", "empty"), ("e", "too_long"), ("f", "kana")], key=str)
    refs = spark.createDataFrame([(1, "b a"), (2, "")], "row long, codes string")
    m = spark.createDataFrame([("a", "x y"), ("b", "z")], "code string, label string")
    assert rows(review.localised_references(refs, tags, m).select("row", "labels")) == [(1, "z x y"), (2, "")]
    with pytest.raises(Exception, match="no label"):
        review.localised_references(refs, tags, m.where("code = 'a'")).collect()
    c = review.cost(spark.createDataFrame([(1_000_000, 200_000, 500_000)], "input_tokens long, cached_input_tokens long, output_tokens long"), "1.25", "0.125", "10", "0.5").first().cost
    assert float(c) == (0.8 * 1.25 + 0.2 * 0.125 + 0.5 * 10) * 0.5
    env = review.envelopes(spark.createDataFrame([(1, "t")], "article long, term string"), spark.createDataFrame([(1, 1, "u2", "r", "b", "d"), (1, 0, "u1", "r", "a", "d")], "article long, ordinal int, unit string, role string, text string, digest string"), spark.createDataFrame([(1, "k", "v"), (1, "k", "v")], "article long, kind string, value string")).first()
    assert [u.unit for u in env.units] == ["u1", "u2"] and len(env.evidence) == 1


def test_files(spark, tmp_path, monkeypatch):
    (tmp_path / "c.toml").write_text('a = 1\nb = "x"\n')
    monkeypatch.setenv("GRANARY_B", "y")
    assert sinks.config(str(tmp_path / "c.toml")) == {"a": 1, "b": "y"}
    sinks.atomic_write(str(tmp_path / "x.bin"), b"abc")
    digest = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert sinks.pinned(spark, str(tmp_path / "x.bin"), {"x.bin": digest}).count() == 0
    assert sinks.pinned(spark, str(tmp_path / "x.bin"), {"x.bin": "0", "gone": "1"}).count() == 2
    df = spark.createDataFrame([(k, json.dumps(["x" * n])) for k, n in enumerate((5, 7, 9, 11, 13))], "k long, body string")
    chunks = sinks.chunked_json(df, "body", ["k"], 2 + 9 + 1 + 11)
    assert [json.loads(r.body) for r in chunks.orderBy("chunk").collect()][0] == [["x" * 5], ["x" * 7]]
    a, b = (sinks.write_archive(str(tmp_path / n), {"term_bank": chunks}, {"index.json": b"{}"}) for n in ("a.zip", "b.zip"))
    assert a == b and export.member_issues(str(tmp_path / "a.zip"), {"index.json", "term_bank_1.json"}) == []
    e = spark.createDataFrame([("b", "<b>2</b>", ["x"]), ("A", "é", ["b", "y"]), ("あ", "3", [])], "expression string, markup string, readings array<string>")
    got = sinks.write_index_bundle(str(tmp_path / "sd"), e, export.synonyms(e), "t")
    assert got == {"words": 3, "synonyms": 3} and sinks.verify_index_bundle(str(tmp_path / "sd")) == []
    with open(tmp_path / "sd" / "dict.dict", "ab") as f:
        f.write(b"!")
    assert sinks.verify_index_bundle(str(tmp_path / "sd")) == ["body size"]
    sinks.write_ordered_text(sinks.xdxf_articles(e), str(tmp_path / "x.xdxf"), "<xdxf>\n", "</xdxf>\n")
    assert (tmp_path / "x.xdxf").read_text().splitlines()[1] == "<ar><k>A</k>é</ar>"
    x = sinks.xml_entries(e.withColumn("identity", F.lit("e-1"))).where("key = 'A'").first().value
    assert x == '<d:entry id="e-1"><d:index d:value="A"/><d:index d:value="b"/><d:index d:value="y"/>é</d:entry>'
    p = sinks.page_files(spark.range(250).select(F.col("id").alias("k")), ["k"], ["k"])
    assert {r.page: r.body.count("<tr>") for r in p.collect()} == {1: 100, 2: 100, 3: 50}
    with pytest.raises(ValueError):
        sinks.update_index({"title": "t"})
    assert "| a |" in sinks.markdown_report("r", [{"a": "x|y"}]) and "\\|" in sinks.markdown_report("r", [{"a": "x|y"}])
    sinks.append(spark.range(3).toDF("k"), str(tmp_path / "t"))
    sinks.append(spark.range(3).toDF("k"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 6
    sinks.write_manifests(spark.createDataFrame([("b-1", "{}")], "batch string, manifest string"), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first().batch == "b-1"
    assert sinks.file_manifest(spark, str(tmp_path / "sd")).count() == 4
    sinks.copy_tables({"t": spark.range(2)}, str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy/t")).count() == 2


def test_the_driver_gets_an_archive_compressed(spark, tmp_path, monkeypatch):
    """The bytes are those of an archive whose members are compressed one by one; no member comes to the driver as it is."""
    from granary.operators import export
    from pyspark.sql import DataFrame

    bodies = {f"term_bank_{k}.json": '["' + f"{k}é" * 2_000 + '"]' for k in range(1, 13)}
    df = spark.createDataFrame([(int(n[10:-5]), b) for n, b in bodies.items()], "chunk long, body string").repartition(3)
    got = []
    for cls in {DataFrame, type(df)}:
        monkeypatch.setattr(cls, "toLocalIterator", lambda self, *a, __f=cls.toLocalIterator, **k: (got.append(r) or r for r in __f(self, *a, **k)))
    sinks.write_archive(str(tmp_path / "a.zip"), {"term_bank": df}, {"index.json": b"{}", "z.json": b"[]"})
    export.archive(str(tmp_path / "b.zip"), {"index.json": b"{}", "z.json": b"[]"} | {n: b.encode() for n, b in bodies.items()})
    assert (tmp_path / "a.zip").read_bytes() == (tmp_path / "b.zip").read_bytes()
    assert len(got) == 12 and "body" not in got[0].asDict() and sum(len(r["data"]) for r in got) < 12 * 200
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip") as z, zipfile.ZipFile(tmp_path / "c.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=9) as old:
        assert z.testzip() is None
        for name in z.namelist():
            info = zipfile.ZipInfo(name, export.EPOCH)
            info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
            old.writestr(info, z.read(name))
    assert (tmp_path / "a.zip").read_bytes() == (tmp_path / "c.zip").read_bytes()
