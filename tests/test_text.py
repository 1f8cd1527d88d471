import datetime

import pytest
from granary.functions import text as X
from granary.functions.digest import digest_of_rows, row_text, table_digest
from pyspark.sql import functions as F


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "x string").select(*columns).first())


def test_normal_forms_and_strip(spark):
    assert one(spark, "　か\u3099\t\n", X.nfc("x"), X.strip("x")) == ("が", "か\u3099")
    assert one(spark, None, X.nfc("x"), X.reading_variants("x")) == (None, None)
    assert one(spark, "カタ・ｶﾅ／カタ、 ひら", X.reading_variants("x"))[0] == ["かた", "かな", "ひら"]
    for v, want in (("ひらがな", True), ("カタカナー・", True), ("漢字", False), ("", False)):
        assert one(spark, v, X.kana_only("x"))[0] is want


def test_protected_tokens_and_taxa(spark):
    got = one(spark, "See https://a.b/c, {name} 日本語 3.14 NATO and Ctrl+C; NATO", X.protected_tokens("x"))[0]
    assert got[:3] == ["https://a.b/c,", "{name}", "日本語"] and {"3.14", "NATO", "Ctrl+C"} <= set(got) and got.count("NATO") == 1
    assert one(spark, "Canis lupus and C. aureus, The house, F. catus", X.taxa("x"))[0] == ["Canis lupus", "C. aureus"]


def test_alphabets(spark):
    assert one(spark, "слово cлово word", X.mixed_tokens("x"))[0] == ["cлово"]
    assert one(spark, "cлово", X.homoglyphs_repaired("x"))[0] == "слово"
    assert one(spark, "dлово", X.homoglyphs_repaired("x"))[0] is None


def test_escapes_names_links_and_paths(spark):
    assert one(spark, "<a href=\"x\">&'", X.escaped("x"))[0] == "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"
    with pytest.raises(Exception, match="XML forbids"):
        one(spark, "\x01", X.escaped("x"))
    assert one(spark, "--a b/c!", X.class_name("x"))[0] == "a-b-c"
    assert one(spark, "!!", X.class_name("x"))[0] is None
    assert one(spark, "?query=abc&wildcards=off", X.entry_href("x"), X.link_kind("x")) == ("entry://abc", "internal")
    for v, want in (("a/b.png", True), ("../a", False), ("/a", False), ("a\\b", False), ("a//b", False), ("", False), ("c:/x", False)):
        assert one(spark, v, X.safe_path("x"))[0] is want
    assert one(spark, "  a ", X.kept_space("x", F.lit(" b")))[0] == "  b "
    assert tuple(spark.range(1).select(X.rank_label(F.lit(5000)), X.rank_label(F.lit(5500)), X.entry_identity(F.lit("a"))).first()) == ("5k", "5500", "e-ca978112ca1bbdcafac231b3")
    assert spark.range(1).select(X.tag_text(F.array(F.lit("a b"), F.lit("c")))).first()[0] == "a\u00a0b c"
    assert spark.range(1).select(X.framed(F.lit("é"), F.lit(""))).first()[0] == "2:é0:"


def test_times(spark):
    t = datetime.datetime(2024, 1, 2, 3, 4, 5)
    df = spark.createDataFrame([(t,), (t.replace(microsecond=7),)], "t timestamp_ntz")
    assert [r[0] for r in df.select(X.utc_text("t")).collect()] == ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.000007Z"]


def test_table_digest(spark):
    df = spark.createDataFrame([("u-2", "b"), ("u-10", "a"), (None, "")], "a string, b string")
    texts = [r[0] for r in df.select(row_text(df)).collect()]
    want = digest_of_rows(texts)
    assert tuple(table_digest(df).first()) == want == tuple(table_digest(df.orderBy("b").repartition(5)).first())
    assert tuple(table_digest(df.union(df.limit(1))).first()) != want
    assert tuple(table_digest(df.limit(0)).first()) == digest_of_rows([])
    many = spark.range(5000).select(F.col("id").cast("string").alias("a"))
    assert tuple(table_digest(many).first()) == digest_of_rows([r[0] for r in many.select(row_text(many)).collect()])
