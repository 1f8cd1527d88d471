import pytest
from granary.operators import coverage as C
from granary.operators import export, incremental, integrity, validate
from granary.operators import relational as R
from pyspark.sql import functions as F


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_headword_needs_every_article(spark):
    a = spark.createDataFrame([(1, "同じ", "おなじ"), (2, "同じ", "おなじ"), (3, "別", "べつ")], "art long, e string, r string")
    units = spark.createDataFrame([(1, "u1"), (2, "u2")], "art long, u string")
    run = lambda *ids: spark.createDataFrame([(i,) for i in ids], "art long")
    done = lambda *ids: spark.createDataFrame([(i,) for i in ids], "u string")
    progress = lambda r, d: tuple(C.headword_progress(a, r, units, d, ["e", "r"], "art", "u").first())
    assert progress(run(1), done("u1", "u2")) == (0, 2)
    assert progress(run(1, 2), done("u1", "u2")) == (1, 2)
    assert progress(run(1, 2), done("u1")) == (0, 2)


def test_strict_and_loose_coverage_differ(spark):
    m = spark.createDataFrame([("s", "a", 1), ("s", "a", 2), ("s", "b", 3), ("s", "b", 1)], "src string, term string, item long")
    terms = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c")], "src string, term string")
    run = spark.createDataFrame([(1,), (2,)], "item long")
    assert rows(C.strict_coverage(terms, m, run, "src", "term", "item")) == [("s", 3, 2, 1)]
    assert rows(C.loose_coverage(terms, m, run, "src", "term", "item")) == [("s", 3, 2)]


def test_priority_fallback_and_reconciliation(spark):
    c = spark.createDataFrame([(1, "猫", "ねこ"), (2, "有る", "ある"), (3, "ある", "x")], "item long, e string, r string")
    p = spark.createDataFrame([("猫",), ("ある",), ("不在",), ("猫",)], "t string")
    assert rows(R.prioritised(p, "t", c, "item", ["e", "r"])) == sorted([("猫", 1, "e"), ("ある", 2, "r"), ("ある", 3, "e")], key=str)
    right = spark.createDataFrame([("a", 1, "v1"), ("b", 2, "v2"), ("c", 2, "v3")], "k string, s long, v string")
    left = spark.createDataFrame([("a", 9), ("z", 1), ("z", 2), ("z", None)], "k string, s long")
    assert rows(R.exact_then_unique(left, right, ["k"], "s", "v").select("k", "s", "v")) == sorted([("a", 9, "v1"), ("z", 1, "v1"), ("z", 2, None), ("z", None, None)], key=str)
    x = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k long, f string")
    y = spark.createDataFrame([(1, "b"), (2, None), (4, "d")], "k long, f string")
    assert rows(R.reconciled(x, y, ["k"], ["f"])) == [(1, "different"), (2, "same"), (3, "missing"), (4, "extra")]


def test_inserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "z"), (3, "c"), (3, "c")], "k long, v string")
    assert rows(R.appended(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(R.upserted(old, new.distinct(), ["k"])) == [(1, "a"), (2, "z"), (3, "c")]


def test_pages_of_any_layout(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("k"))
    for d in (df, df.repartition(9)):
        got = {r.k: (r.page, r.place) for r in R.pages(d, 100, F.col("k")).collect()}
        assert got == {k: (k // 100 + 1, k % 100) for k in range(1000)}


def test_increment_and_canonical_values(spark):
    old = spark.createDataFrame([("u-r1-a", 1)], "unit string, art long")
    new = spark.createDataFrame([(1,), (2,)], "art long")
    out = incremental.extended_run(old, new, lambda d: d.select(F.concat(F.lit("u-r2-n"), F.col("art").cast("string")).alias("unit"), "art"), "art", "unit", "u-r1-", "u-r2-")
    assert rows(out) == [("u-r2-a", 1), ("u-r2-n2", 2)]
    with pytest.raises(Exception, match="another prefix"):
        incremental.extended_run(out, new, lambda d: d.select(F.lit("x").alias("unit"), "art"), "art", "unit", "u-r1-", "u-r3-").collect()
    v = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    one, two = spark.createDataFrame([(1, "x")], "k long, v string"), spark.createDataFrame([(1, "y"), (2, "b"), (3, "z")], "k long, v string")
    got = incremental.canonicalised(v, "k", "v", [("tag", one), ("file", two)])
    assert rows(got) == [(1, "a", "x", "tag"), (3, "c", "z", "file")]
    again = v.join(got.select("k", F.col("v").alias("n")), "k", "left").select("k", F.coalesce("n", "v").alias("v"))
    assert incremental.canonicalised(again, "k", "v", [("tag", one), ("file", two)]).count() == 0
    with pytest.raises(Exception, match="two values"):
        incremental.canonicalised(v, "k", "v", [("tag", one.union(two))]).collect()


def test_integrity(spark):
    a = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (None, 12)], "k long, p long")
    parent = spark.createDataFrame([(10,), (11,)], "p long")
    assert rows(integrity.unique(a, ["k"])) == [(2, 2)]
    assert rows(integrity.references(a, "p", parent, "p").select("p")) == [(12,)]
    assert integrity.satisfies(a, "k > 1").count() == 1
    with pytest.raises(integrity.ConstraintError, match="keys"):
        integrity.require({"keys": integrity.unique(a, ["k"])})
    same = integrity.identity_report(a, a.union(a), ["k", "p"]).first()
    assert tuple(same) == (0, 0, True)  # distinct rows are compared
    offs = spark.createDataFrame([("s", 0, 5), ("s", 5, 2), ("s", 8, 1)], "g string, start long, size long")
    assert rows(integrity.contiguous(offs, "g", "start", "size").select("start", "expected")) == [(8, 7)]
    rec = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("c", "4"), ("x", "9")], "k string, f string")
    exp = spark.createDataFrame([(k,) for k in "abcd"], "k string")
    done = spark.createDataFrame([("b", "2")], "k string, f string")
    assert rows(integrity.replay_plan(rec, exp, done, "k", "f")) == [("a", "pending"), ("b", "replayed"), ("c", "conflict"), ("d", "absent"), ("x", "unknown")]


def test_text_rules(spark):
    cases = {"": ["empty"], "чистый текст": [], "текст <b>x</b>": ["markup"], "a\x07б": ["control_character"], "only latin": ["no_script"], "cлово тут": ["mixed_alphabet"], "слово one two three": ["foreign_words"], "без": ["lost_token"]}
    for text, want in cases.items():
        token = F.array(F.lit("{x}")) if want == ["lost_token"] else F.array().cast("array<string>")
        assert spark.range(1).select(validate.plain_text_issues(F.lit(text), token)).first()[0] == want, text
    sets = spark.createDataFrame([(["a", "b"],), (["a", "a"],), ([],), (["", "x"],)], "v array<string>")
    assert [r[0] for r in sets.select(validate.set_issues(F.col("v"))).collect()] == [[], ["repeated"], ["size"], ["empty_item"]]
    usage = spark.createDataFrame([(10, 4, 5, 15), (10, 11, 5, 15), (1, 0, 1, 3)], "input_tokens long, cached_input_tokens long, output_tokens long, total_tokens long")
    assert validate.usage_issues(usage).count() == 2


def test_entries_and_redirects(spark):
    r = spark.createDataFrame([(1, "明日", "あした", 0.5), (2, "明日", "みょうにち", 1.0), (3, "あした", "あした", 1.0), (4, "明日", "明日", 0.0)], "ordinal long, expression string, reading string, score double")
    e = {x.expression: x for x in export.entries(r).collect()}
    assert e["明日"].readings == ["あした", "みょうにち"] and [v.score for v in e["明日"].variants] == [0.5, 1.0, 0.0]
    out = export.redirects(export.synonyms(export.entries(r)), export.entries(r))
    assert rows(out) == [("みょうにち", "redirect", ["明日"])]
    with pytest.raises(Exception, match="NUL"):
        export.entries(spark.createDataFrame([(1, "a\0", "r")], "ordinal long, expression string, reading string")).collect()
    assert rows(export.collisions(spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "s string, t string"), "s", "t")) == [("x", 2)]


def test_binary_records_and_archives(tmp_path):
    data = export.index_record("é", 1, 2) + export.index_record("b", 3, 4)
    assert export.parse_records(data, 2) == [("é", (1, 2)), ("b", (3, 4))]
    with pytest.raises(ValueError):
        export.parse_records(data[:-1], 2)
    assert export.parse_header("head\na=b=c\nx=y") == {"a": "b=c", "x": "y"}
    a, b = str(tmp_path / "a.zip"), str(tmp_path / "b.zip")
    export.archive(a, {"x/1": b"1", "0": b"2"})
    export.archive(b, {"0": b"2", "x/1": b"1"})
    assert open(a, "rb").read() == open(b, "rb").read()
    assert export.member_issues(a, {"0", "gone"}) == ["missing: gone"]
    for bad in ("../x", "/x", "a\\b", "a\x01", ""):
        with pytest.raises(ValueError):
            export.archive(a, {bad: b""})


def test_places_with_a_wide_payload_and_ranges_that_are_put_together_by_size(spark, tmp_path):
    """Every place from 0 to n - 1 once, though counting reads none of the payload that the rows have."""
    from pyspark.sql import functions as F

    spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("k"), *[F.concat(F.lit(f"{c}" * 60), F.sha2((F.col("id") * c).cast("string"), 256)).alias(f"t{c}") for c in range(4)]).write.parquet(f"{tmp_path}/wide")
    wide = spark.read.parquet(f"{tmp_path}/wide")
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        got = R.pages(wide, 100, F.col("k")).select("k", ((F.col("page") - 1) * 100 + F.col("place")).alias("at"), F.length("t3").alias("n"))
        got.write.parquet(f"{tmp_path}/paged")
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    rows = spark.read.parquet(f"{tmp_path}/paged").collect()
    assert sorted(r["at"] for r in rows) == list(range(20_000)) and all(r["at"] == r["k"] and r["n"] == 124 for r in rows)


def test_running_sums_within_a_column_that_may_be_null(spark):
    from pyspark.sql import functions as F

    rows = [(s, k, k % 5) for k in range(200) for s in ("a", "b", None)]
    df = spark.createDataFrame(rows, "shelf string, k int, size long")
    got = {(r.shelf, r.k): r.start for r in R.running(df, F.col("size"), "start", [F.col("k")], ["shelf"]).collect()}
    assert got == {(s, k): sum(x % 5 for x in range(k)) for s, k, _ in rows}
    assert R.numbered(df.limit(0), "n", F.col("k")).count() == 0


def test_rounded_indices(spark):
    from granary.functions.stats import rounded_indices

    groups = {1: [5.0, 1.0, 1.0, 9.0], 2: [3.0], 3: [float(x % 7) for x in range(50)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [(1, None)], "g int, v double")
    got = {r.g: (r.half, r.most) for r in rounded_indices(df, ["g"], "v", {"half": 0.5, "most": 0.95}).collect()}
    assert got == {g: (sorted(vs)[round((len(vs) - 1) * 0.5)], sorted(vs)[round((len(vs) - 1) * 0.95)]) for g, vs in groups.items()}


def test_candidates_are_counted_by_sets_of_nations(spark, tmp_path):
    """Suppliers of several nations, of none and without a key, as the SQL has them; a supplier is never paired with a customer."""
    import __spark_entry__
    import duckdb

    spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 9), (4, None), (None, 1), (5, 2)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = [(k, k % 3, 9500.0, "BUILDING") for k in range(10)] + [(4, 2, 9500.0, "BUILDING"), (20, 9, 9500.0, "BUILDING"), (21, 9, 10.0, "BUILDING")]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    db = duckdb.connect()
    for t in ("supplier", "customer"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = __spark_entry__.queries()["candidate_resolution"](spark, str(tmp_path))
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(got.collect()) == order(db.execute(__spark_entry__.oracle_sql()["candidate_resolution"]).fetchall())
