import random
import re

from granary.llm import toxicity as X


def corpus(n=900, seed=3):
    rng = random.Random(seed)
    syllables = [a + b for a in "bdfglmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        w = [word() for _ in range(rng.choice([15, 60, 300]))]
        toxic = rng.random() < 0.12
        if toxic:
            for _ in range(rng.randint(3, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(["Zorkish", "qwuxly!", "vexxor" + word(), "hhrunt,"]))
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_held_out_accuracy(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    # some toxic documents are confirmed, some clean ones too; nothing is known of the second half
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in docs[:450]], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in X.toxicity(df, labels).collect()}
    held = [(got[i], y) for i, _, y in docs[450:]]
    recall = sum(a for a, y in held if y) / sum(y for _, y in held)
    false = sum(a for a, y in held if not y) / sum(1 - y for _, y in held)
    assert recall >= 0.95 and false <= 0.01
    left = {r.doc_id for r in X.reject(df, labels).collect()}
    assert left == {i for i, y in got.items() if not y}


def test_table_with_nulls_repeats_and_clashing_columns(spark):
    docs = corpus(400)
    rows = [(i, t) for i, t, _ in docs] + [(None, docs[0][1]), (None, None), (1000, None), (1001, ""), (1002, "zorkish qwuxly vexxorba hhrunt"), (1003, "clean " * 100_000), (1002, "zorkish qwuxly vexxorba hhrunt")]
    df = spark.createDataFrame([(i, t, 1, 0.5, "h") for i, t in rows], "doc_id long, text string, toxic int, score double, h string")
    marks = [(i, y) for i, _, y in docs[:300]] + [(None, 1), (7, None), (1001, 0)] + [(i, y) for i, _, y in docs[:20]]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = X.toxicity(df, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.toxic for r in got if r.doc_id is not None and r.doc_id >= 1000}
    assert by == {1000: 0, 1001: 0, 1002: 1, 1003: 0}
    assert X.reject(df, labels).columns == df.columns
    # without labels, or without documents, everything is clean
    assert X.toxicity(df.limit(3), labels.limit(0)).where("toxic = 1").count() == 0
    assert X.toxicity(df.limit(0), labels).count() == 0


def test_nothing_is_toxic_where_nothing_tells_toxic_documents_apart(spark):
    docs = spark.createDataFrame([(i, "the same text") for i in range(4)], "doc_id long, text string")
    assert X.toxicity(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).where("toxic = 1").count() == 0
    assert X.toxicity(docs, spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, toxic int")).where("toxic = 1").count() == 0


def test_features_against_brute_force():
    """Words and their 4- and 5-letter parts, edges marked, are told apart as a set of strings tells them."""

    def strings(text):
        out = set()
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            marked = f"<{word}>"
            out.add(("w", word))
            out |= {(n, marked[i : i + n]) for n in (4, 5) for i in range(len(marked) - n + 1)}
        return out

    rng = random.Random(8)
    seen = {}
    for _ in range(60):
        text = "".join(rng.choice("abcdé 日𐐷ß_1.\n") for _ in range(rng.randrange(120)))
        for s in strings(text):
            seen.setdefault(s, X.features(s[1]).tolist() if s[0] == "w" else None)
        whole = X.features(text).tolist()
        assert whole == sorted(set(whole)) and len(whole) <= len(strings(text)) and len(whole) >= len(strings(text)) - 1
        assert whole == sorted({b for w in re.findall(r"[^\W\d_]+", text.lower()) for b in X.features(w).tolist()})
    assert X.features(None).tolist() == X.features("").tolist() == X.features("1 2 _").tolist() == []


def test_long_text_is_read_whole(monkeypatch):
    text = "some words of a longer text " * 300
    whole = X.features(text).tolist()
    monkeypatch.setattr(X, "PART", 50)
    assert X.features(text).tolist() == whole and X.features("x" * 5_000).tolist() == X.features("x" * 5_000).tolist()


def test_evidence_against_toxicity_is_learned():
    rng = random.Random(1)
    U = [X.features(" ".join(rng.choice(["calm", "gentle", "kind", "plain"]) for _ in range(5))) for _ in range(200)]
    P = [X.features("zorkish plain")] * 30
    (kept, w, _), _ = X.fit_folds(P, U + P[:5], 0.1)
    weight = dict(zip(kept.tolist(), w.tolist()))
    assert all(weight[b] > 0 for b in X.features("zorkish").tolist()) and min(weight[b] for b in X.features("gentle").tolist()) < 0


def test_sample_bounds_rows_and_many_chunks_agree(spark, monkeypatch):
    docs = corpus(900)
    repeated = [(docs[0][0], docs[0][1])] * 500
    df = spark.createDataFrame([(i, t) for i, t, _ in docs] + repeated, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in docs[:450]] + [(docs[0][0], 1)], "doc_id long, toxic int")
    asked = []
    monkeypatch.setattr(X, "choose_cut", lambda zp, zu, c, prior: asked.append((len(zp), c.sum())) or 0.0)
    X.fit(df, labels, sample=40)
    assert asked == [(40, 2 * (len(docs) + 500))]
    monkeypatch.undo()
    monkeypatch.setattr(X, "CHUNK", 256)
    plain = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    got = {r.doc_id: r.toxic for r in X.toxicity(plain, labels.where("doc_id != 0")).collect()}
    held = [(got[i], y) for i, _, y in docs[450:]]
    assert sum(a for a, y in held if y) / sum(y for _, y in held) >= 0.95 and sum(a for a, y in held if not y) <= 4


def test_step_climbs_out_of_a_negative_risk():
    """Where the unlabelled risk less the toxic share falls below zero, weights don't run away: the margin of toxic documents stays bounded."""
    import numpy as np

    P, U = [np.array([0])] * 40, [np.array([0])] * 4 + [np.array([], dtype=np.int64)] * 36
    w, b = X.fit_nnpu(P, U, 1, 0.3)
    assert 0 <= w[0] < 12 and w[0] + b > b


def test_cut_lies_where_unlabelled_documents_are_few():
    import numpy as np

    zp, zu = np.array([3.0, 2.5, 2.0, 1.9]), np.concatenate([np.full(90, -3.0), np.linspace(1.8, 3.2, 10)])
    assert -3 < X.choose_cut(zp, zu) <= 1.9


def test_cut_counts_each_margin_as_often_as_it_occurs():
    import numpy as np

    zp, zu = np.array([2.0, 2.5, 3.0]), np.array([-1.0, 2.0, 2.2, 3.0])
    n = np.array([50, 2, 1, 3])
    assert X.choose_cut(zp, zu, n) == X.choose_cut(zp, np.repeat(zu, n))


def test_packed_features():
    for text in ("", "one word or two " * 50):
        f = X.features(text)
        assert X.unpacked(X.packed(f)).tolist() == f.tolist()
