import itertools
import math
import random
from collections import Counter

import numpy as np
from granary.llm import near_dedup as N
from pyspark.sql import functions as F


def vocabulary(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def bigrams(text):
    """Shingles as strings, without the operator's hashes."""
    w = [x for x in ("".join(c for c in token.lower() if c.isalnum()) for token in (text or "").split()) if x]
    return Counter(zip(w, w[1:]) if len(w) > 1 else [tuple(w)] if w else [])


def similarity(a, b, idf):
    low = sum(min(a[s], b[s]) * idf(s) for s in a.keys() & b.keys())
    high = sum(max(a[s], b[s]) * idf(s) for s in a.keys() | b.keys())
    return low / high


def frequencies(made):
    df = Counter(s for m in made for s in m)
    return lambda s: math.log((len(made) + 1) / (max(df[s], 1, len(made) / N.RARE) + 1)) + N.FLOOR


def brute(rows):
    """Kept document by removed one, from all pairs; ids are unique and not null here."""
    docs = sorted((d, t) for d, t in rows if bigrams(t))
    made = [bigrams(t) for _, t in docs]
    idf = frequencies(made)
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        if made[i].keys() & made[j].keys() and similarity(made[i], made[j], idf) >= N.THRESHOLD:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {docs[i][0]: docs[find(i)][0] for i in range(len(docs)) if find(i) != i}


def planted():
    rng = random.Random(11)
    words = vocabulary(rng, 3000)
    base = [[rng.choice(words) for _ in range(rng.choice([5, 40, 120]))] for _ in range(80)]
    rows, d = [], 0
    for b in base:
        for _ in range(rng.choice([1, 1, 2, 5])):
            w = [rng.choice(words) if rng.random() < 0.04 else x for x in b] if len(b) > 10 else b
            rows.append((d, " ".join(w) + rng.choice(["", ".", "!"])))
            d += 1
    rows += [(d + k, " ".join([*base[0], "copy", str(k % 7)])) for k in range(150)]  # a large group
    return rows


def test_recall_and_precision_against_all_pairs(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.kept_doc_id for r in N.near_duplicates(df).collect()}
    want = brute(rows)
    assert len(want) > 150
    assert not set(got) - set(want)
    assert len(set(got) & set(want)) >= 0.9 * len(want)


def test_table_with_nulls_ties_repeats_and_clashing_columns(spark):
    long = " ".join(vocabulary(random.Random(1), 30_000))
    a = "some text about one thing that is told twice in this table"
    rows = [(1, a), (2, a.upper() + "!"), (None, a), (3, None), (3, None), (4, ""), (5, "?! ..."), (6, "?! ..."), (1, a), (7, long), (8, long + " end"), (9, "word"), (9, "other"), (10, "word")]
    df = spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], "doc_id long, text string, v int, bands string, __key long")
    got = sorted(((r.doc_id, r.kept_doc_id) for r in N.near_duplicates(df).collect()), key=str)
    assert got == sorted([(2, 1), (None, 1), (8, 7), (10, 9)], key=str)
    out = N.without_near_duplicates(df)
    assert out.columns == df.columns
    left = Counter((r.doc_id, (r.text or "")[:20]) for r in out.collect())
    assert left == Counter([(1, a[:20]), (3, ""), (3, ""), (4, ""), (5, "?! ..."), (6, "?! ..."), (7, long[:20]), (9, "word"), (9, "other")])
    assert N.without_near_duplicates(df.limit(0)).count() == 0


def test_samples_agree_as_often_as_weighted_jaccard_says():
    rng = np.random.default_rng(2)
    idf = N.Frequencies(10, np.zeros(0, np.uint32), np.zeros(0))
    for size, times in ((300, 60), (60_000, 4)):
        agree = want = 0
        for _ in range(times):
            s = np.unique(rng.integers(0, 1 << 32, size, dtype=np.uint32))
            ca, cb = rng.integers(1, 6, len(s)), rng.integers(1, 6, len(s))
            ca[0] = 200_000  # no count is clipped
            agree += (N.samples(s, ca.astype(float)) == N.samples(s, cb.astype(float))).mean()
            want += N.weighted_jaccard(N.unblob(N.blob(s, ca)), (s, cb), idf)
        assert abs(agree - want) / times < (0.02 if times > 9 else 0.08)


def test_words_and_shingles_against_strings():
    rng = random.Random(3)
    for _ in range(80):
        text = "".join(rng.choice("abAB é日𐐷ß1_.\u00a0\n\t'") for _ in range(rng.randrange(80)))
        s, c = N.shingles(text)
        want = bigrams(text)
        assert len(s) == len(want) and sorted(c.tolist()) == sorted(want.values())
        again = N.shingles(" ".join(w for w in ("".join(x for x in t.lower() if x.isalnum()) for t in text.split()) if w))
        assert again[0].tolist() == s.tolist() and again[1].tolist() == c.tolist()


def test_frequencies_are_exact_whatever_the_layout(spark, monkeypatch):
    monkeypatch.setattr(N, "RARE", 8)
    monkeypatch.setattr(N, "TOGETHER", 16)
    rng = random.Random(4)
    texts = [" ".join(rng.choice("a b c d e f g h i j k l m n o p".split()[: rng.choice([3, 16])]) for _ in range(rng.choice([2, 5, 30]))) for _ in range(300)] + [None, "", "?"]
    made = [bigrams(t) for t in texts if bigrams(t)]
    want = frequencies(made)
    for parts in (1, 7):
        got = N.inverse_frequencies(spark.createDataFrame([(t,) for t in texts], "t string").repartition(parts))
        for s in {s for m in made for s in m} | {("never", "seen")}:
            assert abs(float(got(N.shingles(" ".join(s))[0])[0]) - want(s)) < 1e-9


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)] + [(500, 501 + k) for k in range(30)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.v: r.label for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent}


def short_texts(n=70):
    """Texts of three to five words that begin alike: many meet, few are alike."""
    rng = random.Random(6)
    words = vocabulary(rng, 60)
    return [(i, " ".join(["begin", "here", *(rng.choice(words) for _ in range(rng.randint(1, 3)))])) for i in range(n)]


def test_texts_that_meet_and_differ_are_not_measured_in_pairs(monkeypatch):
    texts = sorted({t for _, t in short_texts()})
    made, told = [N.shingles(t) for t in texts], [bigrams(t) for t in texts]
    idf, plain = N.Frequencies(len(texts), np.zeros(0, np.uint32), np.zeros(0)), lambda s: 1.0
    every, calls, real = np.arange(len(texts)), [], N.weighted_jaccard
    monkeypatch.setattr(N, "weighted_jaccard", lambda *x: calls.append(1) or real(*x))

    def joined(links):
        label = list(range(len(texts)))
        for a, b in links:
            label = [label[a] if x == label[b] else x for x in label]
        return {frozenset(i for i, x in enumerate(label) if x == y) for y in label}

    want = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if similarity(told[a], told[b], plain) >= N.THRESHOLD]
    got = N.similar(made, every, every, every, idf, N.THRESHOLD)
    assert set(map(lambda x: tuple(sorted(x)), got)) <= set(want) and joined(got) == joined(want) and len(joined(want)) > 10
    assert len(calls) < len(texts) < len(texts) ** 2 / 20


def test_buckets_in_blocks_give_what_whole_buckets_give(spark, monkeypatch):
    rows = short_texts(150)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = []
    for size in (N.BUCKET, 3):
        monkeypatch.setattr(N, "BUCKET", size)
        found.append({r.doc_id: r.kept_doc_id for r in N.near_duplicates(df).collect()})
    want = brute(rows)
    assert found[0] == found[1] and len(want) > 10
    assert not set(found[0]) - set(want) and len(found[0]) >= 0.9 * len(want)


def test_texts_read_together_have_the_shingles_of_texts_read_alone(monkeypatch):
    rng = random.Random(12)
    texts = ["".join(rng.choice("aB1 \n\t.\x00ΣİΑ日𐐷́") for _ in range(rng.randrange(60))) for _ in range(200)] + [None, "", "word", "?", "ΑΣ", "Σ"]
    for characters in (1, 300, N.CHARACTERS):
        monkeypatch.setattr(N, "CHARACTERS", characters)
        got = list(N.shingles_of(texts))
        assert len(got) == len(texts)
        for t, (s, c) in zip(texts, got):
            want = bigrams(t)
            assert len(s) == len(want) and sorted(c.tolist()) == sorted(want.values())
            alone = N.shingles(t)
            assert alone[0].tolist() == s.tolist() and alone[1].tolist() == c.tolist()
            again = N.unblob(N.blob(s, c))
            assert again[0].tolist() == s.tolist() and again[1].tolist() == c.tolist()


def test_few_shingles_are_looked_at_and_none_is_missed(monkeypatch):
    rng = np.random.default_rng(5)
    sizes = [1, 2, 5_000, 300, 1, *rng.integers(1, 600, 60).tolist()]
    texts = [np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint32)) for n in sizes]
    s, start = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    w = rng.lognormal(1, 1.5, len(s))
    looked, real = [], N.chances
    monkeypatch.setattr(N, "chances", lambda s, *x: looked.append(len(s)) or real(s, *x))
    got = N.samples_of(s, w, start)
    assert sum(looked) < 0.25 * len(s) * N.BANDS * N.ROWS

    def each(i, j):
        """Each draw from all shingles, without any bound."""
        first, found = N.firsts(s[i:j], N.draws()[3]), []
        for k in range(N.BANDS * N.ROWS):
            t, a = real(s[i:j], np.log(w[i:j]).astype(np.float32), np.full(j - i, k), first[:, k])
            at = a.argmin()
            found.append(int(N._mix(np.array([(int(s[i + at]) * N._ODD + int(t[at])) % (1 << 64)], dtype=np.uint64))[0]))
        return found

    for n, (i, j) in enumerate(itertools.pairwise(start.tolist())):
        assert got[n].tolist() == each(i, j) == N.samples(s[i:j], w[i:j]).tolist()


def test_a_text_is_read_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def read(t):
        reads.add(1)
        return t

    rows = [(i, f"a text of some words that number {i % 4} tells once more") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumn("text", F.udf(read, "string").asNondeterministic()("text"))
    assert N.near_duplicates(df).count() >= 8
    assert reads.value == len(rows)


def test_components_forget_estimated_sizes(spark):
    """Estimates that rounds of joins multiply by one another filled the driver's memory at 6 GB."""
    path = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    labels = N.components(path)
    again = N.components(path.join(labels, F.col("a") == F.col("v")).select("label", "b").withColumnRenamed("label", "a"))
    assert {r["label"] for r in again.collect()} == {0} and again.count() == 41
    assert again._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 64
