import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from granary.llm import mixing as M
from pyspark.sql import functions as F


def number(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def permuted(x, n, key):
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for k in range(4):
            if k % 2 == 0:
                left = (left + number(key, k, right)) % a
            else:
                right = (right + number(key, k, left)) % b
        x = left * b + right
        if x < n:
            return x


def test_permutation(spark):
    sizes = [1, 2, 3, 7, 40, 99, 1000]
    df = spark.createDataFrame([(i, n) for n in sizes for i in range(n)], "x long, n long")
    got = defaultdict(dict)
    for r in df.select("n", "x", M.permuted(F.col("x"), F.col("n"), F.lit("key")).alias("y")).collect():
        got[r.n][r.x] = r.y
    for n in sizes:
        assert got[n] == {i: permuted(i, n, "key") for i in range(n)} and sorted(got[n].values()) == list(range(n))


def documents(spark, n=200):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([1, 30, 200]))), "en", rng.choice(["hot", "hot", "hot", "b", "c", None])) for i in range(n)]
    rows += [(None, "no id here", None, "b"), (900, None, "en", "b"), (901, "", "en", "b"), (902, " two  spaces ", "en", "c"), (903, "long " * 50_000, "de", "c"), (904, "日本語" * 2_000, "ja", "b"), rows[0], rows[0]]
    return rows, spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, lang string, source string, block int, s string, slot int")


def tokens(text):
    return re.findall(" ?[^ ]{1,8}| ", text) + [M.END]


def brute_blocks(rows, size):
    line = defaultdict(list)
    for _, d, g, s, text in sorted((hashlib.md5(f"{M.SEED}\x1f{'' if d is None else d}\x1f{t}".encode()).hexdigest(), d, g, s, t) for d, t, g, s in rows if t):
        line[s or M.NULL_SOURCE] += [(t, d, g) for t in tokens(text)]
    return {(s, k // size): ("".join(t for t, _, _ in ts[k : k + size]), len(ts[k : k + size]), *ts[k][1:]) for s, ts in line.items() for k in range(0, len(ts), size)}


def brute_plan(totals, shard_slots):
    w = {s: math.floor(n**M.ALPHA * M.UNIT) for s, n in totals.items()}
    order = sorted(w, key=lambda s: (hashlib.md5(s.encode()).hexdigest()[:2], s))
    used, plan, high = Counter(), {}, sum(w.values())
    for g in range(sum(totals.values())):
        u = number(M.SEED, "slot", g) % high
        for s in order:
            if u < w[s]:
                break
            u -= w[s]
        epoch, j = divmod(used[s], totals[s])
        used[s] += 1
        plan[divmod(g, shard_slots)] = (s, permuted(j, totals[s], f"{M.SEED}:{s}:{epoch}"))
    return plan


def test_blocks_and_mixture_against_brute_force(spark):
    rows, df = documents(spark)
    size = 64
    want = brute_blocks(rows, size)
    sizes = M.counted(df)
    got = {(b.source, b.block): (b.text, b.n_tokens, b.doc_id, b.lang) for b in M.blocks(df, sizes, block_tokens=size).collect()}
    assert got == want
    totals = {r.source: r.blocks for r in M.source_totals(sizes, size).collect()}
    assert totals == Counter(s for s, _ in want)
    mixed = M.mix(df, block_tokens=size, shard_slots=50).collect()
    plan = {(r.shard, r.slot): (r.source if r.source is not None else M.NULL_SOURCE, r.block) for r in mixed}
    assert len(plan) == len(mixed) and plan == brute_plan(totals, 50)
    assert all((r.text, r.n_tokens, r.doc_id, r.lang) == want[r.source if r.source is not None else M.NULL_SOURCE, r.block] for r in mixed)


def test_shares_follow_the_weights_and_rounds_repeat_nothing(spark):
    totals = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 50)], "source string, blocks long")
    got = M.slots(spark, totals, {"a": 3.0, "b": 1.0}, shard_slots=64, n_slots=4000).collect()
    n = Counter(r.source for r in got)
    assert len(got) == 4000 and set(n) == {"a", "b"} and abs(n["a"] / 4000 - 0.75) < 0.03
    seen = Counter(r.block for r in got if r.source == "a")
    assert set(seen) == set(range(100)) and max(seen.values()) - min(seen.values()) <= 1
    # counts of a shard scatter as a multinomial's do
    by = Counter(r.shard for r in got if r.source == "a")
    spread = sum((by[k] - 48) ** 2 for k in range(62)) / 62
    assert 6 < spread < 20
    with pytest.raises(ValueError):
        M.slots(spark, totals, {"z": 1.0})


def test_same_result_for_any_layout_and_empty_table(spark):
    _, df = documents(spark, 60)
    a, b = (Counter(map(tuple, M.mix(x, block_tokens=32).select("shard", "slot", "source", "block", "text").collect())) for x in (df, df.repartition(7)))
    assert a == b
    assert M.mix(df.limit(0)).count() == 0
