import pytest
from granary.operators import packing as P
from granary.operators import sampling as S


def naive(items, max_items, max_bytes, max_units, alone_from, empty):
    """Measures the whole manifest again before each addition."""
    out, pack = [], []
    for k, (b, u) in enumerate(items):
        if b >= alone_from:
            out += [pack] if pack else []
            out.append([k])
            pack = []
            continue
        new = [*pack, k]
        size = P.manifest_bytes([items[i][0] for i in new], empty)
        if pack and (len(new) > max_items or size > max_bytes or sum(items[i][1] for i in new) > max_units):
            out.append(pack)
            pack = [k]
        else:
            pack = new
    return out + ([pack] if pack else [])


LIMITS = {"max_items": 5, "max_bytes": 4500, "max_units": 18, "alone_from": 900, "empty": 60}


def envelopes(n=249):
    return [(len("definition ") * (i % 11 + 1) * (i % 7 + 1) + 80, i % 7 + 1) for i in range(n)]


def test_parity_with_naive_packing():
    e = envelopes()
    assert list(P.packs(e, hard_bytes=10**6, hard_units=10**3, **LIMITS)) == naive(e, **LIMITS)


def test_hard_limits():
    with pytest.raises(P.TooLarge):
        list(P.packs([(10, 1), (5000, 1)], hard_bytes=4000, hard_units=9, **LIMITS))
    with pytest.raises(P.TooLarge):
        list(P.packs([(10, 99)], hard_bytes=4000, hard_units=9, **LIMITS))


def test_packing_of_runs_in_any_layout(spark):
    e = envelopes(120)
    df = spark.createDataFrame([(r, i, b, u) for r in (1, 2) for i, (b, u) in enumerate(e)], "run int, id long, size long, units long")
    limits = LIMITS | {"hard_bytes": 10**6, "hard_units": 10**3}
    a, b = (sorted(map(tuple, P.pack(x, "run", ["id"], "id", "size", "units", **limits).collect())) for x in (df, df.repartition(7)))
    assert a == b
    want = [(r, i, n, k) for r in (1, 2) for n, p in enumerate(naive(e, **LIMITS)) for k, i in enumerate(p)]
    assert a == sorted(want)


def test_chunk_boundary(spark):
    sizes = [P.row_bytes(["x" * n]) for n in (5, 7, 9, 11, 13)]
    most = len(b"[]") + sizes[0] + 1 + sizes[1]
    got = list(P.chunks(sizes, most))
    assert got[0] == [0, 1] and [i for c in got for i in c] == list(range(5))
    assert all(2 + sum(sizes[i] for i in c) + len(c) - 1 <= most or len(c) == 1 for c in got)
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate(sizes)], "g string, i long, s long")
    assert [r.chunk for r in sorted(P.chunk(df, "g", ["i"], "i", "s", most).collect())] == [n for n, c in enumerate(got, 1) for _ in c]


def test_halves():
    assert P.halves([[1], [2], [3]]) == [[[1]], [[2], [3]]]
    assert P.halves([[1, 2, 3]]) == [[[1]], [[2, 3]]]
    assert P.halves([[1]]) is None and P.halves([]) is None


def test_pilot_meets_floors_or_fails(spark):
    m = [S.Metric(i, 100 * i, 10, {"a": i, "b": 6 - i}, frozenset({f"f{i % 2}"})) for i in range(1, 6)]
    df = spark.createDataFrame([(x.article, x.size, x.units, sorted(x.features)) for x in m], "article long, size long, units long, features array<string>")
    ids = {r.article for r in S.mandatory(df).collect()}
    assert {1, 3, 5} <= ids
    chosen = S.select(m, ids, 40, {"a": 9, "b": 9})
    assert sum(x.units for x in m if x.article in chosen) >= 40 and ids <= chosen
    with pytest.raises(S.Unreachable):
        S.select(m, ids, 40, {"a": 99})
