import hashlib
import random

import numpy as np
import zstandard
from granary.llm import media


def test_hash_equals_byte_by_byte():
    data = np.frombuffer(random.Random(1).randbytes(500), np.uint8)
    h, want = 0, []
    for b in data.tolist():
        h = (2 * h + int(media._GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert media.gear(data)[31:].tolist() == want[31:]


def test_chunks_join_to_the_payload_and_survive_an_insertion(monkeypatch):
    p = random.Random(2).randbytes(200_000)
    a = media.chunk_payload(p)
    assert b"".join(a) == p and all(media.LEAST <= len(c) <= media.MOST for c in a[:-1])
    b = media.chunk_payload(p[:1000] + b"inserted" + p[1000:])
    assert len(set(a) - set(b)) <= 4
    assert media.chunk_payload(b"") == [] and media.chunk_payload(b"x") == [b"x"]
    assert b"".join(media.chunk_payload(b"\0" * 100_000)) == b"\0" * 100_000
    monkeypatch.setattr(media, "PART", 5000)
    assert media.chunk_payload(p) == a


def test_table_is_rebuilt_from_stored_chunks(spark):
    rng = random.Random(3)
    shared = rng.randbytes(30_000)
    rows = [(1, shared), (2, b"head" + shared), (3, shared[:15_000] + rng.randbytes(4000)), (None, shared), (4, None), (4, None), (5, b""), (1, shared), (6, b"tiny"), (7, "ñandú".encode()), (8, b"\0" * 300_000), (8, b"other")]
    df = spark.createDataFrame([(i, None if p is None else bytearray(p), "x", 1) for i, p in rows], "page_id long, html binary, digest string, k int")
    got = media.media_chunks(df).collect()
    want = {(i, p) for i, p in rows}
    assert len(got) == len(want)
    store = {}
    for r in got:
        for c in r.chunks or ():
            if c.payload is not None:
                assert c.digest not in store
                store[c.digest] = zstandard.ZstdDecompressor().decompress(bytes(c.payload))
    assert all(hashlib.sha256(v).hexdigest() == k for k, v in store.items())
    rebuilt = {(r.page_id, None if r.chunks is None else b"".join(store[c.digest] for c in r.chunks)) for r in got}
    assert rebuilt == want
    assert all(r.verified for r in got if r.chunks is not None)
    assert all(r.verified is None and r.n_bytes is None for r in got if r.chunks is None)
    assert sum(map(len, store.values())) < sum(len(p or b"") for _, p in want) / 2
    assert media.media_chunks(df.limit(0)).count() == 0


def sequential(p):
    """Chunk ends, byte by byte."""
    h, last, out = 0, 0, []
    for n, b in enumerate(p, 1):
        h = (2 * h + int(media._GEAR[b])) & 0xFFFFFFFF
        if n < len(p) and (n - last == media.MOST or n - last >= media.LEAST and h >> (32 - media.MASK_BITS) == 0):
            out.append(n)
            last = n
    return out + [len(p)] if p else out


def test_cuts_owners_and_store_against_a_sequential_chunker(spark):
    rng = random.Random(9)
    base = rng.randbytes(40_000)
    rows = [(i, base[rng.randrange(20_000) :][: rng.randrange(30_000)] + rng.randbytes(rng.randrange(3000))) for i in range(25)] + [(30, b"\0" * 60_000), (31, b"\0" * 60_000)]
    assert all(media.cuts(p) == sequential(p) for _, p in rows)
    seen, want = set(), {}
    for i, p in sorted(rows):
        ends = sequential(p)
        listed = []
        for a, b in zip([0, *ends], ends):
            digest = hashlib.sha256(p[a:b]).hexdigest()
            listed.append((digest, b - a, digest not in seen))
            seen.add(digest)
        want[i] = (len(p), hashlib.sha256(p).hexdigest(), len(listed), sum(x[2] for x in listed), listed, True)
    df = spark.createDataFrame([(i, bytearray(p)) for i, p in rows], "page_id long, html binary").repartition(3)
    got = {r.page_id: (r.n_bytes, r.sha256, r.n_chunks, r.n_stored, [(c.digest, c.size, c.payload is not None) for c in r.chunks], r.verified) for r in media.media_chunks(df).collect()}
    assert got == want
