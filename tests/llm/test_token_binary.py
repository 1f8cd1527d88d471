import random
import struct

import numpy as np
import pytest
from granary.llm import token_binary as B
from hypothesis import given, settings
from hypothesis import strategies as st


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 70_000), st.integers(0, 2**40)), max_size=1500))
def test_round_trip_and_direct_access(ids):
    code = B.dac_encode(np.array(ids, dtype=np.uint64))
    assert B.dac_decode(code).tolist() == ids and B.dac_length(code) == len(ids)
    for i in random.Random(1).sample(range(len(ids)), min(20, len(ids))):
        assert B.dac_get(code, i) == ids[i]


def test_every_id_of_a_long_code():
    ids = np.random.default_rng(3).integers(0, 50_256, 20_000)
    code = B.dac_encode(ids)
    assert [B.dac_get(code, i) for i in range(len(ids))] == ids.tolist()
    assert len(code) < 2.3 * len(ids)
    with pytest.raises(IndexError):
        B.dac_get(code, len(ids))
    with pytest.raises(ValueError):
        B.dac_get(b"nope1234", 0)


def test_long_texts_cut_where_no_token_crosses(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice(["word ", "don't ", "x1 ", "\n\n", "é", "  ", "!? "]) for _ in range(4000))
    whole = B.token_ids(text, B.RANKS).tolist()
    monkeypatch.setattr(B, "CUT", 300)
    assert B.token_ids(text, B.RANKS).tolist() == whole


def test_table_with_nulls_empty_long_and_repeated_rows(spark):
    e = B.byte_encoder(B.RANKS)
    rows = [(1, "hello world"), (None, "x"), (2, None), (3, ""), (4, "long words " * 60_000), (1, "hello world"), (5, "<|endoftext|> \x00")]
    df = spark.createDataFrame([(i, t, "7", 1) for i, t in rows], "doc_id long, text string, code string, n_tokens int")
    got = [(r.doc_id, r.n_tokens, None if r.code is None else B.dac_decode(bytes(r.code)).tolist()) for r in B.token_codes(df).collect()]
    want = [(i, None if t is None else len(e.encode_ordinary(t)), None if t is None else e.encode_ordinary(t)) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert B.token_codes(df.limit(0)).count() == 0


def test_a_million_characters_of_any_kind(monkeypatch):
    e = B.byte_encoder(B.RANKS)
    for text in (" " * 1_000_000, "\n" * 999_999 + "x", " \n" * 400_000 + " a", "a" * 1_000_000, "!" * 1_000_000, "日" * 300_000, "\u2003" * 1_000_000):
        assert e.decode(B.token_ids(text, B.RANKS).tolist()) == text
    # what the library still takes in one call is encoded alike with runs set apart
    monkeypatch.setattr(B, "RUN", 3)
    rng = random.Random(6)
    for _ in range(60):
        text = "".join(rng.choice([" " * rng.randrange(9), "\n" * rng.randrange(6), "\t", "word", "7", "!", "\x1c", "\u00a0"]) for _ in range(40))
        assert B.token_ids(text, B.RANKS).tolist() == e.encode_ordinary(text)


def test_code_bytes_against_a_plain_writer():
    ids = [5, 300, 70_000, 0, 255, 256] * 90
    levels, rest = [], ids
    while rest:
        levels.append(rest)
        rest = [x >> 8 for x in rest if x >= 256]
    want = b"DAC1" + struct.pack("<I", len(levels)) + b"".join(struct.pack("<I", len(x)) for x in levels)
    for x in levels:
        blocks = -(-len(x) // 512)
        bits = sum((v >= 256) << k for k, v in enumerate(x)).to_bytes(blocks * 64, "little")
        ranks = [sum(v >= 256 for v in x[: 512 * b]) for b in range(blocks)]
        want += bytes(v & 255 for v in x) + bits + struct.pack(f"<{blocks}I", *ranks)
    assert B.dac_encode(np.array(ids)) == want
