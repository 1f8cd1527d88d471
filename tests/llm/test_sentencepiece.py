import random
import struct

import numpy as np
import sentencepiece
from granary.llm.fst import Machine, machine
from granary.llm.sentencepiece_fst import MODEL, encode_decode
from hypothesis import given, settings
from hypothesis import strategies as st

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids(m, texts):
    return [None if b is None else np.frombuffer(b, dtype=m.dtype).tolist() for b in m.encode(texts)]


def test_equal_to_the_library_on_random_texts():
    rng, m = random.Random(2), machine(MODEL)
    letters = "abcdefe thein  \n\t,.éñ日本x▁🙂\0ſ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["a" * 1000, " " * 40, " " * 33 + "x", "", " ", "e" * 77 + "  ", "naïve café—“quotes” `code` {x: 1}", "http://a.b/c?d=e  //  ==== !!!! ....,,,)),"]
    got = ids(m, texts)
    assert got == [LIBRARY.encode(t) for t in texts]
    assert [m.decode(np.array(g, dtype=int)) for g in got] == [LIBRARY.decode(g) for g in got]


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(codec="utf-8")))
def test_equal_to_the_library_on_any_text(text):
    m = machine(MODEL)
    assert ids(m, [text])[0] == LIBRARY.encode(text)


def _message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3]) + _varint(value)
        elif isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        else:
            out += _varint(number << 3 | 2) + _varint(len(value)) + value
    return out


def _varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def test_unigram_model_takes_the_cheapest_path():
    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -4.0, 1), ("b", -4.0, 1), ("ab", -5.0, 1), ("▁ab", -7.5, 1), ("▁a", -5.5, 1), ("ba", -4.5, 1), ("bab", -9.0, 1)]
    body = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, t)))) for p, s, t in pieces)
    proto = body + _message((2, _message((3, 1))), (3, _message((1, b"identity"), (3, 1), (4, 0))))
    m, library = Machine(proto), sentencepiece.SentencePieceProcessor(model_proto=proto)
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab  ") for _ in range(rng.randint(1, 90))) for _ in range(300)]
    score = dict((p, s) for p, s, _ in pieces)
    for mine, theirs in zip(ids(m, texts), [library.encode(t) for t in texts]):
        assert sum(pieces[i][1] for i in mine) >= sum(pieces[i][1] for i in theirs) - 1e-4
        assert "".join(pieces[i][0] for i in mine) == "".join(pieces[i][0] for i in theirs)
    assert score["▁ab"] == -7.5


def test_table_with_nulls_empty_long_and_repeated_rows(spark):
    long = "Wörter und words, " * 20_000
    rows = [(1, "hello world"), (None, "x"), (2, None), (3, ""), (4, long), (1, "hello world"), (5, "a\x00b\n c")]
    df = spark.createDataFrame([(i, t, "7", "q") for i, t in rows], "doc_id long, text string, ids string, decoded string")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids, r.decoded) for r in encode_decode(df).collect() if r.decoded is not None or r.ids is None)
    want = sorted((str(i), None if t is None else len(LIBRARY.encode(t)), None if t is None else LIBRARY.encode(t), t) for i, t in rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert encode_decode(df.limit(0)).count() == 0
