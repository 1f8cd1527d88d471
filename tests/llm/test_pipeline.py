import random
from collections import Counter

import corpus_pipeline as C
import sentencepiece
from granary.llm import line_dedup, mixing, near_dedup, sentencepiece_fst, toxicity
from granary.llm.common import table

from ..conftest import DATA
from .test_line_dedup import distance
from .test_mixing import brute_blocks, brute_plan
from .test_near_dedup import brute as near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_in_order():
    assert [n for n, _ in C.STAGES] == ["toxicity", "line dedup", "near dedup", "mixing", "sentencepiece"]


def test_each_stage_takes_effect(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "sentencepiece":
            assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        if name == "line dedup":
            assert line_dedup.line_dedup(out).count() < 0.01 * out.count() + 5
        if name == "near dedup":
            assert near_dedup.near_duplicates(out).count() == 0
        if name in ("toxicity", "line dedup", "near dedup"):
            assert set(r.doc_id for r in out.select("doc_id").collect()) <= set(r.doc_id for r in docs.select("doc_id").collect())
        docs = out
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0.5 * counts[0]
    assert docs.columns == sentencepiece_fst.encode_decode(table(spark, DATA, "documents")).columns
    assert docs.where("decoded IS NULL OR n_tokens != size(ids)").count() == 0


def test_run_gives_the_last_stage(spark):
    out = C.run(spark, DATA)
    assert out.columns == ["doc_id", "ids", "n_tokens", "decoded"] and out.count() > 0


def corpus(seed=12):
    rng = random.Random(seed)
    syllables = [a + b for a in "bdfglmnprst" for b in "aeiou"]
    sentence = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))
    shared = [sentence(12) for _ in range(6)]
    texts, toxic = [], set()
    for i in range(220):
        lines = [sentence(rng.choice([3, 9, 14])) for _ in range(rng.randint(2, 5))]
        if rng.random() < 0.4:
            line = rng.choice(shared)
            at = rng.randrange(len(line))
            lines.insert(rng.randrange(len(lines) + 1), rng.choice([line, line[:at] + "x" + line[at + 1 :], line[:at] + "zz" + line[at:], line.upper()]))
        if i % 7 == 0:
            toxic.add(i)
            lines[0] += " Zorkish qwuxly " * 2
        texts.append("\n".join(lines))
    for i in (3, 5, 8):  # copies with a word put before every line, which line dedup leaves
        texts.append("\n".join(sentence(9) + " " + x for x in texts[i].split("\n")))
    rows = [(i, t, "en", rng.choice(["a", "a", "b", None])) for i, t in enumerate(texts)]
    rows += [(500, None, "en", "a"), (501, "", None, "a"), (502, " \n", "en", "b"), (None, sentence(20), "en", "b"), rows[4], rows[4]]
    return [(*r, len(r[1] or "")) for r in rows], toxic


def kept_lines(rows, most=4):
    """The texts without repeated lines, from all pairs of lines; ids are unique but for rows alike."""
    seen, out, done = [], [], {}
    for d, t in sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0)):
        lines, left = t.split("\n"), []
        for line in lines:
            x = " ".join(line.split()).lower()
            close = x and any(x == y or abs(len(x) - len(y)) <= most and distance(x, y) <= min(most, min(len(x), len(y)) // 20) for y in seen)
            if x:
                seen.append(x)
            if not close:
                left.append(line)
        done[d, t] = "\n".join(left) if len(left) < len(lines) else t
        if len(left) < len(lines) and not done[d, t].strip():
            done[d, t] = None
    for r in rows:
        if r[1] is None or done[r[0], r[1]] is not None:
            out.append((r[0], r[1] if r[1] is None else done[r[0], r[1]], *r[2:]))
    return out


def test_run_against_brute_force(spark, tmp_path):
    """Every stage's rows from a plain version of it, with nulls, empty texts, repeats and a null id; the classifier's weights are its own."""
    rows, toxic = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(160)], "doc_id long, quality int, toxic int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fit(table(spark, tmp_path, "documents"), table(spark, tmp_path, "labels"))
    clean = [r for r in rows if model.score(r[1]) < 0]
    assert toxic.isdisjoint(r[0] for r in clean) and len(clean) == len(rows) - len(toxic)
    lines = kept_lines(clean)
    assert sum(a[1] != b[1] for a, b in zip(sorted(lines, key=str), sorted(clean, key=str))) > 10
    copies = near_copies(list({(r[0], r[1]) for r in lines if r[0] is not None}))
    single, met = [], set()
    for r in lines:
        if (r[0], r[1]) in met and any(c.isalnum() for c in r[1] or "") or r[0] in copies:
            continue
        met.add((r[0], r[1]))
        single.append(r)
    want_blocks = brute_blocks([r[:4] for r in single], mixing.BLOCK_TOKENS)
    plan = brute_plan(Counter(s for s, _ in want_blocks), mixing.SHARD_SLOTS)
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL)
    want = Counter((want_blocks[b][2], tuple(library.encode(want_blocks[b][0])), want_blocks[b][0]) for b in plan.values())
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in C.run(spark, str(tmp_path)).collect())
    assert got == want


def test_stages_over_hard_tables(spark, tmp_path):
    """Nulls in any column, ties, repeats, a long text and columns whose names clash with working ones; then no rows at all."""
    rows, _ = corpus(5)
    long = "word " * 60_000
    hard = [(*r, None, 7, "h", None) for r in rows[:40]] + [(None, None, None, None, None, None, None, None, None)] * 2 + [(900, long, "en", "a", len(long), 1, 2, "t", "x"), (901, "same", "en", "b", 4, 1, 2, "t", "x"), (902, "same", "en", "b", 4, 1, 2, "t", "x")]
    df = spark.createDataFrame(hard, SCHEMA + ", gone int, n long, h string, __key string")
    labels = spark.createDataFrame([(1, None, 1), (1, 1, 0), (None, 1, 1), (2, 1, None), (7, 0, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in C.STAGES:
        out = stage(spark, df, str(tmp_path))
        if name != "sentencepiece":
            assert out.columns == df.columns
        assert out.count() > 0
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
