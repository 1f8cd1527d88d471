import random

from granary.llm.line_dedup import line_dedup, matches, neighbourhood, without_repeated_lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows, near=20):
    """Ids are unique here."""
    lines = []
    for d, t in sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0)):
        for pos, line in enumerate(t.split("\n")):
            line = " ".join(line.split()).lower()
            if line:
                lines.append((d, pos, line))
    out = set()
    for n, (d, pos, t) in enumerate(lines):
        close = [(e, p) for e, p, u in lines[:n] if u != t and abs(len(u) - len(t)) < 2 and min(len(u), len(t)) >= near and distance(t, u) == 1]
        first = next((i for i, (_, _, u) in enumerate(lines) if u == t))
        close = [(e, p) for e, p, u in lines[:first] if u != t and abs(len(u) - len(t)) < 2 and min(len(u), len(t)) >= near and distance(t, u) == 1]
        equal = [(e, p) for e, p, u in lines[:n] if u == t]
        if close or equal:
            out.add((d, pos, *(close or equal)[0]))
    return out


def table(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, None, None) for d, t in rows], "doc_id long, text string, line string, pos int, h1 long, o string")


def edited(rng, line):
    i = rng.randrange(len(line) + 1)
    c = rng.choice("abcé")
    return rng.choice([line[:i] + c + line[i:], line[:i] + line[i + 1 :], line[:i] + c + line[i + 1 :], line[: i // 2] + c + line[i // 2 : i] + c + line[i:]])


def test_against_brute_force(spark):
    rng = random.Random(7)
    seeds = ["".join(rng.choice("abcdé fgh") for _ in range(rng.choice([10, 18, 19, 20, 21, 24, 40, 80]))).strip() for _ in range(30)] + ["a" * 30, "ab" * 20, "x" * 3000]
    rows = []
    for d in range(60):
        lines = [rng.choice(seeds) for _ in range(4)]
        lines = [edited(rng, x) if rng.random() < 0.5 else x for x in lines]
        rows.append((d, "\n".join(lines + rng.choice([[], [""], ["  "]]))))
    rows += [(None, rows[3][1]), (100, None), (101, ""), (102, "\n\n"), rows[5], (103, "  " + seeds[0].upper() + "\t")]
    got = {(r.doc_id, r.line_no, r.kept_doc_id, r.kept_line_no) for r in line_dedup(table(spark, rows)).collect()}
    assert got == brute(rows)
    assert any(r[0] != r[2] for r in got)


def test_hot_key_of_mutual_neighbours(spark):
    """Many lines that differ in one place make one group, not a pair for every two of them."""
    base = "this line differs in one place only: {} and goes on"
    rows = [(i, base.format(chr(0x4E00 + i))) for i in range(500)]
    df = table(spark, rows)
    got = {(r.doc_id, r.kept_doc_id) for r in line_dedup(df).collect()}
    assert got == {(i, 0) for i in range(1, 500)}
    assert matches(df, "doc_id", "text")[1].count() == 499


def test_filter_keeps_rows_and_columns(spark):
    a, b = "a line that is long enough to be near", "another line that stays where it is"
    rows = [(1, a + "\n" + b), (2, a[:-1] + "!\nfresh words"), (3, a), (4, None), (5, ""), (1, a + "\n" + b), (None, "fresh words\n\nmore")]
    df = spark.createDataFrame([(d, t, len(t or ""), "k", None) for d, t in rows], "doc_id long, text string, n_chars long, gone string, __left int")
    out = without_repeated_lines(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    whole = a + "\n" + b
    want = [(1, whole, len(whole))] * 2 + [(2, "fresh words", 11), (4, None, 0), (5, "", 0), (None, "\nmore", 5)]
    assert got == sorted(want, key=str)
    assert without_repeated_lines(df.limit(0)).count() == 0 and line_dedup(df.limit(0)).count() == 0


def test_rolling_hash_equals_hash_of_the_shorter_text():
    t = "naïve 日本 text"
    _, gone = neighbourhood(t, 0, len(t))
    for i in range(len(t)):
        assert neighbourhood(t[:i] + t[i + 1 :], 0, 0)[0] == int(gone[i])
