import random

from granary.llm.line_dedup import line_dedup, matches_within, parities

from .test_line_dedup import distance, edited, table


def bound(n, most):
    return min(most, n // 20)


def brute(rows, most):
    """Ids are unique and texts single lines here."""
    out = set()
    for n, (d, t) in enumerate(rows):
        first = next(i for i, (_, u) in enumerate(rows) if u == t)
        close = [e for e, u in rows[:first] if abs(len(u) - len(t)) <= most and 1 <= distance(t, u) <= bound(min(len(t), len(u)), most)]
        equal = [e for e, u in rows[:n] if u == t]
        if close or equal:
            out.add((d, (close or equal)[0]))
    return out


def test_bound_grows_with_the_line(spark):
    rng = random.Random(3)
    seeds = ["".join(rng.choice("abcdéfgh") for _ in range(n)) for n in (18, 19, 20, 22, 25, 39, 40, 41, 59, 61, 79, 80, 82, 83, 120)] + ["a" * 90, "ab" * 45]
    rows = []
    for d in range(180):
        line = rng.choice(seeds)
        for _ in range(rng.randrange(6)):
            line = edited(rng, line)
        rows.append((d, line))
    for most in (2, 4):
        got = {(r.doc_id, r.kept_doc_id) for r in line_dedup(table(spark, rows), most_edits=most).collect()}
        assert got == brute(rows, most)
    assert got > {(r.doc_id, r.kept_doc_id) for r in line_dedup(table(spark, rows[:0])).collect()}


def test_one_word_exchanged(spark):
    a = "The committee will meet again in April to decide on the budget of the coming year, as it said on Monday."
    rows = [(1, a), (2, a.replace("April", "March")), (3, a.replace("April", "September"))]
    assert [(r.doc_id, r.kept_doc_id) for r in line_dedup(table(spark, rows), most_edits=4).collect()] == [(2, 1)]
    assert line_dedup(table(spark, rows)).count() == 0


def test_hot_group(spark):
    base = "this line differs in two places only, {} here and {} there, and it then goes on for some while"
    rows = [(i, base.format(chr(0x4E00 + i), chr(0x5E00 + i))) for i in range(400)]
    df = table(spark, rows)
    assert {(r.doc_id, r.kept_doc_id) for r in line_dedup(df, most_edits=4).collect()} == {(i, 0) for i in range(1, 400)}
    assert matches_within(df, "doc_id", "text", 4)[1].count() == 399


def test_an_edit_changes_two_parities_at_most():
    rng = random.Random(5)
    line = "a line to be changed in one place or another"
    for _ in range(50):
        x, y = parities([line, edited(rng, line)[: len(line) + 2]]).tolist()
        assert (x ^ y).bit_count() <= 4
