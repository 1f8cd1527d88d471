import random

from granary.llm.licenses import TEMPLATES, Scanner, bigrams, bounds, license_scan


def brute(text, templates, threshold):
    out = []
    lines = (text or "").split("\n")
    for k, t in sorted(templates.items()):
        template, best = bigrams(t), None
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                run = bigrams(" ".join(lines[i : j + 1]))
                if run:
                    dice = 2 * len(run & template) / (len(run) + len(template))
                    if dice >= threshold and (best is None or dice > best[0] + 1e-12):
                        best = (dice, i, j)
        if best:
            out.append((k, round(best[0], 6)))
    return out


def test_against_all_runs_of_lines():
    rng = random.Random(3)
    templates = {"a": "one two three four five six", "b": "alpha beta\ngamma delta epsilon", "c": "x y", "d": "word"}
    words = "one two three four five six alpha beta gamma delta epsilon x y noise".split()
    scanner = Scanner(templates, 0.6)
    for _ in range(1500):
        text = "\n".join(" ".join(rng.choice(words) if rng.random() < 0.4 else w for w in rng.choice(list(templates.values())).split()[: rng.randint(0, 6)]) for _ in range(rng.randint(1, 6)))
        assert [m[:2] for m in scanner.scan(text)] == brute(text, templates, 0.6), text
        for k, dice, i, j in scanner.scan(text):
            run = bigrams(" ".join(text.split("\n")[i : j + 1]))
            assert abs(2 * len(run & scanner.sets[k]) / (len(run) + len(scanner.sets[k])) - dice) < 1e-6


def test_bounds_follow_from_the_threshold():
    for size in range(1, 200):
        lo, hi = bounds(size, 0.9)
        assert all((2 * min(n, size) / (n + size) >= 0.9 - 1e-9) == (lo <= n <= hi) for n in range(1, 400))


def test_table_with_nulls_empty_long_and_repeated_rows(spark):
    mit = TEMPLATES["MIT"]
    wrapped = "Copyright me\n" + "\n".join(mit[i : i + 60] for i in range(0, 0)) + "\n".join(mit.split(". ")) + "\nmore text follows here"
    rows = [(1, wrapped), (None, "Released under the MIT License."), (2, None), (3, ""), (4, "no licence of any kind " * 30_000), (1, wrapped), (5, "all RIGHTS   reserved!!\n" * 300)]
    df = spark.createDataFrame([(i, t, 1.0, "z") for i, t in rows], "doc_id long, text string, dice double, license_id string")
    got = sorted(((r.doc_id, r.license_id, r.first_line) for r in license_scan(df).collect()), key=str)
    assert got == sorted([(1, "MIT", 1)] * 2 + [(None, "MIT-notice", 0), (5, "proprietary-notice", 0)], key=str)
    assert license_scan(df.limit(0)).count() == 0
    assert license_scan(df, templates={"none": "", "one": "word"}).count() == 0
