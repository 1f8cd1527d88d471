import random
import time

from granary.llm.licenses import TEMPLATES, Scanner, bigrams, license_scan


def brute(text, templates, threshold):
    """Best Dice coefficient over all windows of words."""
    w, out = text.split(), []
    for k, t in sorted(templates.items()):
        template = bigrams(t)
        sets = [bigrams(" ".join(w[i:j])) for i in range(len(w)) for j in range(i + 2, len(w) + 1)]
        best = max((2 * len(s & template) / (len(s) + len(template)) for s in sets), default=0) if template else 0
        if best >= threshold:
            out.append((k, round(best, 6)))
    return out


def test_against_all_windows():
    rng = random.Random(4)
    templates = {"a": "one two three four five six", "b": "alpha beta\ngamma delta epsilon", "c": "x y", "d": "word"}
    words = "one two three four five six alpha beta gamma delta epsilon x y noise".split()
    scanner = Scanner(templates, 0.6, windows=True)
    for _ in range(1500):
        parts = [" ".join(rng.choice(words) if rng.random() < 0.3 else x for x in rng.choice(list(templates.values())).split()) for _ in range(rng.randint(1, 5))]
        text = "".join(x + rng.choice([" ", "\n"]) for x in parts)
        assert [m[:2] for m in scanner.scan(text)] == brute(text, templates, 0.6), text


def test_licences_that_share_a_line(spark):
    apache = TEMPLATES["Apache-2.0-header"]
    rows = [(1, "Copyright 2024 Acme. All rights reserved."), (2, f"intro\nThis tool has a README, a manual and an author. {apache} Questions go to the list."), (3, "Some words " + TEMPLATES["MIT"].replace("\n", " ") + " and others"), (4, "all rights " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license_id, r.first_line, r.last_line) for r in license_scan(df).collect()}
    assert got >= {(1, "proprietary-notice", 0, 0), (2, "Apache-2.0-header", 1, 1), (3, "MIT", 0, 0)}
    assert not any(r[0] == 4 for r in got)
    assert 1 not in {r.doc_id for r in license_scan(df, windows=False).collect()}


def test_repeated_text_costs_little_more_than_one_copy():
    """A million characters of licences, one of them with a word changed throughout."""
    scanner = Scanner(TEMPLATES, 0.9, windows=True)
    once = TEMPLATES["MIT"] + "\n" + TEMPLATES["BSD-3-Clause"].replace("source", "sauce") + "\n"
    began = time.process_time()
    many = scanner.scan(once * 400)
    assert time.process_time() - began < 60
    assert len(once) * 400 > 900_000
    assert many == scanner.scan(once * 2) and {m[0] for m in many} == {"MIT", "BSD-3-Clause"}
