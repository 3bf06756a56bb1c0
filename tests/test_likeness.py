"""Near-equal questions by a join, against every pair."""

import random

import pytest

from lectern.operators import likeness as L
from lectern.operators.study import similar

SCHEMA = "doc int, place int, question string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    topics = "methods results datasets limits payment terms parties dates totals authors ünïts".split()
    shapes = ["What does the document say about {}?", "Which evidence does the document give about {}?", "Summarize {} and {}.", "{}", "How are {} and {} related to {}?", "{} {} {} {} {} {}"]
    out = []
    for i in range(420):
        text = rng.choice(shapes).replace("{}", "%s")
        text = text % tuple(rng.choices(topics, k=text.count("%s")))
        for _ in range(rng.choice((0, 0, 1, 3))):
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", "x", "a b", text[at].upper()]) + text[at + 1 :]
        out.append((i % 4, i, text))
    long = " ".join(rng.choices(topics, k=60))
    out += [(0, 900, long), (0, 901, long[:-30] + "some other ending here"), (0, 902, long.upper()), (1, 903, "?"), (1, 904, "?"), (1, 905, None), (1, 906, "the of"), (1, 907, "ab"), (1, 908, "AB"), (1, 909, "abc")]
    return out + [(1, 907, "ab"), (2, 2, out[2][2])]


def test_all_pairs_that_are_alike(spark, rows):
    items = spark.createDataFrame(sorted({r for r in rows if r[2] is not None}), "group int, id int, text string")
    got = {(r["group"], r["first"], r["second"]) for r in L.alike(items).collect()}
    each = sorted({r for r in rows if r[2] is not None})
    want = {(a[0], a[1], b[1]) for a in each for b in each if a[0] == b[0] and a[1] < b[1] and similar(b[2], a[2])}
    assert got == want and len(want) > 100


def test_what_stays_is_what_one_after_the_other_keeps(spark, rows):
    want = []
    for group in range(4):
        kept = []
        for _, place, text in sorted((r for r in set(rows) if r[0] == group), key=lambda r: (r[1], r[2] or "")):
            if text is None or not any(similar(text, k) for k in kept):
                kept.append(text or "")
                want.append((group, place, text))
    got = [tuple(r) for r in L.distinct_questions(spark.createDataFrame(rows, SCHEMA), "doc", "place", "question").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert L.distinct_questions(spark.createDataFrame([], SCHEMA), "doc", "place", "question").count() == 0


def test_a_chain_of_likes(spark):
    # Each is like the next alone: every other one stays.
    words = [f"word{i}" for i in range(60)]
    rows = [(1, i, " ".join(words[i : i + 11])) for i in range(12)]
    kept = []
    for _, _, text in rows:
        if not any(similar(text, k) for k in kept):
            kept.append(text)
    got = L.distinct_questions(spark.createDataFrame(rows, SCHEMA), "doc", "place", "question").collect()
    assert sorted(r["question"] for r in got) == sorted(kept)


def test_bounds_hold():
    from difflib import SequenceMatcher

    rng = random.Random(1)
    for _ in range(800):
        a = "".join(rng.choices("abcd e", k=rng.randint(1, 30)))
        b = "".join(c if rng.random() < 0.9 else rng.choice("abcd") for c in a)[rng.randint(0, 2) :]
        ratio = SequenceMatcher(None, a, b).ratio()
        assert 2 * L.longest_common(a, b) >= ratio * (len(a) + len(b)) - 1e-9
        assert L.alike_letters(a, b) == (ratio >= 0.88)


def test_answers_are_evaluated_alike(spark):
    from lectern.operators import study, study_generation
    from lectern.sources.providers import Fallback, LocalText

    class Broken:
        def evaluate_answer(self, *_):
            raise RuntimeError("no model")

    terms = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [("q one", terms, g) for g in (terms, terms.upper(), "alpha", "", "nothing here", "alpha beta gamma", None)] + [("what", "", "x"), ("the of", "", "x"), (None, None, None), ("size", "", "SIZE")]
    frame = spark.createDataFrame(rows, "question string, expected_answer string, user_answer string")
    want = sorted((LocalText().evaluate_answer(q or "", e or "", g or "") for q, e, g in rows))
    assert sorted((r["score"], r["feedback"]) for r in study.evaluate(frame, "question", "expected_answer", "user_answer").collect()) == want
    assert sorted((r["score"], r["feedback"]) for r in study_generation.evaluated(frame, Fallback(Broken())).collect()) == want
    assert want[0][0] == 0.0 and want[-1] == (1.0, study.ALL_SAID)
