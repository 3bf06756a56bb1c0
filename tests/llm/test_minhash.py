import random

import numpy as np
import pytest

from lectern.llm import copies as C
from lectern.llm import minhash as M


def brute(rows, words=2):
    """(key, size, component, kept) by every pair of sets."""
    sets = []
    for _, text in rows:
        w = [x for x in (text or "").translate({ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}).encode().split()]
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if part[i] != part[j] and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((part[i], part[j]))
                part = [low if p == high else p for p in part]
    least = {}
    for (k, _), p in zip(rows, part):
        least[p] = k if least.get(p) is None else least[p] if k is None else min(k, least[p])
    return sorted(((k, len(s), least[p], k == least[p]) for (k, _), s, p in zip(rows, sets, part)), key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    line, out = "one very common line that many of the texts hold in the middle", []
    for _ in range(30):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice((1, 2, 5, 12, 60, 300)))]
        for _ in range(4):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                text[rng.randrange(len(text))] = f"w{rng.randrange(300)}"
            out.append((len(out) + 5, " ".join(text[:30] + line.split() * rng.randint(0, 1) + text[30:])))
    extra = [None, "", " \t\n", "Alone", "aLONE\x0b", "Ärger", "ärger", "two words", "two words", "two words two", "x " * 3000]
    return out + [(k + 500, t) for k, t in enumerate(extra)] + [(None, out[0][1]), (None, "nobody else"), (None, None), (1, "last last")]


def test_against_every_pair(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sum(r[3] for r in want) < len(rows) - 30
    assert found(M.near_duplicates(docs)) == want
    small = C.Copies(words=2, keys=30, rows=4, block=3, orders=M.shifts, least=M.signature, chains=False)
    assert found(M.near_duplicates(docs, small)) == want


def test_many_near_copies(spark):
    rng = random.Random(8)
    base, rows = [f"w{i}" for i in range(120)], []
    for k in range(300):
        text = list(base)
        for _ in range(rng.randint(1, 8)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    small = C.Copies(words=2, keys=30, rows=4, block=48, orders=M.shifts, least=M.signature, chains=False)
    assert found(M.near_duplicates(docs, small)) == brute(rows)


def test_empty_repeats_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(4, text.upper(), 1, 2, 3), (7, text + " more", 1, 2, 3), (7, text + " more", 1, 2, 3), (9, None, 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n int, part int, least int")
    assert found(M.near_duplicates(docs)) == [(4, 59, 4, True), (7, 60, 4, False), (7, 60, 4, False), (9, 0, 9, True)]
    assert M.near_duplicates(docs.limit(0)).count() == 0


def test_coordinates_are_fair():
    # The share of equal coordinates is the Jaccard, as for independent permutations, and the permutations can be undone.
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        pool = rng.integers(0, 2**64, 400, dtype=np.uint64)
        a, b = pool[:350], pool[50:]
        equal = (M.signature(a, M.shifts(120)) == M.signature(b, M.shifts(120))).mean()
        errors.append(equal - 300 / 400)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    x = rng.integers(0, 2**64, 100_000, dtype=np.uint64)
    assert len(np.unique(M.scattered(x))) == len(np.unique(M.permuted(x))) == len(np.unique(x))


def test_pairs_at_the_limit_are_not_missed():
    rng = np.random.default_rng(4)
    config, by, missed, pruned = M.CIRCULANT, M.shifts(120), 0, 0
    for size in (10, 40, 300):
        for _ in range(400):
            pool = rng.integers(0, 2**64, size, dtype=np.uint64)
            gone = size // 10
            a, b = np.sort(pool[: size - gone]), np.sort(pool[gone:])
            assert C.alike(a, b)
            least = [M.signature(x, by) for x in (a, b)]
            missed += not set(C.min_keys(least[0], config)) & set(C.min_keys(least[1], config))
            pruned += (least[0] == least[1]).sum() < C.least_equal(config)
    assert missed == 0 and pruned == 0
