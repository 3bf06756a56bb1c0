"""Sets that share a small part of their words, by blocks, against every pair."""

import random

from lectern.operators import likeness as L


def _want(rows, least):
    sets = [(g, i, set(w for w in t.lower().split() if len(w) > 1)) for g, i, t in rows if t]
    pairs = ((a, b) for a in sets for b in sets if a[0] == b[0] and a[0] is not None and a[1] < b[1] and a[2] and b[2])
    return {(a[0], a[1], b[1], round(len(a[2] & b[2]) / len(a[2] | b[2]), 9)) for a, b in pairs if len(a[2] & b[2]) / len(a[2] | b[2]) >= least}


def _rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(g, 1000 * g + i, " ".join(rng.sample(words[:70] if i % 7 == 0 else words, rng.randint(1, 60)))) for g in (1, 2, 3) for i in range(90)]
    return rows + [(1, 5000, " ".join(words)), (1, 5001, " ".join(words[:80])), (1, 5002, " ".join(words[:79])), (4, 1, "only one"), (5, 1, ""), (5, 2, None), (None, 1, "w1 w2"), (None, 2, "w1 w2")]


def test_blocks_find_every_pair(spark, monkeypatch):
    rows = _rows()
    items = spark.createDataFrame(rows, "group int, id int, text string")
    for least in (0.2, 0.1):
        want = _want(rows, least)
        got = {(r["group"], r["first"], r["second"], round(r["jaccard"], 9)) for r in L.word_pairs(items, least).collect()}
        assert got == want and len(want) > 30
    sets = items.select("group", "id", L.question_words("text").alias("keys")).where("size(keys) > 0")
    small = {tuple(r) for r in L._met_in_blocks(sets, 0.2, 16).collect()}
    whole = {tuple(r) for r in L._met_in_blocks(sets, 0.2).collect()}
    assert small == whole and {w[:3] for w in _want(rows, 0.2)} <= whole
    assert L.word_pairs(items.limit(0), 0.2).count() == 0


def test_pairs_without_a_chance_never_become_rows(spark):
    # All share a common word, and nothing else.
    rows = [(1, i, "common " + " ".join(f"own{i}x{j}" for j in range(12))) for i in range(120)]
    rows += [(1, 500, rows[0][2] + " more")]
    items = spark.createDataFrame(rows, "group int, id int, text string")
    sets = items.select("group", "id", L.question_words("text").alias("keys"))
    assert L._met_in_blocks(sets, 0.2).count() < 20
    assert [(r["first"], r["second"]) for r in L.word_pairs(items, 0.2).collect()] == [(0, 500)]
