"""Sets that meet in many blocks: what is shuffled follows the sets, not the blocks."""

import random

from lectern.operators import likeness as L


def _shuffled(spark):
    """Rows that all stages so far have written for shuffles."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_no_set_is_shuffled_for_each_block(spark):
    rng = random.Random(5)
    rows = [(g, i, [f"w{rng.randint(0, 120)}x" for _ in range(rng.randint(5, 25))]) for g in ("a", "b") for i in range(400)]
    rows = [(g, i, sorted(set(w))) for g, i, w in rows]
    sets = spark.createDataFrame(rows, "group string, id long, keys array<string>")
    before = _shuffled(spark)
    got = {tuple(r) for r in L._met_in_blocks(sets, 0.25, 16).collect()}
    after = _shuffled(spark)
    words = {(g, i): set(w) for g, i, w in rows}
    shares = {(g, i, j): len(words[g, i] & words[g, j]) / len(words[g, i] | words[g, j]) for g, i in words for h, j in words if g == h and i < j}
    want = {k for k, v in shares.items() if v >= 0.25}
    assert want <= got and len(want) > 20
    # 25 blocks a group: each set was shuffled 25 times, and each pair once more.
    assert sum(n for k, n in after.items() if k not in before) <= 3 * len(rows)


def test_shares_are_exact_where_words_have_no_place_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(L, "PLACES", (4, 8))
    monkeypatch.setattr(L, "AT_ONCE", 50)
    rng = random.Random(6)
    sets = [(("a", "b")[i % 2], i // 2, set(rng.sample(range(60), rng.randint(1, 20)))) for i in range(120)]
    # Two sets of one id are no pair of each other, but each is one with others.
    sets += [("a", 900, {1, 2, 3}), ("a", 900, {1, 2, 4})]
    items = spark.createDataFrame([(g, i, [f"w{x}x" for x in w]) for g, i, w in sets], "group string, id int, keys array<string>")
    got = sorted((r["group"], r["first"], r["second"], round(r["jaccard"], 9)) for r in L._shares_in_blocks(items, 0.2, 16).collect())
    pairs = [(g, min(i, j), max(i, j), len(w & v) / len(w | v)) for k, (g, i, w) in enumerate(sets) for h, j, v in sets[:k] if g == h and i != j]
    assert got == sorted((g, i, j, round(s, 9)) for g, i, j, s in pairs if s >= 0.2) and len(got) > 50
