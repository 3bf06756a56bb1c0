import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

from lectern.llm.imatch import IMatch, compare, fingerprints, lexicon, likeness

ROWS = [
    (5, "alpha beta gamma delta"), (3, None), (9, "Alpha, BETA. gamma delta"), (1, ""), (7, "epsilon zeta beta 😀 eta é"),
    (8, "alpha beta gamma delta"), (2, "theta iota kappa lambda mu nu xi"), (8, "theta iota kappa lambda mu nu xi"),
]


def corpus(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string")


def test_compare_against_brute_force(spark):
    got = compare(corpus(spark)).collect()
    order = sorted(((d, t or "") for d, t in ROWS), key=lambda r: (-r[0], r[1]))
    expected = []
    for i, (d, text) in enumerate(order):
        half = len(text) // 2
        edited = text[: len(text) - half] + order[(i + 1) % len(order)][1][:half]
        expected.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(expected)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert {r["near_next"] for r in got if r["doc_id"] == 9} != {0.0}


def test_many_ranges_and_gaps(spark):
    rows = [(i * i, f"text number {i} of many") for i in range(60)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {r["doc_id"]: r["edited_sha256"] for r in compare(corpus(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for i, (d, text) in enumerate(rows):
        half = len(text) // 2
        edited = text[: len(text) - half] + rows[i - 1][1][:half]
        assert got[d] == hashlib.sha256(edited.encode()).hexdigest()


def test_equal_terms_equal_fingerprints(spark):
    got = {(r["doc_id"], r["text"]): r["fingerprint"] for r in fingerprints(corpus(spark)).collect()}
    assert got[5, ROWS[0][1]] == got[9, ROWS[2][1]] == got[8, ROWS[0][1]] and got[3, None] == got[1, ""]
    assert got[2, ROWS[6][1]] != got[5, ROWS[0][1]]


def test_lexicon_is_the_band(spark):
    rows = [(i, f"every{'' if i else ''} rare{i} {'half' if i % 2 else 'other'}") for i in range(40)]
    config = IMatch(rare=0.1, common=0.6, bits=16)
    counts = Counter(w for _, t in rows for w in set(re.findall("[a-z0-9]+", t)))
    band = {w for w, n in counts.items() if 4 <= n <= 24}
    assert sum(bin(x & (2**64 - 1)).count("1") for x in lexicon(corpus(spark, rows), config)) == len(band) == 2


def test_likeness(spark):
    from pyspark.sql import functions as F

    pairs = [("a.b.--------", "a.c.--------", 0.5), ("a.b", "a.b", 1.0), ("a.--------", "--------.b", 0.0)]
    table = spark.createDataFrame(pairs, "a string, b string, x double")
    assert [r["y"] for r in table.select(likeness(F.col("a"), F.col("b")).alias("y")).collect()] == [x for _, _, x in pairs]


@pytest.mark.parametrize("rows", [[], [(1, "alone here")], [(None, "no key"), (None, None)]])
def test_small_tables(spark, rows):
    assert compare(corpus(spark, rows)).count() == len(rows)


def brute_fingerprint(text, band, config):
    """The method in plain Python; Spark hashes with seed 42, an array element by element."""
    def signed(x):
        return x - 2**64 if x >= 2**63 else x

    words = {w for w in re.findall(r"[^\W_]+", (text or "").lower())}
    every = sorted(signed(xxhash.xxh64_intdigest(w, 42)) for w in words)
    used = [h for h in every if h in band] or every

    def component(chosen):
        if not chosen:
            return "--------"
        h = 42
        for x in chosen:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), h)
        return f"{h:016x}"[8:]

    out, shift = [component(used)], 63
    for share, number in config.subsets:
        shift -= share.bit_length() - 1
        out += [component([h for h in used if h >> shift & share - 1 == k]) for k in range(number)]
    return out


def brute_likeness(a, b):
    some = [(x, y) for x, y in zip(a, b) if (x, y) != ("--------", "--------")]
    return 1.0 if a == b else sum(x == y for x, y in some) / max(len(some), 1)


def test_fingerprints_and_likenesses_against_brute_force(spark):
    rng, config = random.Random(7), IMatch(rare=0.02, common=0.3, bits=20)
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(400)]
    rows = [(3 * i, " ".join(rng.choices(words[: 50 + 3 * i], k=rng.randint(1, 60)))) for i in range(80)]
    got = {r["doc_id"]: r for r in compare(corpus(spark, rows), config).collect()}
    counts = Counter(w for _, t in rows for w in set(t.split()))
    hashed = {w: xxhash.xxh64_intdigest(w, 42) for w in counts}
    band = {h - 2**64 if h >= 2**63 else h for w, h in hashed.items() if 2 <= counts[w] <= 24 and 0.02 * 80 <= counts[w]}
    places = {h & (1 << config.bits) - 1 for h in band}
    assert not {h & (1 << config.bits) - 1 for w, h in hashed.items() if (h - 2**64 if h >= 2**63 else h) not in band} & places
    for i, (d, text) in enumerate(rows):
        half = len(text) // 2
        edited = text[: len(text) - half] + rows[i - 1][1][:half]
        own, other, near = (brute_fingerprint(t, band, config) for t in (text, edited, rows[i - 1][1]))
        assert got[d]["fingerprint"].split(".") == own
        if not set(re.findall("[a-z]+", edited)) - set(counts):
            assert got[d]["edited_fingerprint"].split(".") == other
            assert got[d]["near_edited"] == pytest.approx(brute_likeness(own, other))
        assert got[d]["near_next"] == pytest.approx(brute_likeness(own, near))


def test_blocks_follow_one_another(spark):
    from lectern.llm import imatch

    rng = random.Random(11)
    keys = sorted({rng.randrange(-5000, 10**12) if rng.random() < 0.5 else rng.randrange(900) for _ in range(900)}, reverse=True)
    rows = [(k, f"text {k}") for k in keys] + [(None, f"none {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, t string")
    for size in (0, 40, 3000):
        got = imatch.with_next(docs, "doc_id", lambda x: x, size, 1).collect()
        after = {r["t"]: r["next_t"] for r in got}
        assert len(got) == len(rows) == len(after)
        for a, b in zip(keys, keys[1:]):
            assert after[f"text {a}"] == f"text {b}"
        # The rows without a key are one chain between the last key and the first.
        at, chain = after[f"text {keys[-1]}"], []
        while at.startswith("none"):
            chain.append(at)
            at = after[at]
        assert at == f"text {keys[0]}" and len(set(chain)) == 40
