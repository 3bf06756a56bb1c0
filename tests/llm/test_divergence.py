import random
import re
from collections import Counter

from lectern.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least=10, top=10, unit=10**9):
    """All rows, by every kept term and every pair of sources."""
    lower = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    docs = [(lang or "", source or "", Counter(TERM.findall((text or "").translate(lower)))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for d in docs if d[0] == lang for t in d[2])
        kept = [t for t, n in held.items() if n >= least]
        counts = {s: sum((d[2] for d in docs if d[:2] == (lang, s)), Counter()) for s in {d[1] for d in docs if d[0] == lang}}
        total = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + unit * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(c) for s, c in counts.items()}, share(total)
        for s in counts:
            pairs = [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in counts if x != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, x, v, i) for i, (x, v) in enumerate(found[:most], 1)]
    return sorted(out)


def check(spark, rows, config=D.Audit()):
    got = sorted(tuple(r) for r in D.divergence(spark.createDataFrame(rows, SCHEMA), config).collect())
    assert got == brute(rows, config.documents, config.top)
    return got


def test_against_every_term_and_pair(spark):
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in "abcdeé世Ü" for b in "klmnoß"] + ["I'm", "x-ray", "A1b2"]
    rows = []
    for i in range(260):
        lang, source = rng.choice(["en", "de", None]), rng.choice([None, "s1", "s2", "S3", "é4"])
        words = rng.choices(vocabulary[: 20 if source == "s2" else None], k=rng.randint(0, 40))
        rows.append((i, rng.choice([" ", "\n", "_"]).join(w.upper() if rng.random() < 0.3 else w for w in words), lang, source))
    # A source without terms, a language without kept ones, one of a single source; nulls, an empty and a very long text, repeated rows.
    rows += [(900, "", "en", "silent"), (901, "rare words", "fr", "s1"), (902, None, "fr", "s2"), (903, "alone", "it", "s1")]
    rows += [(904, "alone " * 40_000 + "again", "en", "s1"), (1, *rows[1][1:]), (1, *rows[1][1:])]
    got = check(spark, rows)
    assert {r[4] for r in got if r[0] == "fr"} == {0} and not [r for r in got if r[0] == "it"]


def test_equal_vectors_and_ties(spark):
    # Thirty terms with the same counts: ten of them rank, in the order of their bytes.
    words = [f"{c}{d}" for c in "abcdeé" for d in "vwxyz"]
    rows = [(i, " ".join(words), "en", "s1") for i in range(12)] + [(i, "other", "en", "s2") for i in range(12)]
    got = check(spark, rows)
    assert [r[3] for r in sorted(got, key=lambda r: r[5]) if r[1:3] == ("s1", "term")] == sorted(words)[:10]
    check(spark, rows, D.Audit(documents=13))
    check(spark, rows, D.Audit(documents=1, top=3, salts=1))


def test_counts_beyond_a_long_product(spark):
    # The share of a count whose product with the unit is no long.
    from pyspark.sql import functions as F

    row = spark.range(1).select(D._share(F.lit(7 * 10**14), F.lit(9 * 10**15), F.lit(10**6), D.Audit())).first()
    assert row[0] == 1 + 10**9 * (7 * 10**14 + 2) // (9 * 10**15 + 2 * 10**6)


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two", "en", "a", 1, 2, 3)] * 10 + [(2, "two", "en", "b", 1, 2, 3)], SCHEMA + ", term int, n int, p int")
    got = sorted(tuple(r) for r in D.divergence(docs).collect())
    assert got == brute([(1, "one two", "en", "a")] * 10 + [(2, "two", "en", "b")])
    assert D.divergence(docs.limit(0)).collect() == []
