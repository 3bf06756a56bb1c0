import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.llm import langid as L

EN = "the quick brown fox jumps over the lazy dog and then runs away from the other animals of the forest "
DE = "der schnelle braune fuchs springt über den faulen hund und läuft dann vor den anderen tieren des waldes davon "
SAMPLE = (("de", L.letters(DE)), ("en", L.letters(EN)))


def brute(text, known):
    """Greedy longest matches, found by plain search."""
    count = at = 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in known:
            end += 1
        at = max(end - 1, at + 1)
        count += 1
    return count


TEXTS = ["THE Dog!! runs", "der hund läuft", "", None, "123 #", "x", "жук the", "ab\n\ncd  ef", "𝔘𝔫𝔦", "dog " * 3000, "über", "  the  ", "zzz the"]


def test_phrases_against_plain_search():
    counts, sizes = L.phrase_counts(TEXTS, L.build(SAMPLE), L.LanguageRules())
    for i, text in enumerate(TEXTS):
        folded = L.letters(text or "")
        assert sizes[i] == len(folded), text
        if all(ord(c) < 0x10000 for c in folded):
            assert counts[:, i].tolist() == [brute(folded, known) for _, known in SAMPLE], text


def test_many_texts_in_step():
    texts = [(EN if i % 2 else DE)[i : i + 30 + i] for i in range(100)]
    counts, _ = L.phrase_counts(texts, L.build(SAMPLE), L.LanguageRules(walkers=64))
    for i, text in enumerate(texts):
        assert counts[:, i].tolist() == [brute(L.letters(text), known) for _, known in SAMPLE]


def test_large_alphabets_stay_within_the_bytes():
    rng = random.Random(1)
    wide = "".join(chr(0x4E00 + min(int(rng.expovariate(1 / 400)), 2999)) for _ in range(40_000))
    rules = L.LanguageRules()
    m = L.build((("en", L.letters(EN * 400)[:40_000]), ("zh", wide)), rules)
    assert m.table.nbytes + m.classes.nbytes + m.codes.nbytes <= 200_000_000
    counts, _ = L.phrase_counts([wide[500:560], EN], m, rules)
    assert counts.argmin(axis=0).tolist() == [1, 0]


def test_every_label_is_taught(spark):
    rng = random.Random(2)
    words = {f"l{k:03}": ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(30)] for k in range(130)}
    rows = [(10 * i + j, " ".join(rng.choices(w, k=40)), x) for i, (x, w) in enumerate(words.items()) for j in range(4)]
    rules = L.LanguageRules(table_bytes=20_000_000)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = L.learn(docs, rules, F.col("doc_id") % 10 != 3, "text", "lang", "doc_id")
    assert [x for x, _ in sample] == sorted(words) and L.build(sample, rules).table.nbytes <= 20_000_000
    got = L.predict(docs.where("doc_id % 10 = 3"), sample, rules).collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)


def test_predictions_against_plain_search(spark):
    rules = L.LanguageRules(least=5)
    rows = [(i, t, 7) for i, t in enumerate(TEXTS) if all(ord(c) < 0x10000 for c in t or "")]
    got = L.predict(spark.createDataFrame(rows, "doc_id long, text string, score int"), SAMPLE, rules, names=("l", "s", "r")).collect()
    for r in got:
        folded = L.letters(r["text"] or "")
        assert r["score"] == 7
        if not folded:
            assert (r["l"], r["s"], r["r"]) == ("und", 0.0, None)
            continue
        counts = [brute(folded, known) for _, known in SAMPLE]
        assert r["l"] == SAMPLE[counts.index(min(counts))][0]
        assert r["s"] == pytest.approx(1 - min(counts) / max(counts))
        assert r["r"] == (min(counts) / len(folded) if len(folded) >= 5 else None)


def test_limits_tell_language_from_noise():
    rng = random.Random(3)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 6))) for _ in range(200)]
    text = " ".join(rng.choices(words, k=6000))
    limit = L.limits((("x", text), ("y", "a")))
    noise = "".join(rng.choices("etaoinshrdlu ", k=2000))
    counts, sizes = L.phrase_counts([text[5000:7000], L.letters(noise)], L.build((("x", text[:30_000]),)), L.LanguageRules())
    assert counts[0][0] / sizes[0] < limit["x"] < counts[0][1] / sizes[1] and limit["y"] == float("inf")


def corpus(spark):
    rows = [(i, (EN if i % 2 else DE)[i % 9 :] + f" {i}", "en" if i % 2 else "de", 1) for i in range(40)]
    rows += [(100, None, "en", 1), (101, "12 34", "en", 1), (102, EN, None, 1), (102, EN, None, 1), (None, DE, "de", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def test_documents(spark):
    got = L.identify(corpus(spark), teach=F.col("doc_id") < 20).collect()
    assert len(got) == 45
    for r in got:
        if r["doc_id"] in (100, 101):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == ("de" if r["doc_id"] is None or r["doc_id"] < 100 and r["doc_id"] % 2 == 0 else "en")
            assert 0 < r["score"] <= 1
    assert {r["lang_pred"] for r in L.identify(corpus(spark), teach=F.lit(False)).collect()} == {"und"}
    assert L.identify(corpus(spark).limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_held_out_accuracy(spark):
    from lectern.llm.queries import op7_language_id

    got = op7_language_id(spark, "/root/testdata/sf0.01").where("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    row = got.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("x")).first()
    assert row["x"] > 0.98
