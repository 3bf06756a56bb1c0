import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.llm.quality import LINEAR, QualityRules, bucket, edge, filter_quality, limits, measure, merged, quality, quartiles, sketches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLEAN = " ".join(f"word{i} or text{i}" for i in range(40))


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t ", "one", "a b c a b c a b c", "x y z\nx y z\n\nq", "é # é $\x0b\x0cß  日本 x", "a a a a a", "a b", CLEAN, "r " * 300]


def test_counts_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in measure(docs).collect()}
    for i, t in enumerate(TEXTS):
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == brute(t), t


def corpus(spark):
    rows = [(i, CLEAN + f" end{i}", "en", "a") for i in range(120)]
    rows += [(200, CLEAN + " ### $$$ %%% " * 40, "en", "a"), (201, CLEAN, None, None), (202, CLEAN, "en", "small"), (202, CLEAN, "en", "small")]
    rows += [(203, "too short", "en", "a"), (204, None, "en", "a"), (None, CLEAN, "en", "a"), (205, "again and again " * 40, "en", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_verdicts(spark):
    got = [(r["doc_id"], r["base_failed"], r["kept"]) for r in quality(corpus(spark), QualityRules()).collect()]
    assert len(got) == 128
    verdict = dict((d, (b, k)) for d, b, k in got)
    assert all(verdict[i] == (False, True) for i in range(120))
    assert verdict[200] == (False, False) and verdict[201] == verdict[202] == verdict[None] == (False, True)
    assert verdict[203] == verdict[204] == verdict[205] == (True, False)


def test_filter_keeps_columns(spark):
    docs = corpus(spark).withColumn("kept", F.lit("mine"))
    kept = filter_quality(docs)
    assert kept.columns == docs.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, *range(120), 201, 202, 202]


def test_empty(spark):
    assert quality(corpus(spark).limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 3])
def test_small_groups_use_their_language(spark, n):
    docs = spark.createDataFrame([(i, CLEAN, "en", f"s{i % n}") for i in range(6)], "doc_id long, text string, lang string, source string")
    assert quality(docs).where("kept").count() == 6


def verdicts(rows):
    """The contract and the method in plain Python: (doc_id, base_failed, kept)."""
    rules, found = QualityRules(), []
    for key, text, lang, source in rows:
        n, chars, symbols, dups, repeats = brute(text)
        lines = sum(bool(WORD.search(x)) for x in (text or "").split("\n"))
        values = [(a + 1) * 2**20 // (b + 1) for a, b in ((symbols, n), (dups, lines), (repeats, n), (chars, n))]
        found.append((key, lang or "", source or "", n < 50 or 100 * repeats > 50 * n, values))

    def limit(values):
        values, out = sorted(values), []
        for quarters, upper in ((1, 0), (3, 1)):
            v = values[-(-quarters * len(values) // 4) - 1]
            width = max(0, v.bit_length() - 5)
            out.append(float(v if v < LINEAR else ((v >> width) + upper) << width))
        return out

    def inside(lang, source, k, value):
        near = [x[4][k] for x in found if x[1] == lang and not x[3]]
        own = [x[4][k] for x in found if x[1:3] == (lang, source) and not x[3]]
        low, high = limit(own if len(own) >= rules.min_group else near)
        spread, ratio = high / low, rules.ratios[k]
        return value <= high * spread**ratio.fence * (1 + 1e-12) and not (ratio.low and value < low / spread**ratio.fence * (1 - 1e-12))

    return sorted(
        (-1 if key is None else key, bad, not bad and all(inside(lang, source, k, v) for k, v in enumerate(values)))
        for key, lang, source, bad, values in found
    )


def test_verdicts_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(330):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(rng.randint(40, 160))]
        for _ in range(rng.choice((0, 0, 0, 3, 60))):
            words[rng.randrange(len(words))] += rng.choice("#$%") * rng.randint(1, 4)
        cut = rng.randint(1, len(words))
        text = " ".join(words[:cut]) + ("\n" + " ".join(words[:5])) * rng.choice((0, 0, 2, 9)) + " " + " ".join(words[cut:])
        rows.append((i, text, rng.choice(("en", "de", None)), rng.choice("aaab")))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sorted((r["doc_id"], r["base_failed"], r["kept"]) for r in quality(docs).collect())
    want = verdicts(rows)
    assert got == want and 5 < sum(not b and not k for _, b, k in want) < 150
    again = sorted((r["doc_id"], r["base_failed"], r["kept"]) for r in quality(docs.repartition(7)).collect())
    assert again == want


def test_limits_follow_their_source(spark):
    rng = random.Random(6)
    word = lambda marked: "".join(rng.choices("abcdefgh", k=5)) + "%" * marked
    rows = [(k, " ".join(word(source == "b" and rng.random() < 0.3) for _ in range(100)), "en", source) for k in range(240) for source in "ab"]
    rows += [(1000 + i, " ".join(word(i == 0 or rng.random() < 0.3) for i in range(100)), "en", s) for i, s in enumerate("ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    verdict = {r["doc_id"]: r["kept"] for r in quality(docs).where("doc_id >= 1000").collect()}
    assert verdict == {1000: False, 1001: True}
    keyed = measure(docs).withColumns({"q_lang": F.col("lang"), "q_source": F.col("source")})
    bounds = {r["q_source"]: r["symbols_max"] for r in limits(sketches(keyed, QualityRules().ratios), QualityRules()).collect()}
    assert bounds["b"] > 5 * bounds["a"]


def test_sketches_merge_and_bound_their_error(spark):
    values = spark.range(1, 200_000, 7).select(F.col("id").alias("v"), bucket(F.col("id")).alias("b"))
    bad = values.where((F.col("v") < edge(F.col("b"), 0)) | (F.col("v") > edge(F.col("b"), 1)) | (edge(F.col("b"), 1) > 1.0625 * edge(F.col("b"), 0) + 1))
    assert bad.count() == 0
    rows = [(k % 3, f"s{k % 5}", "x", k % 40 + 32, 1) for k in range(1000)]
    found = spark.createDataFrame(rows, "q_lang int, q_source string, ratio string, bucket long, n long")
    one = quartiles(merged(merged(found, "q_lang", "q_source"), "q_lang"), "q_lang").orderBy("q_lang").collect()
    assert one == quartiles(merged(found, "q_lang"), "q_lang").orderBy("q_lang").collect()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_against_sql(spark):
    import duckdb

    from lectern.llm.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in ORACLE_SQL.items():
        want, got = con.execute(sql).df(), QUERIES[name](spark, sf).toPandas()
        assert sorted(want.columns) == sorted(got.columns)
        columns = sorted(want.columns)
        rows = [sorted(map(str, x[columns].itertuples(index=False, name=None))) for x in (want, got)]
        assert rows[0] == rows[1], name
