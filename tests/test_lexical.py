"""Lexical search by blocks and bounds, against scoring every pair."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import words as W
from lectern.operators import chunks as C
from lectern.operators import lexical as L
from lectern.operators import search as S

SF = "/root/testdata/sf0.01"
IDS = ["doc", "part"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    rows = [(i // 3, i % 3, " ".join(rng.choices(words, weights, k=rng.choice((0, 1, 5, 40, 200))))) for i in range(900)]
    rows += [(1000, 0, None), (1000, 1, ""), (1000, 2, "the of and"), (1001, 0, rows[7][2]), (1001, 1, rows[7][2])]
    asked = [(i, " ".join(rng.choices(words, weights, k=rng.choice((1, 2, 8, 30)))), None) for i in range(40)]
    asked += [(90, None, None), (91, "the of", None), (92, "absent words only", None), (93, "w0", None), (94, "w0 w1 w2", 5), (95, "w3", 1000), (None, "w5 w6", None)]
    chunks = spark.createDataFrame(rows, "doc int, part int, text string")
    return chunks, spark.createDataFrame(asked, "qid int, question string, doc int"), rows, asked


def every(spark, corpus, k, slack=None):
    """(qid, doc, part, score) of all pairs that share a word, by plain Python; the k best, or all within some words of the best."""
    _, _, rows, asked = corpus
    bag = lambda t: {w for w in (t or "").lower().split() if w not in W.SEARCH_STOPWORDS and len(w) > 1}
    out, pairs = [], 0
    for q, text, scope in asked:
        want = bag(text)
        found = [(len(want & bag(t)), d, p) for d, p, t in rows if (scope is None or scope == d) and want & bag(t)]
        pairs += len(found)
        found.sort(key=lambda x: (-x[0], x[1], x[2]))
        best = found[0][0] if found else 0
        chosen = found[:k] if slack is None else [x for x in found if x[0] >= max(1, best - slack)]
        out += [(q, d, p, round(n / len(want), 6)) for n, d, p in chosen]
    return sorted(out, key=str), pairs


@pytest.mark.parametrize("k", [1, 5, 200])
def test_top_k_is_that_of_every_pair(spark, corpus, k):
    chunks, asked, _, _ = corpus
    want, pairs = every(spark, corpus, k)
    got = S.lexical_top(asked, chunks, k, "qid", "question", IDS, "text", scope="doc")
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == want


def test_slack_reaches_all_within_it(spark, corpus):
    chunks, asked, _, _ = corpus
    unscoped = asked.where("doc IS NULL").drop("doc")
    want, _ = every(spark, (None, None, corpus[2], [a for a in corpus[3] if a[2] is None]), 1, 2)
    got = S.lexical_best(unscoped, chunks, 1, "qid", "question", IDS, "text", slack=2)
    assert {tuple(r) for r in got.collect()} >= set(want)


def test_a_kept_index_serves_any_questions(spark, corpus):
    chunks, asked, _, _ = corpus
    kept = L.index(chunks, IDS, "text", keep=True)
    whole = asked.where("doc IS NULL").drop("doc")
    for part in (whole, whole.where("qid < 5")):
        words = L.asked_words(part, "qid", "question")
        rows = lambda found: sorted(map(str, found.collect()))
        assert rows(L.candidates(words, kept, 5)) == rows(L.candidates(words, L.Index(kept.places), 5))


def test_empty_sides(spark, corpus):
    chunks, asked, _, _ = corpus
    assert S.lexical_top(asked.limit(0), chunks, 5, "qid", "question", IDS, "text").count() == 0
    assert S.lexical_top(asked, chunks.limit(0), 5, "qid", "question", IDS, "text").count() == 0


def test_questions_of_very_many_words(spark, corpus, monkeypatch):
    chunks, asked, _, _ = corpus
    monkeypatch.setattr(L, "MOST", 3)
    want, _ = every(spark, corpus, 5)
    got = S.lexical_top(asked, chunks, 5, "qid", "question", IDS, "text", scope="doc")
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == want


def test_packed_counts(spark):
    # A bit for each chunk, added up over very many postings.
    bits = F.lit(-1 ^ (1 << 5) ^ (1 << 62)).cast("long")
    sums = spark.range(L.MOST).select(*[c.alias(f"s{i}") for i, c in enumerate(L._lanes(bits))]).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(16)])
    opened = L._opened(sums.select("*", F.lit(1).alias("qid"), F.lit(1).alias("n_asked"), F.lit(0).alias("block"), F.lit(1).alias("least")))
    assert {r["slot"]: r["n"] for r in opened.collect()} == {i: L.MOST for i in range(64) if i not in (5, 62)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_few_pairs_are_scored(spark):
    docs, questions = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    chunks = C.chunks(docs).cache()
    pairs = S.lexical_scores(questions, chunks, "item_id", "text", ["doc_id", "chunk_index"], "chunk").count()
    found = L.index(chunks, ["doc_id", "chunk_index"], "chunk")
    asked = L.asked_words(questions, "item_id", "text")
    formed = L.candidates(asked, found, 5).count()
    assert 0 < formed * 10 < pairs
    # A stored word has no more rows than there are blocks, however many chunks hold it.
    blocks = found.places.selectExpr("count(DISTINCT place div 64) AS n").first()["n"]
    assert found.postings().groupBy("word").count().agg(F.max("count")).first()[0] <= blocks
    met = L.met_blocks(asked, found)
    kept = L.kept_blocks(met, 5).count()
    assert kept < met.count()
    chunks.unpersist()


def test_no_question_meets_a_text(spark, corpus):
    chunks, asked, _, _ = corpus
    plan = S.lexical_top(asked.drop("doc"), chunks, 5, "qid", "question", IDS, "text")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
