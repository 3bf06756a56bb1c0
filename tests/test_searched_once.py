"""Queries that go on with hits: searched once, and what is bounded on the way."""

import random
import tracemalloc

import numpy as np
import pytest

from lectern import catalog, catalog_documents  # noqa: F401
from lectern.operators import pivots, study

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["rerank", "evidence_pack", "evidence_first", "cited_hits", "anchor_coverage", "extractive_answers", "verified_answers", "answered_questions"])
def test_what_goes_on_with_hits_searches_once(spark, monkeypatch, name):
    from lectern.operators import search

    calls = []
    top = search.lexical_top
    monkeypatch.setattr(search, "lexical_top", lambda *a, **k: calls.append(1) or top(*a, **k))
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    # The index lies in tables named places: none of them is read again for the result.
    assert len(calls) == 1 and "/places-" not in plan


def _plain(said, count, mode="balanced"):
    shape, found = study.ASKING[mode], {}

    def about(topic):
        named = next((s for s in said if topic in s.lower()), None)
        return named or next((s for s in said if study._python_words(topic) <= study._python_words(s)), None)

    pairs = [(t, about(t)) for t in study.TOPICS] + [(" ".join(sorted(study._python_words(s))[:2]), s) for s in said]
    for topic, sentence in pairs:
        if len(found) < count and topic and sentence:
            found.setdefault(shape.format(topic), sentence)
    if not found and count > 0:
        found["What are the main points in this document?"] = " ".join(said[:2]) or "No usable context was available for summarization."
    return list(found.items())


def test_study_questions_are_those_of_every_sentence():
    rng = random.Random(6)
    words = "overview objective Objective design approach payment terms total amount amounts datasets methods the of x ünï".split() + ["a", "results.", "re-sults"]
    for _ in range(400):
        said = [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(rng.randint(0, 6))]
        count = rng.randint(0, 5)
        assert study.make_questions(said, count) == _plain(said, count)


def test_sentences_are_cut_into_words_only_where_needed(monkeypatch):
    seen = []
    cut = study._python_words
    monkeypatch.setattr(study, "_python_words", lambda t: seen.append(t) or cut(t))
    study.make_questions([f"plain sentence {i} is here" for i in range(200)], 3)
    assert len(seen) < 40


def test_scores_are_held_in_bounded_parts():
    rng = np.random.default_rng(1)
    q, r = rng.normal(size=(3000, 8)), np.concatenate([rng.normal(size=(2000, 8))] * 2)
    qs, rs = np.arange(3000), np.arange(4000)[::-1].copy()
    tracemalloc.start()
    got = pivots.nearest(qs, q, rs, r, 5, ["q", "r", "score"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Three thousand questions and four thousand rows are 96 MB of scores.
    assert peak < 80e6 and got.num_rows == 15000
    scores = np.round(np.clip(pivots.unit(q[:50]) @ pivots.unit(r).T, 0, 1), 6)
    order = np.lexsort((np.broadcast_to(rs, scores.shape), -scores), axis=1)[:, :5]
    assert got.column(1).to_numpy()[:250].tolist() == rs[order].ravel().tolist() and got.column(0).to_numpy()[:6].tolist() == [0, 0, 0, 0, 0, 1]
    assert pivots.nearest(qs[:0], q[:0], rs, r, 5, ["q", "r", "score"]).num_rows == 0
