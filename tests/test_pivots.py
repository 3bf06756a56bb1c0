"""Nearest vectors by blocks around pivots, against every distance."""

import numpy as np
import pytest

from lectern.operators import pivots as P

CONFIG = P.Pivots(count=8, block=16)


def brute(asked, rows, k):
    q, r = (np.array([v for _, v in side if v is not None], float) for side in (asked, rows))
    qs, rs = ([i for i, v in side if v is not None] for side in (asked, rows))
    scores = np.round(np.clip(P.unit(q) @ P.unit(r).T, 0, 1), 6)
    out = []
    for i, line in zip(qs, scores):
        order = sorted(range(len(rs)), key=lambda j: (-line[j], rs[j]))[:k]
        out += [(i, rs[j], float(line[j]), n) for n, j in enumerate(order, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    point = lambda: (centres[rng.integers(12)] + rng.normal(0, 0.15, 8)).tolist()
    rows = [(i, point()) for i in range(900)] + [(2000 + i, [0.0] * 8) for i in range(3)]
    # Copies share a score and rank by id; one vector is the opposite of another.
    rows += [(3000 + i, rows[5][1]) for i in range(6)] + [(4000, [-x for x in rows[6][1]]), (4001, None)]
    asked = [(i, point()) for i in range(60)] + [(70, rows[5][1]), (71, rows[6][1]), (72, [0.0] * 8), (73, None), (74, (-centres[0]).tolist())]
    frame = lambda side, name: spark.createDataFrame(side, f"{name} long, embedding array<double>")
    return frame(asked, "qid"), frame(rows, "rid"), asked, rows


@pytest.mark.parametrize("k", [1, 5, 40])
def test_equal_to_every_distance(spark, sides, k):
    asked, rows, a, r = sides
    got = sorted((x["qid"], x["rid"], x["score"], x["rank"]) for x in P.top(asked, rows, k, "qid", "rid", config=CONFIG).collect())
    assert got == brute(a, r, k)


def test_blocks_are_ruled_out(spark, sides):
    asked, rows, a, r = sides
    found = P.search(asked, rows, 5, "qid", "rid", "embedding", CONFIG)
    pairs, out = P.skipped(found).first()
    assert out > pairs / 2
    # No question meets a block twice, and a block is met by whole.
    met = found.first.union(found.more).select("block", "q")
    assert met.count() == met.distinct().count()
    # A question without a direction meets all blocks, as all rows score 0.
    assert found.first.union(found.more).where("q = 72").count() == found.sizes.count()


def test_few_rows_and_empty_sides(spark, sides):
    asked, rows, a, r = sides
    assert sorted(tuple(x) for x in P.top(asked, rows.limit(3).coalesce(1), 5, "qid", "rid", config=CONFIG).select("qid", "rid", "score", "rank").collect()) == brute(a, r[:3], 5)
    assert P.top(asked, rows.limit(0), 5, "qid", "rid", config=CONFIG).count() == 0
    assert P.top(asked.limit(0), rows, 5, "qid", "rid", config=CONFIG).count() == 0
    zeros = rows.where("rid between 2000 and 2002")
    assert {x["score"] for x in P.top(asked, zeros, 2, "qid", "rid", config=CONFIG).collect()} == {0.0}


def test_rows_are_not_copied_for_questions(spark, sides):
    asked, rows, _, _ = sides
    found = P.search(asked, rows, 5, "qid", "rid", "embedding", CONFIG)
    # Pairs hold a block's number and the question, never a row's vector.
    assert found.first.columns == found.more.columns == ["block", "q", "qv"]
