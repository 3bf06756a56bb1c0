import hashlib
import math
import random

import numpy as np
import pytest

from lectern.llm import clusters as C

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, rounds, size):
    """Cluster and squared distance of each usable row, and the centroids, by every distance."""
    usable = [
        (i, [math.floor(256 * v) for v in e])
        for i, e, *_ in rows
        if e is not None and len(e) == size and all(v is not None and math.isfinite(v) for v in e)
    ]
    mark = lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    means = [x for _, x in sorted(usable, key=mark)[:k]]
    gap = lambda x, m: sum((a - b) ** 2 for a, b in zip(x, m))
    for turn in range(rounds + 1):
        found = [(i, *min((gap(x, m), c) for c, m in enumerate(means))[::-1]) for i, x in usable]
        if turn < rounds:
            for c in range(len(means)):
                mine = [x for (_, a, _), (_, x) in zip(found, usable) if a == c]
                if mine:
                    means[c] = [sum(v) // len(mine) for v in zip(*mine)]
    return found, means


def told(found, means):
    totals = {c: sum(d for _, a, d in found if a == c) for c in range(len(means))}
    fit = lambda v: v if v < 2**63 else None
    return [
        (i, c, fit(d), fit(totals[c]), fit(sum(totals.values())), hashlib.sha256(",".join(map(str, means[c])).encode()).hexdigest())
        for i, c, d in found
    ]


def check(spark, rows, config, schema=SCHEMA):
    got = [tuple(r) for r in C.clusters(spark.createDataFrame(rows, schema), config).collect()]
    assert sorted(got, key=str) == sorted(told(*brute(rows, config.clusters, config.rounds, config.size)), key=str)
    return got


def test_against_all_distances(spark):
    rng = random.Random(5)
    near = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(9)]
    rows = [(i, [float(np.float32(v + rng.gauss(0, 0.1))) for v in rng.choice(near)], 0) for i in range(400)]
    check(spark, rows, C.SortMeans(clusters=12, size=6))
    check(spark, rows, C.SortMeans(clusters=12, size=6, rounds=0))


def test_ties_repeats_and_unusable_rows(spark):
    rows = [(i, [float(i % 3), float(i % 2)], 0) for i in range(40)]
    rows += [(7, [0.0, 1.0], 0), (7, [0.0, 1.0], 0), (None, [5.0, 5.0], 1), (None, [5.0, 5.0], 1), (50, None, 0), (51, [], 0)]
    rows += [(52, [1.0], 0), (53, [1.0, None], 0), (54, [float("nan"), 0.0], 0), (55, [0.0, float("-inf")], 0), (56, [-0.001, -0.004], 0)]
    got = check(spark, rows, C.SortMeans(clusters=8, size=2))
    assert len(got) == 45
    # More clusters than vectors.
    check(spark, rows[:5], C.SortMeans(clusters=8, size=2))


def test_components_of_any_size(spark):
    rng = random.Random(6)
    sizes = [rng.choice((1.0, 1.0, 1.0, 1e4, 1e7, 1e12, 3e38)) for _ in range(60)]
    rows = [(i, [rng.uniform(-1, 1) * size for _ in range(3)], 0) for i, size in enumerate(sizes)]
    rows = [(i, [float(np.float32(v)) for v in e], x) for i, e, x in rows]
    got = check(spark, rows, C.SortMeans(clusters=20, size=3))
    assert any(r[2] is None for r in got) and any(r[2] is not None for r in got)
    assert C._floor(-1.5, 256) == -384 and C._floor(3e38, 256) == math.floor(3e38) * 256


def test_empty_and_clashing_columns(spark):
    config = C.SortMeans(clusters=3, size=2)
    docs = spark.createDataFrame([(1, [0.5, 0.5], 3, 4, 5)], "vec_id int, embedding array<double>, cluster int, x int, told int")
    found = C.clusters(docs, config)
    assert [tuple(r)[:5] for r in found.collect()] == [(1, 0, 0, 0, 0)] and dict(found.dtypes)["vec_id"] == "int"
    assert C.clusters(docs.limit(0), config).collect() == []



@pytest.mark.parametrize("spread", [0.05, 0.6])
def test_scan_stops_early(spread):
    rng = np.random.default_rng(7)
    means = rng.integers(-256, 256, (40, 16))
    x = means[rng.integers(0, 40, 3000)] + (rng.normal(0, spread, (3000, 16)) * 256).astype(int)
    every = ((x[:, None, :] - means[None]) ** 2).sum(axis=2)
    best, least, taken = C.assign(x, np.zeros(len(x), int), means, C.ordered(means))
    assert (best == every.argmin(axis=1)).all() and (least == every.min(axis=1)).all()
    again, _, fewer = C.assign(x, best, means, C.ordered(means))
    assert (again == best).all() and fewer <= taken
    # Where clusters are far apart a vector that stays looks at its own centroid alone.
    assert spread > 0.1 or fewer < 1.2 * len(x)
