import os
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lectern.llm import copies as C

SF = "/root/testdata/sf0.01"


def groups(rows, words=5):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    ids, part = [k for k, _ in rows], [k for k, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if part[i] != part[j] and both * 5 >= either * 4:
                low, high = sorted((part[i], part[j]))
                part = [low if p == high else p for p in part]
    return sorted(zip(ids, part))


def found(frame):
    return sorted((r["doc_id"], r["component_id"]) for r in frame.collect())


def test_edited_copies_against_brute_force(spark):
    rng = random.Random(3)
    line, rows = "one very common line that many of the texts hold in the middle", []
    for _ in range(25):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((4, 12, 60, 300)))]
        for _ in range(4):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 100))):
                text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text[:30] + line.split() * rng.randint(0, 1) + text[30:])))
    rows += [(len(rows), None), (len(rows) + 1, " "), (len(rows) + 2, "short"), (len(rows) + 3, "SHORT")]
    want = groups(rows)
    assert len({p for _, p in want}) < len(rows) - 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(C.edited_copies(docs)) == want
    assert found(C.edited_copies(docs, C.Copies(block=2))) == want
    assert found(C.edited_copies(docs.union(docs))) == sorted(want * 2)
    assert C.edited_copies(docs.limit(0)).count() == 0


def test_pairs_at_the_limit_are_not_pruned():
    rng = np.random.default_rng(4)
    factors, config = C._factors(96), C.Copies()
    for size in (5, 40, 300):
        missed = 0
        for _ in range(300):
            pool = rng.integers(0, 2**64, size, dtype=np.uint64)
            gone = size // 10
            a, b = np.sort(pool[: size - gone]), np.sort(pool[gone:])
            assert C.alike(a, b) == ((size - 2 * gone) * 5 >= size * 4)
            if C.alike(a, b):
                n, m = np.array([len(a)]), np.array([len(b)])
                fps = [np.array([C.majority(x)], np.uint64) for x in (a, b)]
                assert C._near(n, m, *fps).all()
                least = [C.minima(x, factors) for x in (a, b)]
                missed += not set(C.min_keys(least[0], config)) & set(C.min_keys(least[1], config))
                equal, keys, odd = C._split(pa.array([C.marks_of(x, factors, config) for x in (a, b)], pa.binary()), config)
                both = C.Members(np.arange(2), np.append(n, m), np.concatenate(fps), np.arange(2), np.zeros(2), equal, keys, odd)
                assert both.likely(0, np.array([1]), C.least_equal(config))[0].tolist() == [1]
        assert missed == 0


def test_many_copies_of_one_text(spark):
    rng = random.Random(8)
    base, rows = [f"w{i}" for i in range(120)], []
    for k in range(300):
        text = list(base)
        for _ in range(rng.randint(1, 2)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(C.edited_copies(docs, C.Copies(block=48))) == groups(rows)


def test_null_keys_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, 1, 2), (4, text.upper(), 1, 2), (7, text + " more", 1, 2), (None, "else", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, node int, key int")
    got = [(r["doc_id"], r["component_id"]) for r in C.edited_copies(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, 4), (4, 4), (7, 4), (None, None)], key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stage_drops_edited_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id IN (1, 255, 2, 56, 643, 770, 3)")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 643]
