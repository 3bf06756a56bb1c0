import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lectern.llm import simhash as S
from lectern.llm.components import components


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in (None, "", " \n", "One", "one two", "A b C d É É", "x y z " * 50, "a\x0bb\x0cc\x85d"):
        assert S.fingerprint(text) == brute(text), text


def test_every_close_pair_has_a_chain():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 4000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    assert S.chained(a, b).all()


def linked(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(fps))]


def test_links_against_brute_force(spark):
    rng = random.Random(2)
    fps = []
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(25):
            fps.append(at)
            for _ in range(rng.randint(1, 4)):
                at ^= 1 << rng.randrange(64)
    fps = list(dict.fromkeys(fps))
    signed = [(i, int(np.array(f, np.uint64).view(np.int64))) for i, f in enumerate(fps)]
    distinct = spark.createDataFrame(signed, "rep long, fp long")
    for block in (512, 2):
        edges = S.links(distinct, S.SimHash(block=block))
        found = dict((r["node"], r["component"]) for r in components(edges).collect())
        assert [found.get(i, i) for i in range(len(fps))] == linked(fps)


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    near = base.replace("w399", "other")
    rows = [(5, base, 1), (3, base.upper(), 1), (3, base.upper(), 1), (9, near, 1), (7, None, 1), (8, " ", 1), (1, "unrelated text here", 1), (None, base, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r["doc_id"] or -1), r["component_id"], r["fingerprint"]) for r in S.near_duplicates(docs).collect())
    groups = [(d, c) for d, c, _ in got]
    close = bin(brute(base) ^ brute(near)).count("1") <= 3
    assert groups == [(-1, 3), (1, 1), (3, 3), (3, 3), (5, 3), (7, 7), (8, 7), (9, 3 if close else 9)]
    assert dict((d, f) for d, _, f in got)[7] == "0" * 16
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.range(1, 200).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    extra = spark.createDataFrame([(500, 501), (501, 501), (501, 500)], "u long, v long")
    found = dict((r["node"], r["component"]) for r in components(chain.union(extra)).collect())
    assert all(found[i] == 0 for i in range(200)) and found[500] == found[501] == 500 and len(found) == 202


def _work(spark, edges, partitions):
    """The components of an edge table, and the tasks that found them, with shuffles of so many partitions."""
    held = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, context = {k: spark.conf.get(k) for k in held}, spark.sparkContext
    group = f"components-{random.random()}"
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup(group, group)
        found = dict((r["node"], r["component"]) for r in components(edges).collect())
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    tracker = context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    return found, sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))


def test_components_of_few_edges_take_few_tasks(spark):
    # Each task leaves files: with 211 partitions a graph of some thousand edges filled the disk.
    star = spark.range(1, 300).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    found, tasks = _work(spark, star, 40)
    assert found == dict.fromkeys(range(300), 0) and 0 < tasks < 6 * 40
    ring = spark.range(1, 300).select(F.col("id").alias("u"), (F.col("id") % 299 + 1).alias("v"))
    found, tasks = _work(spark, star.union(ring), 40)
    assert found == dict.fromkeys(range(300), 0) and 0 < tasks < 16 * 40


def test_components_of_random_graphs_and_hubs(spark):
    rng = random.Random(6)
    for n, m in ((60, 30), (200, 180), (400, 600)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        pairs += [(n + 50, i) for i in range(0, n, 9)] + [(None, 3), (4, None)]
        parent = {}

        def root(i):
            while parent.setdefault(i, i) != i:
                i = parent[i]
            return i

        for u, v in pairs:
            if u is not None and v is not None and u != v:
                x, y = sorted((root(u), root(v)))
                parent[y] = x
        rows = components(spark.createDataFrame(pairs, "u long, v long")).collect()
        assert len(rows) == len(parent) and {r["node"]: r["component"] for r in rows} == {i: root(i) for i in parent}
