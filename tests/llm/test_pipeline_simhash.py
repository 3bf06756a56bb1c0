"""The near-copy stage of the pipeline links by SimHash fingerprints, and edited copies besides."""

import random

import corpus_pipeline
from lectern.llm import copies, simhash


def _bits(a, b):
    return (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count()


def _texts():
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    # One word again and again: the fingerprint hangs on it, the set of shingles hardly.
    run = ["again"] * 2000
    one, other = (" ".join(run + [f"{kind}{rng.randrange(10**6)}" for _ in range(400)]) for kind in "xy")
    return one, other, " ".join(base), " ".join(base[:30] + ["edited"] + base[31:])


def test_the_stage_links_what_fingerprints_link(spark, tmp_path):
    one, other, plain, edited = _texts()
    assert _bits(one, other) <= 3 and not copies.alike(copies.shingles(one), copies.shingles(other))
    rows = [(4, other, "x"), (2, one, "x"), (7, plain, "x"), (9, edited, "x"), (None, other, "x"), (11, "something else is said here " * 3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, linked string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect())
    assert got == [2, 7, 11]


def test_classes_of_texts_are_those_of_op3(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    by_text = {}
    ids = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    named = {r["own"]: r["linked"] for r in simhash.text_classes(docs).collect()}
    from pyspark.sql import functions as F

    for r in docs.select("doc_id", F.xxhash64("text").alias("own")).collect():
        by_text.setdefault(named[r["own"]], set()).add(ids[r["doc_id"]])
    assert all(len(x) == 1 for x in by_text.values()) and len(by_text) == len(set(ids.values())) > 100
