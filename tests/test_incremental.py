"""Snapshots, vectors by content, uploads stored once and measures that follow corrections."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.sources import ingest as I
from lectern.sources import snapshots as S
from lectern.sources import vectors as V
from lectern.streaming import incremental

PAGES = "path string, page_number int, text string"
WORDS = "plenty of words that make a usable chunk of text number"


def pages(spark, n, extra=""):
    return spark.createDataFrame([(f"f{i}.pdf", 1, f"{WORDS} {i}{extra}") for i in range(n)], PAGES)


def marked(folder):
    """An embedder that leaves a mark for every text it is asked for."""

    def run(texts):
        import uuid

        for t in texts:
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as out:
                out.write(t)
        return [I.fake_embedding(t, 8) for t in texts]

    return run


def asked(folder):
    return sorted(open(os.path.join(folder, f)).read() for f in os.listdir(folder))


def test_a_version_is_seen_whole_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path / "index")
    assert S.current(spark, folder) == S.Snapshot(0, {}, {})
    I.write_tables(pages(spark, 2), folder)
    before = S.current(spark, folder)
    assert before.version == 1 and S.read(spark, folder, "chunks").count() == 2
    # A write that dies between its tables: pages are there, chunks are not.
    bad = pages(spark, 3).withColumn("text", F.when(F.col("path") == "f2.pdf", F.raise_error(F.lit("no text"))).otherwise(F.col("text")))
    commit = S.Commit(spark, folder)
    commit.write("pages", pages(spark, 3))
    with pytest.raises(Exception, match="no text"):
        commit.write("chunks", bad)
    assert S.current(spark, folder) == before
    assert S.read(spark, folder, "pages").count() == S.read(spark, folder, "chunks").count() == 2
    I.write_tables(pages(spark, 3), folder)
    assert S.read(spark, folder, "chunks").count() == 3 and S.current(spark, folder).version == 2
    # Whoever has an older snapshot goes on reading it.
    assert S.read(spark, folder, "chunks", before).count() == 2 and S.current(spark, folder, 1) == before
    with pytest.raises(ValueError):
        S.read(spark, folder, "nothing")


def test_text_is_kept_where_embedding_fails(spark, tmp_path):
    folder = str(tmp_path / "index")

    def broken(texts):
        raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        I.write_tables(pages(spark, 2), folder, broken, 8)
    assert S.read(spark, folder, "chunks").count() == 2 and "chunk_embeddings" not in S.current(spark, folder).paths
    marks = str(tmp_path / "marks")
    os.mkdir(marks)
    I.write_tables(pages(spark, 2), folder, marked(marks), 8)
    found = S.read(spark, folder, "chunk_embeddings")
    assert found.count() == 2 and found.where("size(embedding) = 8").count() == 2 and len(asked(marks)) == 2


def test_only_new_texts_are_embedded(spark, tmp_path):
    folder, marks = str(tmp_path / "vectors"), str(tmp_path / "marks")
    os.mkdir(marks)
    frame = lambda rows: spark.createDataFrame(rows, "id int, text string, embedding string, content string")
    rows = [(i, f"text {i % 7}", "mine", "mine") for i in range(20)] + [(50, None, "mine", "mine"), (51, "", "mine", "mine")]
    got = V.embed(frame(rows), folder, marked(marks), 8).collect()
    assert asked(marks) == sorted([f"text {i}" for i in range(7)] + [""])
    vector = next(c for c in got[0].asDict() if c not in ("id", "text", "embedding", "content"))
    assert all((r[vector] is None) == (r["text"] is None) and r["embedding"] == "mine" for r in got)
    assert all(abs(a - b) < 1e-6 for r in got if r["text"] for a, b in zip(r[vector], I.fake_embedding(r["text"], 8)))
    # Unchanged texts ask for nothing, others for themselves alone.
    for extra, new in (([], []), ([(60, "text 3", "", "")], []), ([(61, "text 99", "", "")], ["text 99"])):
        again = str(tmp_path / f"marks{len(extra)}{len(new)}")
        os.mkdir(again)
        assert V.embed(frame(rows + extra), folder, marked(again), 8).count() == len(rows + extra)
        assert asked(again) == new
    with pytest.raises(ValueError, match="8 dimensions"):
        V.embed(frame(rows), folder, marked(marks), 16)
    assert V.embed(frame([]), folder, marked(marks), 8).count() == 0


def test_the_bitmap_lets_no_known_text_through(spark):
    texts = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("content"), F.col("id").cast("string").alias("text"))
    store = texts.where("text % 3 = 0").select("content")
    new = V.unknown(texts, store)
    assert sorted(int(r["text"]) for r in new.collect()) == [i for i in range(3000) if i % 3]
    assert V.bitmap(store).count() <= 1 << (V.PLACES - 6)


def test_a_file_that_comes_again_is_stored_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: incremental.store_new_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    stored = lambda: sorted(bytes(r["content"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    for name, content in (("a.pdf", b"one"), ("b.pdf", b"one"), ("c.png", b"two"), ("d.txt", b"three")):
        (tmp_path / "in" / name).write_bytes(content)
    run()
    assert stored() == [b"one", b"two"]
    # Each call is a restart from the checkpoint.
    (tmp_path / "in" / "e.pdf").write_bytes(b"one")
    (tmp_path / "in" / "f.pdf").write_bytes(b"four")
    run()
    assert stored() == [b"four", b"one", b"two"]
    (tmp_path / "in" / "g.png").write_bytes(b"two")
    run()
    assert stored() == [b"four", b"one", b"two"]


def test_measures_follow_corrections(spark, tmp_path):
    rng = random.Random(2)
    schema = "case_id string, version long, measure string, numerator double, denominator double"
    rows = [(f"c{i % 40}", v, rng.choice(["recall", "precision"]), float(rng.randrange(5)), float(rng.randrange(1, 6))) for v, i in enumerate(rng.choices(range(40), k=200))]
    rng.shuffle(rows)  # any order of arrival
    latest = {}
    for part in range(4):
        batch = rows[part * 50 : part * 50 + 50]
        spark.createDataFrame(batch, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        incremental.running_measures(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        for r in batch:
            if r[0] not in latest or r[1] > latest[r[0]][1]:
                latest[r[0]] = r
        want = {}
        for _, _, m, n, d in latest.values():
            old = want.get(m, (0.0, 0.0, 0))
            want[m] = (old[0] + n, old[1] + d, old[2] + 1)
        got = {r["measure"]: (r["numerator"], r["denominator"], r["cases"]) for r in incremental.measures(spark, str(tmp_path / "out")).collect()}
        assert got == want
