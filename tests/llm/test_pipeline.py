import os
import random

import pytest

import corpus_pipeline
from lectern.llm import copies, quality, secrets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen.append((name, before, docs))
        if name != "best_fit_packing":
            assert docs.columns == columns
    by_name = {n: (a, b) for n, a, b in seen}
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    a, b = by_name["quality_rules"]
    assert ids(b) == {r["doc_id"] for r in quality.quality(a).where("kept").collect()}
    a, b = by_name["simhash_near_dedup"]
    # Stages on word shingles take five words and a similarity of 0.8, not the contract of the query on fingerprints.
    assert ids(b) == {r["component_id"] for r in copies.edited_copies(a).collect()} and b.count() == len(ids(b))
    a, b = by_name["secret_scan"]
    assert ids(a) == ids(b) and all(r["n_chars"] == len(r["text"]) for r in b.collect())
    assert all(not r["secrets"] for r in secrets.scan(b, secrets.BASE).collect())
    a, b = by_name["best_fit_packing"]
    assert ids(a) == ids(b)


def test_run_and_registration(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_empty(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    rng = random.Random(4)
    words = ["".join(rng.choices("etaoinshrdlucmfwypvbgkjqxz", k=rng.randint(2, 7))) for _ in range(300)]
    prose = [" ".join(rng.choices(words, k=120)) for _ in range(6)]
    long = " ".join(rng.choices(words, k=30_000))
    copy = prose[0].replace(prose[0].split()[50], "other", 1)
    rows = [(0, prose[0]), (1, copy), (2, prose[1]), (2, prose[1]), (3, None), (4, ""), (5, "12 34"), (6, "token: abcdefgh12345 " + prose[2])]
    rows += [(7, long), (8, "a b c " * 100), (None, prose[3]), (None, None), (9, prose[4].upper()), (10, prose[4]), (11, "".join(rng.sample(long, 5000)))]
    rows = [(k, t, None if k == 11 else "en", "s", len(t or ""), "mine", 1, 2, 3, 4) for k, t in rows]
    names = "doc_id long, text string, lang string, source string, n_chars int, score string, lang_pred int, secrets int, q_text int, node int"
    docs = spark.createDataFrame(rows, names)
    out, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, out, str(tmp_path)).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns == columns and dict(out.dtypes) == dict(docs.dtypes), name
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(got) and set(got) == {0, 2, 6, 7, 9, None}
    assert all((r["score"], r["lang_pred"], r["secrets"], r["q_text"], r["node"]) == ("mine", 1, 2, 3, 4) for r in got.values())
    assert "abcdefgh12345" not in got[6]["text"] and got[7]["text"] == long
    packed = corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(got)


def test_copies_with_null_or_shared_ids_go(spark, tmp_path):
    rng = random.Random(5)
    text = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(4)]
    near = lambda t, i: t.replace(t.split()[i], "other", 1)
    cases = [
        ([(None, text[0]), (5, text[0]), (None, text[1])], [(5, text[0]), (None, text[1])]),
        ([(3, text[0]), (7, text[0]), (7, text[1])], [(3, text[0]), (7, text[1])]),
        ([(None, text[0]), (None, near(text[0], 9))], None),
        ([(7, text[0]), (7, near(text[0], 9)), (9, near(text[0], 30)), (9, text[2]), (9, text[2])], None),
    ]
    for rows, want in cases:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()]
        if want is not None:
            assert sorted(got, key=str) == sorted(want, key=str)
        else:
            # One row of each group, whatever is null or shared.
            assert len(got) == len({t for _, t in rows if t in text}) and set(got) <= set(rows)


CLASHING = "k own same n keys node pos key part component_id first_id text_hash g_key g_text good_key good_text q_lang q_source f_lang f_source row t ratio bucket found candidate rule_bits gram rules secrets_ __found __words total least component term docs vector cluster told"


def test_internal_names_as_extra_columns(spark, tmp_path):
    from lectern.llm import pii, secrets

    rows = [(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(70)) + " token=abcdefgh1 4111 1111 1111 1111", "en", "s") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    docs = docs.select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASHING.split()])
    outs = [quality.filter_quality(docs), corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)), corpus_pipeline.mask_secrets(spark, docs, str(tmp_path))]
    outs += [corpus_pipeline.identify_language(spark, docs, str(tmp_path))]
    for out in outs:
        assert out.columns == docs.columns
        assert all(r[c] == f"mine {c}" for r in out.collect() for c in CLASHING.split())
    for out in (quality.quality(docs), pii.pseudonymize(docs, pii.Pseudonyms(key="s")), secrets.scan(docs)):
        found = out.collect()
        assert len(found) == 4 and all(r[c] == f"mine {c}" for r in found for c in CLASHING.split())
