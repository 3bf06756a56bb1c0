"""Questions from end to end on a small corpus."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import execution as X
from lectern.operators import search as S

CHUNKS = [
    (11, 1, 1, 0, "PAYMENT TERMS", "The payment deadline is 30 June 2024. Late payment costs USD 50.00."),
    (12, 1, 2, 1, None, "The supplier delivers forty chairs and tables to the warehouse."),
    (21, 2, 1, 0, None, "The payment deadline of this agreement is 1 May 2023."),
    (22, 2, 1, 1, "METHOD", "We trained the encoder with labelled pages."),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id long, document_id long, page_number int, chunk_index int, section_heading string, text string")


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "qid long, question string, document_id long")


def test_standard_answers(spark, chunks):
    docs = spark.createDataFrame([(1, "indexed", None), (2, "indexed", None), (3, "deferred_ocr", "Scan first."), (4, "failed", None)], "document_id long, status string, error_message string")
    questions = asked(spark, (1, "When is the payment deadline?", 1), (2, "When is the payment deadline?", 2), (3, "What colour is the moon?", None), (4, "When is payment due?", 3), (5, "When is payment due?", 4))
    done = X.execute(questions, chunks, docs=docs)
    got = {r["qid"]: r for r in done.answers.collect()}
    assert "30 June 2024" in got[1]["answer"] and got[1]["cited"] == [11] and got[1]["retrieval_mode"] == "lexical"
    assert "1 May 2023" in got[2]["answer"] and got[2]["cited"] == [21]
    assert (got[3]["status"], got[3]["answer"], got[3]["answer_evidence_count"]) == ("insufficient_evidence", None, 0)
    assert got[4]["reason"] == "Scan first." and got[5]["reason"].startswith("Document indexing failed.")
    assert got[4]["rejected_reasons"] == [X.NOTHING_PASSED]
    shown = [(r["qid"], r["chunk_id"], r["role"]) for r in done.hits.orderBy("qid", "shown_at").collect()]
    assert shown[0] == (1, 11, "answer") and (2, 21, "answer") in shown
    assert all(r["document_page_url"].startswith("/documents/") for r in done.hits.collect())


def test_verified_answers_of_parts(spark, chunks):
    questions = asked(spark, (1, "When is the payment deadline, and how many chairs does the supplier deliver?", 1), (2, "What is the capital of France?", None))
    done = X.execute(questions, chunks, verified=True)
    got = {r["qid"]: r for r in done.answers.collect()}
    assert got[2]["status"] == "insufficient_evidence" and got[2]["answer"] is None
    assert {r["part"] for r in done.candidates.collect() if r["qid"] == 1} == set(X.R.plan(questions.first()["question"]).parts)
    assert done.packs.where("qid = 1 and place is not null").count() >= 1
    assert got[1]["status"] in ("answerable", "insufficient_evidence")


def test_known_answers_and_vectors(spark, chunks):
    vectors = spark.createDataFrame([(11, [1.0, 0.0]), (22, [0.0, 1.0])], "chunk_id long, embedding array<double>")

    def by_vector(parts, k):
        questions = parts.select("key", F.array(F.lit(0.0), F.lit(1.0)).alias("embedding"))
        return S.vector_top(questions, vectors, k, "key", "chunk_id")

    known = spark.createDataFrame([(1, "answerable", "From the facts.", [12]), (2, "fall_through", None, [])], "qid long, status string, answer string, cited array<long>")
    questions = asked(spark, (1, "When is the payment deadline?", None), (2, "When is the payment deadline?", None))
    done = X.execute(questions, chunks, vector_search=by_vector, known=known)
    got = {r["qid"]: r for r in done.answers.collect()}
    assert got[1]["answer"] == "From the facts." and got[2]["cited"][0] in (11, 21)
    assert {r["retrieval_mode"] for r in got.values()} == {"hybrid"}
    first = done.hits.where("qid = 1").orderBy("shown_at").first()
    assert (first["chunk_id"], first["role"], first["score"]) == (12, "answer", 1.0)
    assert 22 in {r["chunk_id"] for r in done.candidates.where("qid = 2").collect()}
