"""Operators against small fixtures."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import words as W
from lectern.operators import likeness
from lectern.operators import anchors as Q
from lectern.operators import answers as A
from lectern.operators import chunks as C
from lectern.operators import evaluation as E
from lectern.operators import evidence as V
from lectern.operators import facts as D
from lectern.operators import routing as R
from lectern.operators import search as S
from lectern.operators import sections as P
from lectern.operators import study as T
from lectern.operators import tables as B
from lectern.sources import ingest as I


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, ["string"] * len(values))))
    return row.select(column.alias("x")).first()["x"]


def test_words_fold_forms(spark):
    assert sorted(one(spark, W.matching_words(F.col("t")), t="Removed the removal; published BILLED")) == ["bill", "publish", "remove", "the"]
    assert sorted(one(spark, W.search_words(F.col("t")), t="What is the a b deadline")) == ["deadline"]
    assert sorted(one(spark, W.verifier_words(F.col("t")), t="It was removed, a x")) == ["removed"]


def test_cut_keeps_its_lengths(spark):
    text = "x" * 400
    assert len(one(spark, W.truncated(F.col("t")), t=text)) == 320
    assert len(one(spark, W.page_preview(F.col("t")), t=text)) == 242
    assert one(spark, W.truncated(F.col("t")), t=" a  b ") == "a b"


def test_contents_like(spark):
    text = "Table of contents 1. Overview .... 3"
    assert one(spark, W.contents_like(F.col("t")), t=text) and P.contents_like(text)
    assert not one(spark, W.contents_like(F.col("t")), t="plain text about contents")


def test_windows_keep_the_overlap_tail(spark):
    docs = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(900))), (2, ""), (3, None)], "doc_id long, text string")
    found = C.windows(docs).orderBy("word_start").collect()
    assert [(r["doc_id"], r["word_start"], r["n_words"]) for r in found] == [(1, 0, 900), (1, 780, 120)]
    with pytest.raises(ValueError):
        C.windows(docs, overlap=900)


def test_parse_quality_and_status(spark):
    pages = spark.createDataFrame([("d", "."), ("d", ""), ("e", "x" * 100)], "doc string, text string")
    found = {r["doc"]: r for r in C.parse_quality(pages, "doc").collect()}
    assert found["d"]["low_ratio"] == 1 and found["d"]["scan_likelihood"] == "high" and found["d"]["empty_pages"] == 1
    assert found["e"]["scan_likelihood"] == "low"
    states = [("indexed", 1, 1, "ready", 100), ("embedding", 1, 1, "embed", 80), ("failed", 0, 0, "failed", 0), ("processing", 1, 0, "chunk", 60)]
    docs = spark.createDataFrame([s[:3] for s in states], "status string, n_pages int, n_chunks int")
    assert [(r["stage"], r["progress"]) for r in C.processing_status(docs).collect()] == [s[3:] for s in states]


def test_merge_ocr(spark):
    native = spark.createDataFrame([(1, 1, "a"), (1, 2, ""), (1, 3, "c")], "d int, p int, text string")
    ocr = spark.createDataFrame([(1, 1, "b"), (1, 2, "x")], "d int, p int, text string")
    found = {r["p"]: (r["text"], r["text_source"]) for r in C.merge_ocr(native, ocr, ["d", "p"]).collect()}
    assert found == {1: ("a\nb", "hybrid"), 2: ("x", "ocr"), 3: ("c", "native")}


def test_sections():
    found = P.split("SKILLS\nPython Spark\nEDUCATION:\nBSc")
    assert [(s.heading, s.text) for s in found] == [("SKILLS", "SKILLS Python Spark"), ("EDUCATION", "EDUCATION BSc")]
    assert P.split("A B S T R A C T we study things")[0].heading == "ABSTRACT"
    assert P.alias("3.1. Attention module design") == "METHOD" and P.alias("Figure 3 results") is None
    assert P.split("plain words only")[0].heading is None and P.split("") == []
    assert P.split("intro METHODS we do RESULTS we find")[0].text == "intro"


def test_tables(spark):
    found = B.detect("Table 1 Totals\nName\tQty\tYear\nApple pie\t3\t2020\nbad row here\nNOTES AND REMARKS\nother")
    assert found[0].labels == ["Name", "Qty", "Year"] and found[0].rows == [["Apple pie", "3", "2020"]]
    assert found[0].confidence == "moderate"
    loose = B.detect("Table 2\nDeep learning 2019 ✓\nshort 1")
    assert loose[0].rows == [["Deep learning", "2019", "✓"]] and loose[0].confidence == "low"
    pages = spark.createDataFrame([(1, "Table 2\nDeep learning 2019 x"), (2, "none"), (3, None)], "p int, text string")
    assert [r["text"] for r in B.table_cells(pages, ["p"]).orderBy("column_index").collect()] == ["Deep learning", "2019", "x"]


def test_routing(spark):
    cases = {"Who drank coffee?": "amounts", "Summarize the methods": "overview", "Which datasets?": "datasets", "hello": "evidence_search"}
    for question, intent in cases.items():
        assert one(spark, R.intent(F.col("q")), q=question) == intent
    code = one(spark, R.mismatch(F.col("q"), F.lit("amounts"), F.lit("research_paper")), q="What is the total due?")
    assert code == R.NO_INVOICE_IN_PAPER
    assert one(spark, R.section_score(F.col("q"), F.col("h")), q="Which frameworks are used?", h="technical skills") == 1.0


@pytest.mark.parametrize(
    "question, parts",
    [
        ("What are the methods and results?", ["What are the methods?", "What are the results?"]),
        ("What dataset is used, and how was it collected?", ["What dataset is used?", "How was the dataset collected?"]),
        ('What does "Time, and how it flies" say?', ['What does "Time, and how it flies" say']),
        ("What are the listed apple and pear prices?", ["What are the listed apple prices?", "What are the listed pear prices?"]),
        ("Tell me about the fee", ["the fee"]),
    ],
)
def test_questions_in_parts(question, parts):
    assert list(R.plan(question).parts) == parts


def test_rerank_score(spark):
    row = spark.range(1).select(S.rerank_score(F.lit(0.9), F.lit(1.0), F.lit(1.0)).alias("x"))
    assert row.first()["x"] == pytest.approx(0.925)
    assert S.candidate_limit(5) == 20 and S.candidate_limit(20) == 50


def test_lexical_and_hybrid(spark):
    asked = spark.createDataFrame([(1, "payment deadline")], "q long, question string")
    chunks = spark.createDataFrame([(1, "the payment deadline is near"), (2, "payment"), (3, "none")], "c long, t string")
    found = S.lexical_top(asked, chunks, 5, "q", "question", ["c"], "t").collect()
    assert [(r["c"], r["score"]) for r in found] == [(1, 1.0), (2, 0.5)]
    vectors = spark.createDataFrame([(2, 0.77), (4, 0.1)], "c long, score double").withColumn("q", F.lit(1).cast("long"))
    merged = S.merge_hybrid(vectors, spark.createDataFrame(found), 5, ["q", "c"], "q").collect()
    assert [(r["c"], r["score"], r["lexical_score"]) for r in merged] == [(1, 1.0, 1.0), (2, 0.77, 0.5), (4, 0.1, 0.0)]


def hit(chunk, page, score, text="t", part="p", doc=1):
    return {"part": part, "chunk_id": chunk, "document_id": doc, "page_number": page, "text": text, "score": score, "source_score": score}


def test_evidence_choice():
    hits = [hit(1, 1, 0.9, "a"), hit(2, 1, 0.8, "b"), hit(3, 2, 0.7, "c"), hit(4, 3, 0.6, " A ")]
    taken, refused = V.choose(hits, 2)
    assert taken == [0, 2] and [r for _, r in refused] == ["duplicate text", "page already used"]
    both = [hit(1, 1, 0.9, "a", "x"), hit(2, 2, 0.8, "b", "x"), hit(3, 3, 0.1, "c", "y")]
    assert V.choose(both, 2)[0] == [0, 2]


@pytest.mark.parametrize(
    "answer, supported",
    [
        ("The study kept 2366 records.", True),
        ("The study kept 5000 records.", False),
        ("The study did not keep 2366 records.", False),
        ("Acme kept 2366 records.", False),
    ],
)
def test_sentence_support(spark, answer, supported):
    said = spark.createDataFrame([(1, answer)], "q long, answer string")
    shown = spark.createDataFrame([(1, 7, "We began. The study kept 2366 records after screening.")], "q long, chunk_id long, text string")
    support = V.sentence_support(said, shown, "q", "answer", "text", "chunk_id")
    row = support.first()
    assert (row["supported"], row["chunk_id"]) == (supported, 7 if supported else None)
    assert V.verification(support, "q").first()["status"] == ("verified" if supported else "unsupported")


def evidence(text, chunk=1, score=0.9, heading=None):
    return {"chunk_id": chunk, "text": text, "score": score, "source_score": score, "section_heading": heading}


@pytest.mark.parametrize(
    "question, text, summary",
    [
        ("How many records remained after screening?", "Many records. After screening 2366 records remained.", "After screening 2366 records remained."),
        ("How many records remained after screening?", "After screening the records remained.", None),
        ("When was the guide published?", "The guide was published in 2019.", "The guide was published in 2019."),
        ("When was the guide published?", "The guide mentions 2019.", None),
        ("What is the price of the lamp?", "The chair is fine; the lamp is $20.", "the lamp is $20."),
        ("What are the three modules?", "The three modules: core, data and web.", "The three modules: core, data and web."),
        ("What are the three modules?", "The three modules: core and web.", None),
    ],
)
def test_answers(question, text, summary):
    found = A.grounded_answer(question, [evidence(text)])
    assert found["summary"] == summary
    assert found["status"] == ("answerable" if summary else "insufficient_evidence")


def test_answers_in_spark(spark):
    rows = [(1, "How many records remained?", 5, "There 2366 records remained.", 0.9, 0.9, None)]
    hits = spark.createDataFrame(rows, "q long, question string, chunk_id long, text string, score double, source_score double, section_heading string")
    row = A.answers(hits, "q", "question").first()
    assert row["cited"] == [5] and row["status"] == "answerable"


def test_facts(spark):
    pages = spark.createDataFrame([(1, 1, "Due 2024-01-31, paid 3 March 2023, since 2019. USD 1,200.50 or $5")], "d long, p long, text string")
    assert [r["value"] for r in D.facts(pages, D.DATES, "d", "p", "text").orderBy("place").collect()] == ["2024-01-31", "3 March 2023", "2024", "2023", "2019"]
    assert [r["value"] for r in D.facts(pages, D.AMOUNTS, "d", "p", "text").collect()] == ["USD 1,200.50"]
    docs = spark.createDataFrame([(1, "Invoice. Bill to X. Subtotal"), (2, "nothing"), (3, None), (4, "An API contract")], "d long, t string")
    assert [r["document_type"] for r in D.document_types(docs, "d", "t").orderBy("d").collect()] == ["invoice", "generic", "generic", "generic"]


def test_metrics(spark):
    lists = spark.createDataFrame([(["a"], ["x", "y", "a"], ["a", "b"])], "e array<string>, r array<string>, c array<string>")
    row = lists.select(
        E.hit_rate(F.col("e"), F.col("r"), 2).alias("hit"), E.reciprocal_rank(F.col("e"), F.col("r")).alias("rr"),
        E.citation_accuracy(F.col("e"), F.col("c")).alias("cite"), E.hallucination_risk(F.lit(1), F.lit(0)).alias("risk"),
    ).first()
    assert row["hit"] == 0 and row["rr"] == pytest.approx(1 / 3) and row["cite"] == 0.5 and row["risk"] == 1
    log = spark.createDataFrame([(1, 2), (1, 8), (2, 6)], "q int, rank int")
    found = E.stored_retrieval_metrics(log, "q", "rank").first()
    assert found["hit_rate"] == 0.5 and found["mrr"] == pytest.approx(1 / 3)
    empty = E.stored_retrieval_metrics(log.limit(0), "q", "rank").first()
    assert (empty["hit_rate"], empty["mrr"]) == (0, 0)
    sums = spark.createDataFrame([("m", 1, 1), ("m", 0, 3), ("n", 0, 0)], "k string, numerator int, denominator int")
    assert {r["k"]: r["value"] for r in E.ratios_of_sums(sums, ["k"]).collect()} == {"m": 0.25, "n": None}


@pytest.mark.parametrize(
    "answer, pattern, says",
    [
        ("It kept 2,366 records.", "2366 records", True),
        ("It kept records. There were 2366.", "2366 records", False),
        ("It did not keep 5 records.", "keep 5 records", False),
        ("It isn't 5.", "not 5", True),
        ("p < 0.05", "p > 0.05", False),
        ("The change was -3.", "3", False),
    ],
)
def test_facts_said(spark, answer, pattern, says):
    assert one(spark, E.says(F.col("a"), F.col("p")), a=answer, p=pattern) is says


def test_anchors(spark):
    assert E.join_sources(["one two three", "two three four"]) == "one two three four"
    hits = spark.createDataFrame([(1, 1, 0, "one two three"), (1, 1, 1, "three four")], "case long, page_number int, chunk_index int, text string")
    anchors = spark.createDataFrame([(1, 1, "two three four"), (1, 2, "x")], "case long, page_number int, quote string")
    found = {r["quote"]: (r["covered"], r["chunk_indexes"]) for r in Q.coverage(hits, anchors, ["case"]).collect()}
    assert found == {"two three four": (True, [0, 1]), "x": (False, [])}


def test_study(spark):
    pairs = spark.createDataFrame([("gradient descent works", "descent"), ("", "x")], "e string, g string")
    first, second = T.grade(pairs, "e", "g").collect()
    assert first["score"] == pytest.approx(1 / 3) and first["missing"] == ["gradient", "works"] and first["band"] == "needs work"
    assert second["n_expected"] == 0
    asked = spark.createDataFrame([(1, 1, "What methods apply?"), (1, 2, "what methods apply"), (1, 3, "Who wrote it?")], "d int, n int, q string")
    assert [r["n"] for r in likeness.distinct_questions(asked, "d", "n", "q").orderBy("n").collect()] == [1, 3]
    docs = spark.createDataFrame([(1, "Page 1\nWe use datasets here. It works. More."), (2, "")], "d int, t string")
    sums = {r["d"]: r["summary"] for r in T.summarize(docs, "t").collect()}
    assert sums[1] == "We use datasets here. It works." and sums[2].startswith("No usable")
    found = T.study_questions(docs, "d", "t", 2).where("d = 1").orderBy("number").collect()
    assert found[0]["question"] == "What does the document say about datasets?" and len(found) == 2


def test_ingest(spark, tmp_path):
    listed = spark.createDataFrame([("a.PDF", 5), ("notes.txt", 5), ("b.png", 21 * 2**20)], "path string, length long")
    assert [r["reason"] for r in I.validate(listed).collect()] == [None, "unsupported type", "too large"]
    (tmp_path / "a.pdf").write_bytes(b"one\x0ctwo")
    found = I.files(spark, str(tmp_path), "*.pdf")
    rows = I.pages(found, lambda path, raw: [(t, 1.0, None) for t in raw.decode().split("\f")]).orderBy("page_number").collect()
    assert [(r["page_number"], r["text"]) for r in rows] == [(1, "one"), (2, "two")]

    def broken(path, raw):
        raise RuntimeError("cannot read")

    assert I.pages(found, broken).first()["error"] == "cannot read"
    table = "level\t" + "\t".join("x" * 11) + "\n" + "\t".join(["5"] + ["0"] * 9 + ["92.5", "word"]) + "\n" + "\t".join(["5"] + ["0"] * 9 + ["-1", " "])
    row = spark.createDataFrame([(table,)], "t string").select(I.parse_ocr_table(F.col("t")).alias("x")).first()["x"]
    assert (row["text"], row["confidence"]) == ("word", 92.5)
    vector = I.fake_embedding("x", 16)
    assert vector == I.fake_embedding("x", 16) and sum(v * v for v in vector) == pytest.approx(1)


def test_streaming(spark, tmp_path):
    from lectern.streaming.incremental import index_new_documents

    docs = spark.createDataFrame([(1, "four usable words stand here plainly")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    for expected in (1, 2):
        index_new_documents(spark, str(tmp_path / "in"), docs.schema, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == expected
        docs.withColumn("doc_id", F.lit(2).cast("long")).write.mode("append").parquet(str(tmp_path / "in"))


def test_profile(spark):
    from lectern.operators import profile as X

    text = "Invoice 7\nBill to: Acme Corp\nIssue date 2024-01-05\nPAYMENT TERMS\nnet 30 days\nTotal due USD 1,200.00\n18% tax"
    pages = spark.createDataFrame([(1, "a.pdf", 1, text), (2, "b.pdf", 1, ""), (3, "c.pdf", 1, None)], "d long, f string, page_number int, text string")
    got = {r["d"]: r for r in X.profiles(pages, "d", "f").collect()}
    one = got[1]
    assert one["document_type"] == "invoice" and one["title"] == "Invoice 7"
    facts = {(f["kind"], f["value"]): f["label"] for f in one["facts"]}
    assert facts["date", "2024-01-05"] == "Issue date" and facts["amount", "USD 1,200.00"] == "Total due" and ("date", "2024") in facts
    assert "What total amount is due?" in one["suggested_questions"] and "What payment terms are mentioned?" in one["suggested_questions"]
    assert ("PAYMENT TERMS", 1) in {(s["heading"], s["page_number"]) for s in one["sections"]}
    assert got[2]["document_type"] == "generic" and got[3]["title"] is None
    assert X.label("tax total due ", 14, X.AMOUNT_LABELS, "Amount") == "Total due"
    assert X.document_type("", "the api contract of the interface", set()) == "generic"


def test_verified_answers(spark):
    rows = [
        (1, "How many records remained, and when was the guide published?", 1, 5, "There 2366 records remained.", 0.9, 0.9, None),
        (1, "How many records remained, and when was the guide published?", 2, 6, "The guide was published in 2019.", 0.8, 0.8, None),
        (2, "How many records remained, and when was the guide published?", 1, 5, "There 2366 records remained.", 0.9, 0.9, None),
    ]
    packs = spark.createDataFrame(rows, "q long, question string, place int, chunk_id long, text string, score double, source_score double, section_heading string")
    got = {r["q"]: r for r in A.verified_answers(packs, "q", "question").collect()}
    assert got[1]["answer"] == "There 2366 records remained. The guide was published in 2019." and got[1]["cited"] == [5, 6]
    assert got[1]["status"] == "answerable" and got[1]["risk"] == 0
    assert got[2]["status"] == "insufficient_evidence" and got[2]["answer"] is None


def test_case_scores(spark):
    fields = "case_id long, negative boolean, answered boolean, facts_said int, n_facts int, anchors_recalled int, anchors_cited int, anchors_packed int, n_anchors int, right_citations int, n_citations int, sentences_verified int, n_sentences int, duration_ms double"
    cases = spark.createDataFrame([(1, False, True, 1, 1, 1, 1, 1, 1, 2, 2, 1, 1, 5.0), (2, True, False, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 7.0), (3, False, True, 0, 3, 1, 1, 1, 1, 1, 2, 1, 1, 1.0)], fields)
    scores = E.case_scores(cases)
    total = {r["metric"]: (r["numerator"], r["denominator"], r["value"]) for r in E.ratios_of_sums(scores, ["metric"]).collect()}
    assert total["fact_match"] == (1, 4, 0.25) and total["abstention_match"] == (1, 1, 1.0) and total["latency"][2] == pytest.approx(13 / 3)
    verdicts = {r["case_id"]: (r["passed"], r["failed"]) for r in E.case_verdicts(scores, cases).collect()}
    assert verdicts == {1: (True, []), 2: (True, []), 3: (False, ["citation_precision", "fact_match"])}
    row = spark.range(1).select(E.readiness(F.lit(True), F.lit(True), F.lit(False)).alias("a"), E.readiness(F.lit(None).cast("boolean"), F.lit(True)).alias("b")).first()
    assert (row["a"], row["b"]) == ("stale", "unavailable")


@pytest.mark.parametrize(
    "question, intent, text, answer",
    [
        ("When is payment due?", "payment_due", "Invoice 1\nDue date 2024-02-03\nIssue date 2024-01-01", "Dates mentioned: Due date: 2024-02-03, Due date: 2024."),
        ("What is the total due?", "amounts", "Subtotal USD 5.00 then the total due USD 7.00", "Amounts and metrics mentioned: Total due: USD 7.00."),
        ("Which datasets?", "datasets", "We use COCO and MNIST.", "Datasets mentioned: COCO, MNIST."),
        ("What methods are used?", "methods", "METHODS\nWe count the words of every page.\nRESULTS\nMany.", "We count the words of every page."),
        ("Which datasets?", "datasets", "Nothing here.", None),
    ],
)
def test_document_answers(question, intent, text, answer):
    from lectern.operators.document_answers import answer as find

    found = find(question, intent, "a.pdf", [(1, text)])
    assert found["answer"] == answer and found["status"] == ("answerable" if answer else "insufficient_evidence")


def test_document_answers_in_spark(spark):
    from lectern.operators.document_answers import document_answers

    rows = [(1, "When is payment due?", "payment_due", "a.pdf", 2, "Due date 2024-02-03"), (1, "When is payment due?", "payment_due", "a.pdf", 1, None), (2, "hello", "evidence_search", None, 1, "x")]
    asked = spark.createDataFrame(rows, "q long, question string, intent string, filename string, page_number int, text string")
    assert {r["q"]: r["status"] for r in document_answers(asked, "q").collect()} == {1: "answerable", 2: "fall_through"}
