"""Papers, reports, types, document answers, study generation and sources on small fixtures."""

import io
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from lectern.functions import research as T
from lectern.operators import document_answers as DA
from lectern.operators import facts, papers
from lectern.operators import profile as X
from lectern.operators import study_generation as G
from lectern.sources import ingest as I
from lectern.sources import providers as P

PAPER = """Journal of Things
Reading Pages With Small Models: a study
of many kinds of pages
A. Smith a,b and C. Jones
ABSTRACT
We propose a small model that reads pages of reports. It works on COCO and MNIST.
METHOD
The encoder attends to visual tokens of each page in turn.
RESULTS
The model achieves higher accuracy than the baseline in all runs. TOP1 81.2 TOP5 95.1
LIMITATIONS
Future work will address the challenges of long pages in detail.
REFERENCES
[1] Smith J, 2020"""
REPORT = """Course Code: CS101 Course Name: Vision Lecturer: Dr Lee Prepared by: Ann Poe Mark 80
Final report
OVERVIEW
This project builds a robot that finds its way.
CONCLUSION
The robot works. Future work could be done on its speed in the dark."""


def test_paper_profile():
    own = X.profile("paper.pdf", [(1, PAPER)])
    assert own["document_type"] == "research_paper" and own["title"] == "Reading Pages With Small Models: a study of many kinds of pages"
    found = {(f["kind"], f["value"]) for f in own["facts"]}
    assert {("dataset", "COCO"), ("dataset", "MNIST"), ("research_contribution", "We propose a small model that reads pages of reports")} <= found
    assert any(k == "research_method" and "encoder" in v for k, v in found) and not any(k == "date" for k, _ in found)
    assert "What methods are used?" in own["suggested_questions"] and "What datasets are mentioned?" in own["suggested_questions"]
    assert own["overview"].startswith("We propose")


def test_report_profile_and_answers():
    own = X.profile("robot_report.pdf", [(1, REPORT)])
    assert own["document_type"] == "academic_report" and own["title"] == "robot report"
    labels = {f["label"]: f["value"] for f in own["facts"] if f["kind"] == "academic_metadata"}
    assert labels == {"Course code": "CS101", "Course name": "Vision", "Lecturer": "Dr Lee", "Prepared by": "Ann Poe"}
    ask = lambda q, i: DA.answer(q, i, "robot_report.pdf", [(1, REPORT)])
    assert ask("Who prepared it?", "authors")["answer"] == "Contributors mentioned: Prepared by: Ann Poe, Lecturer: Dr Lee."
    assert "Future work" in ask("What limitations are discussed?", "limitations")["answer"]
    refused = ask("What is the total due?", "amounts")
    assert refused["status"] == "insufficient_evidence" and "academic report" in refused["reason"]
    assert ask("What is it about?", "overview")["answer"].startswith("This project builds a robot")


def test_paper_answers():
    ask = lambda q, i: DA.answer(q, i, "paper.pdf", [(1, PAPER)])["answer"]
    assert ask("Which data?", "datasets") == "Datasets mentioned: COCO, MNIST."
    assert ask("What methods are used?", "methods").startswith("The encoder attends")
    assert ask("What results are reported?", "results").startswith("The model achieves higher accuracy")
    assert "challenges" in ask("What limitations?", "limitations")
    assert DA.answer("hello", "skills", "paper.pdf", [(1, PAPER)])["status"] == "fall_through"
    assert DA.answer("x", "methods", "a.pdf", [(1, PAPER)], "wrong kind")["reason"] == "wrong kind"


def test_columns_and_python_agree(spark):
    rng = random.Random(7)
    parts = ["Fig.", "TOP1", "81.2", "90.5", "We propose a model", "et al.", "a,b", "Journal of", "✓", "[1]", "in China 200240", "accuracy of the runs", "A B S T R A C T", "co- op", "."]
    texts = [" ".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(250)] + ["", "References: x"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = frame.select("i", T.clean_research(F.col("t")).alias("c"), T.noise_sentence(F.col("t")).alias("n"), T.table_like(F.col("t")).alias("b"), T.prose_sentences(F.col("t")).alias("p")).collect()
    for r in got:
        text = texts[r["i"]]
        assert (r["c"], r["n"], r["b"], r["p"]) == (papers.clean_paper(text), papers.says_nothing(text), papers.table_like(text), papers.sentences(text)), text


def test_types_of_tables_and_documents_agree(spark):
    rng = random.Random(8)
    phrases = [p for t in facts.TYPE_WORDS.values() for p in t] + ["course code", "student id", "lecturer", "api contract"]
    rows = [(i, " ".join(rng.choices(phrases, k=rng.randint(0, 4))), rng.sample(facts.PAPER_HEADINGS + ("REFERENCES", "TOTAL", "PARTIES", "EDUCATION", "FINDINGS"), rng.randint(0, 3))) for i in range(300)]
    docs = spark.createDataFrame([(i, f"f{i}.pdf", t, h) for i, t, h in rows], "d int, f string, t string, h array<string>")
    got = {r["d"]: r["document_type"] for r in facts.document_types(docs, "d", "t", "f", "h").collect()}
    for i, text, headings in rows:
        assert got[i] == X.document_type(f"f{i}.pdf", text, set(headings)), (text, headings)


def test_study_generation(spark):
    pages = spark.createDataFrame([(1, "paper.pdf", 1, PAPER), (2, "empty.pdf", 1, "")], "d int, f string, page_number int, text string")
    got = G.document_questions(pages, "d", "f", 4).collect()
    asked = [r["question"] for r in got if r["d"] == 1]
    assert len(asked) >= 2 and asked[0] == "What is this document about?" and "What are the main topics covered in this document?" not in asked
    assert not [r for r in got if r["d"] == 2]
    assert G.distinct(["What is this document about?", "what is this report about", "What dates are mentioned?", "What dates are mentioned"]) == ["What is this document about?", "What dates are mentioned?"]
    assert not G.useful("What does it say about idx?", "academic_report") and G.useful("What does it say about methods?", "research_paper")
    contexts = spark.createDataFrame([(1, "The model reads 12 pages of many reports. The method counts words of every page."), (2, None)], "d int, context string")
    made = G.generated_questions(contexts, "d", P.LocalText(), 3).collect()
    assert made and all(r["d"] == 1 for r in made)
    excerpts = spark.createDataFrame([(1, "own"), (2, "kept")], "d int, summary string")
    told = {r["d"]: r["summary"] for r in G.generated_summaries(contexts, "d", P.LocalText(), excerpts).collect()}
    assert told == {1: "The model reads 12 pages of many reports. The method counts words of every page.", 2: "kept"}

    class Broken:
        def summarize(self, context, mode):
            raise RuntimeError

        generate_questions = summarize

    assert P.Fallback(Broken()).summarize("One thing. Two things. Three.") == "One thing. Two things." and P.text_provider("none") == P.LocalText()
    old = spark.createDataFrame([(1, "a"), (2, "b")], "d int, question string")
    new = spark.createDataFrame([(1, "a"), (1, "c")], "d int, question string")
    assert sorted(map(tuple, G.saved(old, new, "d", True).collect())) == [(1, "a"), (1, "c"), (2, "b")]
    assert sorted(map(tuple, G.saved(old, new, "d", False).collect())) == [(1, "a"), (1, "c"), (2, "b")]


def test_uploads(spark, tmp_path):
    path = I.save_stream(io.BytesIO(b"x" * 3000), str(tmp_path), "a.PDF", 1, 1024)
    assert os.path.getsize(path) == 3000 and path.endswith(".pdf")
    for name, size in (("a.txt", 1), ("a.png", (1 << 20) + 1)):
        with pytest.raises(ValueError):
            I.save_stream(io.BytesIO(b"x" * size), str(tmp_path), name, 1)
    assert os.listdir(tmp_path) == [os.path.basename(path)]
    stored = I.store_uploads(I.files(spark, str(tmp_path))).collect()
    assert len(stored) == 1 and stored[0]["stored_filename"] == stored[0]["sha256"] + ".pdf" and stored[0]["mime_type"] == "application/pdf"
    listing = spark.createDataFrame([("/b",), ("/c",)], "path string")
    wanted = spark.createDataFrame([(1, ["/a", "/b", "/c"]), (2, ["/z"])], "id int, candidates array<string>")
    assert {r["id"]: r["path"] for r in I.first_existing(wanted, listing, "id").collect()} == {1: "/b", 2: None}


def test_images_and_ocr(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480) + b"rest"
    pages = spark.createDataFrame([(1, 1, bytearray(png))], "document_id int, page_number int, content binary")
    row = I.page_images(pages).first()
    assert (row["width"], row["height"], row["render_dpi"], len(row["checksum"])) == (640, 480, 150, 64)
    newer = I.page_images(pages, 200)
    assert [r["render_dpi"] for r in I.upsert(I.page_images(pages), newer, ["document_id", "page_number"]).collect()] == [200]

    class Reader:
        def is_available(self):
            return True

        def ocr_image(self, image, language):
            word = "\t".join(["0"] * 10 + ["90.5", image.decode()])
            return "header\n" + word if image != b"none" else ""

    images = spark.createDataFrame([("p", 1, bytearray(b"word")), ("p", 2, bytearray(b"none"))], "path string, page_number int, content binary")
    got = I.recognized(images, Reader()).collect()
    assert [(r["page_number"], r["text"], r["confidence"]) for r in got] == [(1, "word", 90.5)]
    native = spark.createDataFrame([("p", 1, ""), ("p", 2, "short"), ("p", 3, "long " * 40)], "path string, page_number int, text string")
    merged = {r["page_number"]: (r["text"], r["text_source"]) for r in I.with_ocr(native, lambda low: images.join(low, ["path", "page_number"]), Reader()).collect()}
    assert merged[1] == ("word", "ocr") and merged[2] == ("short", "native") and merged[3][1] == "native"
    assert P.CommandOcr("no-such-command").ocr_image(b"x", "eng") == "" and len(P.FakeEmbeddings(8).embed_texts(["a"])[0]) == 8


def test_publishing_and_loading(spark, tmp_path):
    runs = spark.createDataFrame([(1, "a", "completed", "t", {"m": 1.0}), (2, "b", "failed", "t", {})], "run_id int, name string, status string, finished_at string, measurements map<string,double>")
    results = spark.createDataFrame([(1, "q", "pass", "correct", 1.0), (1, "r", "fail", None, 2.0), (2, "q", "pass", "correct", 1.0)], "run_id int, question string, status string, human_assessment string, duration_ms double")
    report = I.public_report(runs, results).collect()
    assert [(r["name"], [c["question"] for c in r["cases"]]) for r in report] == [("a", ["q"])]
    I.write_json(I.public_report(runs, results), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    pack = spark.createDataFrame([("a.pdf", "1", "1"), ("b.pdf", "2", "2"), ("x.pdf", "3", "4")], "filename string, sha256 string, expected_sha256 string")
    there = spark.createDataFrame([("1",)], "sha256 string")
    assert [r["filename"] for r in I.to_load(pack, ["a.pdf", "b.pdf"], there).collect()] == ["b.pdf"]
    with pytest.raises(Exception, match="checksum differs"):
        I.to_load(pack, ["x.pdf"], there).collect()
    cases = spark.createDataFrame([(1, "q"), (1, "q"), (2, "q")], "document_id int, question string")
    assert I.missing_cases(cases, cases.limit(1)).count() == 1
    captions = spark.createDataFrame([("p", "Table 1  Parts"), ("p", None), ("p", "absent")], "page_id string, caption string")
    chunks = spark.createDataFrame([("p", "c0", 0, "intro words"), ("p", "c1", 1, "see Table 1 Parts here")], "page_id string, chunk_id string, chunk_index int, chunk string")
    assert {r["caption"]: r["chunk_id"] for r in I.caption_chunks(captions, chunks).collect()} == {"Table 1  Parts": "c1", None: "c0", "absent": None}


def test_golden_cases(spark):
    from lectern.operators import golden
    from lectern.operators.runs import golden_summary

    invoice = "Invoice 9\nBill to: Acme Corp\nDue date 2024-02-03\nTotal due USD 12.00"
    pages = spark.createDataFrame([("paper", "paper.pdf", 1, PAPER), ("invoice", "invoice.pdf", 1, invoice)], "document_key string, filename string, page_number int, text string")
    cases = [
        (1, "paper", "What datasets are mentioned?", "answerable", ["COCO", "mnist"], "datasets", "facts"),
        (2, "invoice", "When is payment due?", "answerable", ["2024-02-03"], "payment_due", "facts"),
        (3, "invoice", "What skills are listed?", "insufficient_evidence", [], "skills", "abstention"),
        (4, "paper", "What methods are used?", "answerable", ["no such term"], "methods", "sections"),
    ]
    frame = spark.createDataFrame(cases, "case_id long, document_key string, question string, expected_status string, expected_terms array<string>, expected_intent string, quality_dimension string")
    got = {r["case_id"]: r for r in golden.evaluate(frame, pages).collect()}
    assert [got[i]["passed"] for i in (1, 2, 3, 4)] == [True, True, True, False] and got[4]["failures"] == ["lacks no such term"]
    summary = golden_summary(golden.evaluate(frame, pages)).first()
    assert (summary["total"], summary["passed"], summary["pass_rate"], summary["quality_dimensions"]["facts"]) == (4, 3, 0.75, 2)


def test_processing_stages(spark):
    from lectern.operators import chunks as C

    rows = [("embedding", 2, 3, 1, 1, None), ("failed", 1, 0, 0, 0, "no text"), ("deferred_ocr", 0, 0, 0, 0, "scan it"), ("uploaded", 0, 0, 0, 0, None), ("indexed", 1, 1, 1, 0, None)]
    docs = spark.createDataFrame(rows, "status string, n_pages int, n_chunks int, n_embedded int, n_ocr_pages int, error_message string")
    got = C.processing_status(docs).collect()
    told = [{x["key"]: (x["status"], x["detail"]) for x in r["stages"]} for r in got]
    assert told[0] == {"upload": ("complete", None), "extract": ("complete", "2 pages"), "ocr": ("complete", "1 OCR page"), "chunk": ("complete", "3 chunks"), "embed": ("active", "1/3 embedded"), "ready": ("pending", None)}
    assert (got[1]["stage"], got[1]["progress"], got[1]["message"], told[1]["failed"]) == ("failed", 33, "no text", ("failed", "no text"))
    assert (got[2]["stage"], got[2]["progress"], got[2]["message"], told[2]["ocr"]) == ("ocr", 40, "scan it", ("failed", "scan it"))
    assert (got[3]["stage"], got[3]["progress"], told[3]["extract"][0]) == ("upload", 10, "pending")
    assert got[4]["progress"] == 100 and {s for s, _ in told[4].values()} == {"complete"}


def test_golden_reading_cases(spark):
    from lectern.operators import golden
    from lectern.operators.runs import golden_summary

    schema = "case_id string, document_key string, question string, quality_dimension string, expected_status string, expected_terms array<string>, expected_likelihood string, expected_sparse int, expected_document_status string"
    none = "insufficient_evidence"
    cases = [
        ("low text", "sparse", "Can this be searched?", "parse_quality", none, ["OCR"], "high", None, None),
        ("image", "image", "Can this scan be searched?", "ocr_readiness", none, ["OCR", "retry"], None, None, "deferred_ocr"),
        ("sparse pages", "sparse", "Does this need OCR?", "ocr_readiness", none, ["OCR"], "high", 2, None),
        ("wrong", "good", "Does this need OCR?", "ocr_readiness", none, ["OCR"], "high", 2, "indexed"),
        ("gone", "absent", "Is it there?", "ocr_readiness", "answerable", [], None, 0, "indexed"),
    ]
    documents = [("sparse", "indexed", None), ("image", "deferred_ocr", "OCR is not installed; install it and retry."), ("good", "indexed", None)]
    pages = [("sparse", 1, "."), ("sparse", 2, ""), ("good", 1, "plenty of readable text " * 10)]
    frame = spark.createDataFrame(cases, schema)
    found = golden.reading(frame, spark.createDataFrame(documents, "document_key string, status string, error_message string"), spark.createDataFrame(pages, "document_key string, page_number int, text string"))
    got = {r["case_id"]: r for r in found.collect()}
    assert [got[c]["failures"] for c in ("low text", "image", "sparse pages")] == [[], [], []]
    assert got["wrong"]["failures"] == ["likelihood is low", "number of sparse pages is 0", "lacks OCR"]
    assert got["gone"]["failures"] == ["document is unknown", "status is insufficient_evidence"]
    assert got["low text"]["quality_reason"].startswith("This PDF has very little extractable text")
    summary = golden_summary(found).first()
    assert (summary["total"], summary["passed"], summary["pass_rate"]) == (5, 3, 0.6)
