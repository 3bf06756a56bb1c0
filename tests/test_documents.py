"""Read models, runs, research text, sections and summaries on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import research as T
from lectern.functions import words as W
from lectern.operators import anchors as Q
from lectern.operators import chunks as C
from lectern.operators import ranking as K
from lectern.operators import reading as D
from lectern.operators import runs as N
from lectern.operators import search as S
from lectern.operators import section_answers as A
from lectern.operators import summaries as M


def values(spark, texts, column):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column(F.col("t")).alias("x"))
    return [r["x"] for r in frame.orderBy("i").collect()]


def test_headings_and_cleaning(spark):
    texts = ["A B S T R A C T We do", "a b c d plain", "E X E C U T I V E S U M M A R Y of it", None, "co- operate and e-mail"]
    assert values(spark, texts, T.tidied) == ["ABSTRACT We do", "a b c d plain", "EXECUTIVE SUMMARY of it", "", "co- operate and e-mail"]
    assert values(spark, texts[-1:], T.cleaned) == ["cooperate and e-mail"]
    paper = "Received 1 May 2020 All rights are reserved by us. Technical paper We study it."
    assert values(spark, [paper], T.clean_research) == ["We study it."]


def test_headings_are_taken_off_once(spark):
    rows = [("RESULTS: it works", "RESULTS"), ("RESULTS", "RESULTS"), ("in short RESULTS - it works", "RESULTS"), ("plain", None), ("R&D plan", "R&D")]
    got = spark.createDataFrame(rows, "t string, h string").select(T.strip_heading(F.col("t"), F.col("h")), T.after_heading(F.col("t"), F.col("h"))).collect()
    assert [tuple(r) for r in got] == [
        ("it works", "it works"), ("RESULTS", ""), ("in short RESULTS - it works", "it works"), ("plain", "plain"), ("plan", "plan"),
    ]


def test_sentences_that_say_something(spark):
    said = "We propose a model that reads pages. TOP1 81.2 90.5 77.3 66.1. See Fig. 3 for what the model reads here. Smith J, 2020 said a few more words. Keywords: pages"
    assert values(spark, [said], T.prose_sentences) == [["We propose a model that reads pages.", "See Fig. 3 for what the model reads here."]]
    flags = values(spark, ["Journal of Things", "", "We read pages", "School of Art"], T.noise_line)
    assert flags == [True, True, False, True]
    numbers = [("4.0", "in industry ", " now"), ("81", "was ", " percent"), ("7", "the ", " of"), ("1234", "doi ", ""), ("200240", "", " China"), ("1999", "in ", "")]
    frame = spark.createDataFrame(numbers, "v string, a string, b string").select(T.noise_number(F.col("v"), F.col("a"), F.col("b")).alias("x"))
    assert [r["x"] for r in frame.collect()] == [True, False, True, True, True, True]


def test_generated_text_gates(spark):
    texts = ["The model reads pages of many reports well", "Too short", "The model reads many pages and", "ACM Computing Surveys 1 2 3 4 5 volume of papers listed here"]
    assert values(spark, texts, T.meaningful_answer) == [True, False, False, False]
    pair = spark.createDataFrame([("It read 2,366 pages of reports", "2366 pages"), ("It read 5,000 pages of reports", "2366 pages")], "a string, c string")
    assert [r[0] for r in pair.select(T.unsupported_numbers(F.col("a"), F.col("c"))).collect()] == [False, True]
    strict = pair.select(T.supported_answer(F.col("a"), F.col("c"), strict=True).alias("x")).collect()
    assert [r["x"] for r in strict] == [True, False]
    assert values(spark, ["1.2 Overview & Objective: 3. Design Approach the plan"], T.unlabelled) == ["the plan"]
    assert values(spark, ['```json\n{"a": [1]}\n```', 'so: [1, 2] done', "none"], T.json_part) == ['{"a": [1]}', "[1, 2]", "none"]
    lists = spark.createDataFrame([(["a"],), (["a", "b"],), (["a", "b", "c"],), ([],)], "p array<string>").select(T.listed(F.col("p")).alias("x"))
    assert [r["x"] for r in lists.collect()] == ["a", "a and b", "a, b, and c", ""]


def test_windows_are_numbered_in_place(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choices("abcde1 .", k=6)) for _ in range(rng.randint(0, 60)))) for i in range(30)] + [(99, None), (100, "  ")]
    got = C.chunks(spark.createDataFrame(rows, "doc_id long, text string"), size=10, overlap=3)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r["doc_id"], r["chunk_index"])):
        found.setdefault(r["doc_id"], []).append((r["chunk_index"], r["word_start"], r["chunk"]))
    for i, text in rows:
        words, want = (text or "").split(), []
        for at in range(0, len(words), 7):
            chunk = " ".join(words[at : at + 10])
            import re

            if len(re.findall("[A-Za-z0-9]+", chunk)) >= 4 and len(re.findall("[A-Za-z]", chunk)) >= 16:
                want.append((len(want), at, chunk))
        assert found.get(i, []) == want
    with pytest.raises(ValueError):
        C.windows(got, "chunk", "doc_id", 5, 5)


def test_picking_rows(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 2), ("b", 4, 0), ("b", 5, -1), ("c", 6, 1)], "g string, i int, s int")
    ids = lambda f: sorted(r["i"] for r in f.collect())
    assert ids(K.ties_with_best(rows, ["g"], "s", [F.col("i")])) == [1, 2, 4, 5, 6]
    assert ids(K.near_best(rows, ["g"], "s")) == [1, 2, 4, 5, 6] and ids(K.near_best(rows, ["g"], "s", 3)) == [1, 2, 3, 4, 5, 6]
    assert ids(K.latest(rows, ["g"], "s", "i")) == [2, 4, 6]
    recent = {r["g"]: (r["n"], r["recent"]) for r in K.recent(rows, ["g"], "i", "i", most=2).collect()}
    assert recent == {"a": (3, [3, 2]), "b": (2, [5, 4]), "c": (1, [6])}
    whole = K.ordered_union([rows.where("i in (2, 6)"), rows], ["i"], ["s"])
    assert ids(whole) == [1, 2, 3, 4, 5, 6]
    assert {(r["i"], r["role"]) for r in K.split_cited(rows, rows.where("s = 5"), ["i"]).collect() if r["g"] == "a"} == {(1, "answer"), (2, "answer"), (3, "related")}


def test_answer_evidence_comes_first(spark):
    hits = spark.createDataFrame([(1, "x", "tx", 0.9, 1), (1, "y", "ty", 0.8, 2)], "qid int, chunk_id string, text string, score double, place int")
    cited = spark.createDataFrame([(1, "z", 1), (1, "y", 2), (1, "gone", 3)], "qid int, chunk_id string, place int")
    chunks = spark.createDataFrame([("z", "tz"), ("y", "ty")], "chunk_id string, text string")
    got = K.cited_first(hits, cited, chunks, ["qid"], "chunk_id").orderBy("shown_at").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [("z", 1.0), ("y", 0.8), ("x", 0.9)]


def test_read_models(spark):
    pages = spark.createDataFrame([(1, 1, "words here", "native", None, 100.0, 50.0), (1, 2, " ", "ocr", 60.0, None, 50.0), (1, 3, "more", "hybrid", None, 0.0, 1.0)], "d int, p int, text string, text_source string, ocr_confidence double, width double, height double")
    chunks = spark.createDataFrame([(1, 1, 7), (1, 3, 5)], "d int, p int, token_estimate long")
    got = [(r["processing_status"], r["needs_review"], r["text_density"], r["token_estimate"]) for r in D.page_reads(pages, chunks, ["d", "p"]).orderBy("p").collect()]
    assert got == [("native_text", False, 2.0, 7), ("ocr_weak", True, 0.0, 0), ("missing_text", True, 0.0, 5)]
    docs = spark.createDataFrame([("indexed", ["a", "b"]), ("failed", [])], "status string, warnings array<string>")
    assert tuple(D.dashboard(docs).first()) == (1, 2)
    facts = spark.createDataFrame([(1, "Date", "May 1", 1), (1, "date", "may  1", 2), (1, "Date", "May 2", 3)], "d int, label string, value string, n int")
    assert sorted(r["n"] for r in D.unique_facts(facts, "d", "n").collect()) == [1, 3]
    results = spark.createDataFrame([("pass", None), ("fail", "correct"), ("error", "needs_review"), ("unavailable", "correct")], "status string, human_assessment string")
    assert [D.result_filter(results, x).count() for x in ("All", "Failed", "Unavailable", "Errors", "Needs review")] == [4, 1, 1, 1, 2]
    items = spark.createDataFrame([(1, 1, 1, 0.5), (1, 1, 1, 0.7), (1, 1, 2, 0.9)], "qid int, document_id int, page_number int, support double")
    assert tuple(D.pack_stats(items, ["qid"]).first()) == (1, 3, 2, 0.7)
    badge = spark.createDataFrame([("high", 0), ("low", 2), ("medium", 0), ("low", 0)], "l string, n int").select(D.quality_badge(F.col("l"), F.col("n")).alias("x"))
    assert [r["x"] for r in badge.collect()] == ["Needs OCR", "OCR text", "Sparse text", "Text ready"]
    assert D.full_text(pages, "d", "p").first()["text"] == "words here\n \nmore"


def test_parse_quality_in_full(spark):
    rows = [(1, "x" * 100, "native", None, None), (1, "y" * 30, "ocr", 91.0, 15), (1, "z" * 90, "hybrid", 81.0, 25), (2, ".", "native", None, None), (2, "", "native", None, None)]
    got = {r["d"]: r for r in C.parse_quality(spark.createDataFrame(rows, "d int, text string, text_source string, ocr_confidence double, ocr_duration_ms int"), "d").collect()}
    one, two = got[1], got[2]
    assert (one["native_pages"], one["ocr_pages"], one["hybrid_pages"], one["ocr_confidence"], one["ocr_duration_ms"]) == (1, 1, 1, 86.0, 40)
    assert (two["low_ratio"], two["scan_likelihood"], two["ocr_confidence"], len(two["warnings"]), two["empty_pages"]) == (1.0, "high", None, 1, 1)


def test_runs(spark):
    runs = spark.createDataFrame([(1, "queued"), (2, "queued"), (3, "running"), (4, "completed")], "run_id int, status string")
    events = spark.createDataFrame([(1, 1, "start"), (1, 2, "cancel"), (1, 3, "finish"), (2, 1, "finish"), (4, 1, "fail")], "run_id int, seq int, event string")
    assert {r["run_id"]: r["status"] for r in N.replay(runs, events).collect()} == {1: "cancelled", 2: "queued", 3: "running", 4: "completed"}
    stopped = N.interrupted(runs.withColumn("error", F.lit(None).cast("string"))).collect()
    assert {r["run_id"]: (r["status"], r["error"] is None) for r in stopped} == {1: ("interrupted", False), 2: ("interrupted", False), 3: ("interrupted", False), 4: ("completed", True)}
    assert not N.free_slot(runs).first()["free"] and N.free_slot(runs.where("run_id = 4")).first()["free"]
    step = runs.select(N.next_case(F.col("status"), F.col("run_id") == 3, F.lit(1), F.lit(1)).alias("x"))
    assert [r["x"] for r in step.collect()] == ["stop", "stop", "cancel", "stop"]


def test_cases(spark):
    chunks = [(0, "alpha beta gamma"), (1, "gamma delta"), (2, "delta epsilon")]
    anchors = spark.createDataFrame([(1, 1, "gamma delta epsilon"), (1, 2, "x"), (2, 1, "y")], "document_id int, page_number int, quote string")
    held = spark.createDataFrame([(1, 1, i, t) for i, t in chunks], "document_id int, page_number int, chunk_index int, text string")
    got = {(r["document_id"], r["page_number"]): r["chunk_indexes"] for r in Q.resolve(anchors, held).collect()}
    assert got == {(1, 1): [1, 2], (1, 2): [], (2, 1): []}
    base = dict(document_status="indexed", has_file=True, review_state="reviewed", n_pages=1, fresh=True, unresolved=0, has_chunks=True)
    cases = [base, base | {"document_status": None}, base | {"has_file": False}, base | {"review_state": "draft"}, base | {"fresh": False}, base | {"unresolved": 2}, base | {"has_chunks": False}]
    schema = "document_status string, has_file boolean, review_state string, n_pages int, fresh boolean, unresolved int, has_chunks boolean"
    frame = spark.createDataFrame([tuple(c.values()) for c in cases], schema)
    assert [r["availability"] for r in N.readiness(frame).collect()] == ["ready", "unavailable", "unavailable", "draft", "stale", "stale", "unavailable"]
    asked = spark.createDataFrame([(False, 1, 1, None, 1, 1), (False, 0, 1, None, 1, 1), (True, 0, 0, " ", 1, 1), (True, 0, 0, "why", 1, 1), (False, 1, 1, None, 2, 1)], "negative boolean, n_facts int, n_anchors int, review_rationale string, content_version int, asked_version int")
    assert [r["refusal"] is None for r in N.review_refusal(asked).collect()] == [True, False, False, True, False]
    trace = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, n int")
    assert sorted(r["chunk_id"] for r in N.cited_hits(trace.where("n = 1").union(spark.createDataFrame([("q", 9)], "chunk_id string, n int")), trace, trace, ["chunk_id"]).collect()) == ["a"]
    assert N.with_chunks(spark.createDataFrame([(1,), (9,)], "document_id int"), held).count() == 1


CHUNKS = [
    ("d", 1, 0, None, "Opening words of the paper that says what it is."), ("d", 1, 1, "METHOD", "METHOD We train a model. The encoder reads the pages."),
    ("d", 2, 2, None, "It goes on with the encoder and its layers."), ("d", 2, 3, "RESULTS", "RESULTS The model improves accuracy. It shows results."),
    ("d", 3, 4, "REFERENCES", "REFERENCES [1] A method"), ("d", 3, 5, None, "[2] another method of theirs"),
]


def chunk_table(spark):
    return spark.createDataFrame(CHUNKS, "document_id string, page_number int, chunk_index int, heading string, text string")


def test_sections_serve_questions(spark):
    def found(follow, prefer, headings, terms):
        asked = spark.createDataFrame([(1, "d", headings, terms, prefer, False, follow)], "qid int, document_id string, headings array<string>, terms array<string>, prefer_headings boolean, skip_tables boolean, follow boolean")
        return A.matching_chunks(asked, chunk_table(spark))

    order = lambda f: [r["chunk_index"] for r in f.orderBy("place").collect()]
    assert order(found(False, False, ["METHOD"], ["method"])) == [1, 5]
    assert order(found(True, True, ["METHOD"], ["model"])) == [1, 2]
    assert order(found(True, False, ["METHOD"], ["model"])) == [1, 2, 3]
    assert order(found(True, True, ["NONE"], ["encoder"])) == [1, 2]
    result = A.claim_score(F.col("text"), F.col("heading"), F.lit("results"), ["limitation"], r"future")
    best = A.best_claims(found(False, False, ["RESULTS"], ["the"]), result)
    assert order(best) == [3]
    told = A.answers(best, A.passage(T.strip_heading(F.col("text"), F.col("heading")), F.lit("does accuracy improve"))).first()
    assert (told["answer"], told["cited"]) == ("The model improves accuracy.", [3])
    assert order(A.opening_chunks(chunk_table(spark))) == [0, 1, 2]
    facts = spark.createDataFrame([("d", "ENCODER"), ("d", "absent")], "document_id string, value string")
    assert [(r["value"], r["chunk_index"]) for r in A.chunk_of_facts(facts, chunk_table(spark)).collect()] == [("ENCODER", 1)]
    assert sorted(r["chunk_index"] for r in A.chunks_with_values(facts, chunk_table(spark)).collect()) == [1, 2]


def test_summaries(spark):
    chunks = chunk_table(spark)
    order = lambda f: [r["chunk_index"] for r in f.orderBy("place").collect()]
    assert order(M.ranked(chunks, "document_id", 3)) == [1, 3, 0] and order(M.balanced(chunks, "document_id", 3)) == [1, 3, 0]
    assert order(M.retrieved(chunks, "what the encoder reads", "document_id", 2)) == [1, 2]
    assert order(M.retrieved(chunks, "nothing shared whatsoever", "document_id", 2)) == [1, 3]
    got = M.summaries(M.ranked(chunks, "document_id", 2), "document_id").first()
    assert (got["summary"], got["cited"]) == ("We train a model. It shows results.", [1, 3])
    assert M.context(M.ranked(chunks, "document_id", 1), "document_id").first()["context"] == "Page 1 METHOD\nWe train a model. The encoder reads the pages."


def test_search_in_one_document_and_large_question_sets(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "payment deadline"), (2, "payment deadline"), (3, "other")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "payment deadline", 2), (2, "payment deadline", None)], "qid int, question string, doc_id int")
    got = {(r["qid"], r["doc_id"]) for r in S.lexical_top(asked, texts, 5, "qid", "question", ["doc_id"], "text", scope="doc_id").collect()}
    assert got == {(1, 2), (2, 1), (2, 2)}
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, i % 3, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)], "vid long, doc int, embedding array<double>")
    questions = rows.where("vid < 20").withColumnRenamed("vid", "qid")
    pick = lambda f: sorted((r["qid"], r["vid"], r["score"]) for r in f.collect())
    held = pick(S.vector_top(questions, rows, 4, "qid", "vid", block=7))
    monkeypatch.setattr(S, "HELD", 0)
    assert pick(S.vector_top(questions, rows, 4, "qid", "vid", block=7)) == held and len(held) == 80
    inside = pick(S.scoped_vector_top(questions, rows, 200, "qid", "vid", "doc"))
    assert {(q, v) for q, v, _ in inside} == {(q, v) for q in range(20) for v in range(200) if q % 3 == v % 3}
    assert S.vector_top(questions.limit(0), rows, 4, "qid", "vid").count() == 0


def test_contents_and_previews(spark):
    texts = ["Table of contents 1 Intro ....... 3", "1 Intro ...... 3 2 Method ...... 9", "plain text. With dots...", "a .... b .... result"]
    assert values(spark, texts, W.contents_like) == [True, True, False, True]


def test_titles_of_sections():
    from lectern.operators.sections import alias

    got = {
        "3.1. Attention module design": "METHOD", "2. Benchmarks and data": "DATASET", "5. Conclusion and future work": "FUTURE WORK", "5. Limitations": "CONCLUSION",
        "1. Overview & Objective": "OVERVIEW", "Design Approach": "METHOD", "Results & Verification": "RESULTS", "4.2. Something plain": "RESULTS", "3. Plain": "METHOD",
        "7. Plain": None, "Figure 3 results": None, "This shows results.": None, "6. Ablation study": "RESULTS",
    }
    assert {t: alias(t) for t in got} == got


def test_new_files_and_reindexing(spark, tmp_path):
    from lectern.streaming import incremental

    (tmp_path / "in").mkdir()
    for n in (1, 2):
        (tmp_path / "in" / f"f{n}.pdf").write_bytes(b"x" * n)
        (tmp_path / "in" / f"f{n}.txt").write_bytes(b"no")
        incremental.store_new_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n
    words = "plenty of words that make a usable chunk of text"
    index = C.chunks(spark.createDataFrame([(1, words), (2, words)], "doc_id long, text string"))
    again = incremental.reindexed(index, spark.createDataFrame([(2, "other " + words), (3, words)], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["chunk"].startswith("other")) for r in again.collect()) == [(1, False), (2, True), (3, False)]
