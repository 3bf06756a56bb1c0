"""Sections as columns, against the same grammar text by text."""

import random
import time

from pyspark.sql import functions as F

from lectern.operators import headings as H
from lectern.operators import sections as P

FIXED = [
    None, "", "  \n ", "plain words only", "SKILLS\nPython Spark\nEDUCATION:\nBSc", "A B S T R A C T we study things", "intro METHODS we do RESULTS we find",
    "Overview\nwe say Related Work here and Future Work there", "Intro text Related Work and more", "METHOD: one RESULTS two Related Work three", "3.1. Attention module design\nbody text\n4.2. Something plain\nmore",
    "1. Overview & Objective\nDesign Approach\nFigure 3 results\nThis shows results.", "- SUMMARY :\r\nfirst line\r\n\r\nsecond line\x0bTools & Platforms\nx", "(METHOD) in brackets, (RESULTS)too METHODX not", "TOTAL", "TOTAL TOTAL TOTAL",
    "summary\n\n\nSUMMARY::\nEXPERIENCE experience Work Experience", "5. Conclusion and future work ....... 12\nnothing", "Table 2 results\nresults", "results overview", "word " * 3000 + "\nMETHODS\n" + "term " * 2500,
    "R E S U L T S we F I N D  M E T H O D", "3.\n3. Plain\n7. Plain", "x" * 120 + " results", "BILL TO Acme\nSHIP TO Basel\nPAYMENT TERMS net 30 BALANCE DUE 12",
]


def pages():
    rng = random.Random(4)
    pieces = [*P.HEADINGS[::3], "Related Work", "future work", "Payment Terms", "2.1. Benchmarks of models", "4. Ablation", "3.2. plain title", "some words", "we find.", "(", ")", ":", "\n", "\n", "\n\n", "\r\n", "x", "Design approach"]
    return FIXED + [rng.choice(["", " "]).join(f"{p} " if rng.random() < 0.7 else p for p in rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(400)]


def test_sections_as_text_by_text(spark):
    texts = pages()
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    got = {r["i"]: [(s["text"], s["word_start"], s["heading"]) for s in r["s"]] for r in frame.select("i", H.sections(F.col("text")).alias("s")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == [(s.text, s.word_start, s.heading) for s in P.split(text or "")], repr(text)


def test_line_headings(spark):
    lines = sorted({line.strip() for t in pages() for line in (t or "").splitlines() if line.strip()})
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", H.line_heading(F.col("line")).alias("h")).collect()
    assert {r["line"]: r["h"] for r in got} == {x: P.line_heading(x) for x in lines}


def test_windows(spark):
    text = "METHODS\n" + " ".join(f"word{i}" for i in range(250)) + "\nREFERENCES\na b"
    rows = H.section_chunks(spark.createDataFrame([(1, 2, text), (1, 3, None)], "doc int, page int, text string"), ["doc", "page"], size=100, overlap=20).collect()
    assert [(r["chunk_on_page"], r["word_start"], r["word_end"], r["section_heading"]) for r in rows] == [
        (0, 0, 100, "METHODS"), (1, 80, 180, "METHODS"), (2, 160, 251, "METHODS"), (3, 240, 251, "METHODS"),
    ]
    plan = H.section_chunks(spark.createDataFrame([(1, text)], "doc int, text string"), ["doc"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_windows_of_any_size(spark):
    texts = [" ".join(f"word{i}" for i in range(n)) for n in (3, 4, 5, 12, 13, 40)]
    for size, overlap in ((4, 0), (7, 3), (10, 9), (5, 4), (12, 0)):
        rows = H.section_chunks(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), ["i"], size=size, overlap=overlap).collect()
        words = {i: t.split(" ") for i, t in enumerate(texts)}
        cut = [(i, at, min(at + size, len(w)), " ".join(w[at : at + size])) for i, w in words.items() for at in range(0, len(w), size - overlap)]
        kept = [x for x in cut if len(x[3].split(" ")) >= 4 and sum(c.isalpha() for c in x[3]) >= 16]
        assert sorted((r["i"], r["word_start"], r["word_end"], r["text"]) for r in rows) == sorted(kept)
        assert all(r["text_density"] == round(sum(c.isalpha() for c in r["text"]) / len(r["text"].replace(" ", "")), 4) for r in rows)


def test_nothing_is_kept_per_letter(spark):
    plan = H.section_chunks(spark.createDataFrame([(1, "x")], "i int, text string"), ["i"])._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and "[A-Za-z], 0" not in plan


def test_white_space_within_a_line_is_read_once(spark):
    page = spark.createDataFrame([(1, "x" + " " * 100_000 + "y and some more words to stand as a window")], "i int, text string")
    began = time.perf_counter()
    assert [(r["word_start"], r["word_end"]) for r in H.section_chunks(page, ["i"]).collect()] == [(0, 11)]
    assert time.perf_counter() - began < 30
