"""Summaries of documents from their chunks: ranked by heading, balanced over groups of headings, one sentence each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import research as T
from lectern.functions import words as W
from lectern.operators.ranking import first_rows

# What headings are worth, the groups that a report's summary draws on, and the words that tell a method or result.
WEIGHTS = {
    "ABSTRACT": 80, "EXECUTIVE SUMMARY": 80, "SUMMARY": 75, "OBJECTIVES": 72, "OVERVIEW": 70, "INTRODUCTION": 65,
    "PROFESSIONAL SUMMARY": 65, "METHOD": 45, "METHODS": 45, "METHODOLOGY": 45, "APPROACH": 45, "RESULT": 42, "RESULTS": 42,
    "FINDINGS": 42, "RECOMMENDATIONS": 40, "CONCLUSION": 38, "FUTURE WORK": 35, "TECHNICAL SKILLS": 34, "PROJECTS": 34,
    "PAYMENT SUMMARY": 34, "PARTIES": 34,
}
PLAIN, NEVER = 10, -100
GROUPS = (
    ("ABSTRACT", "OVERVIEW", "OBJECTIVES", "INTRODUCTION", "EXECUTIVE SUMMARY", "SUMMARY"),
    ("METHOD", "METHODS", "METHODOLOGY", "APPROACH", "MODEL"),
    ("RESULT", "RESULTS", "FINDINGS", "EVALUATION", "EXPERIMENTS"),
    ("CONCLUSION", "FUTURE WORK", "LIMITATIONS", "DISCUSSION"),
)
METHOD_WORDS = (
    "approach calibrated calibrate feature features implementation observation policy ppo reward rewards shaped simulator training vector"
).split()
RESULT_WORDS = "alive balanced error latency policy rallies result results validated verification wins".split()
LIMITS = {"concise": 3, "detailed": 5}
LONGEST = 360


def weight(heading: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return F.when(heading == "REFERENCES", NEVER).otherwise(F.coalesce(F.try_element_at(known, F.coalesce(heading, F.lit(""))), F.lit(PLAIN)))


def heading_group(heading: Column) -> Column:
    out = F.lit(None).cast("int")
    for n, names in enumerate(GROUPS):
        out = F.when(heading.isin(*names), n).otherwise(out)
    return out


def usable_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks (heading, text) with usable text, the body that a summary may use."""
    return chunks.withColumn("usable_text", T.summary_text(F.col("text"), F.col("heading"))).where("usable_text <> ''")


def ranked(chunks: DataFrame, document: str, most: int) -> DataFrame:
    """The chunks of each document whose headings are worth most, earlier ones first among equals."""
    scored = usable_chunks(chunks).withColumn("worth", weight(F.col("heading")))
    return first_rows(scored, [document], [F.desc("worth"), F.col("chunk_index")], most)


def retrieved(chunks: DataFrame, question: str, document: str, most: int) -> DataFrame:
    """The chunks of each document that share most words with a question; where none shares any, the ranked ones."""
    words = T.study_words(F.lit(question))
    scored = usable_chunks(chunks).withColumns({"worth": weight(F.col("heading")), "shared": F.size(F.array_intersect(words, T.study_words(F.concat_ws(" ", "heading", "text"))))})
    best = scored.groupBy(document).agg(F.max(F.when(F.col("worth") > NEVER, F.col("shared")).otherwise(0)).alias("most_shared"))
    both = scored.join(best, document).where((F.col("most_shared") == 0) | (F.col("shared") > 0) & (F.col("worth") > NEVER))
    return first_rows(both.drop("most_shared"), [document], [F.desc("shared"), F.desc("worth"), F.col("chunk_index")], most)


def balanced(chunks: DataFrame, document: str, most: int) -> DataFrame:
    """The best chunk of each group of headings, filled up by the ranked ones."""
    scored = usable_chunks(chunks).withColumns({"worth": weight(F.col("heading")), "part": heading_group(F.col("heading"))})
    best = first_rows(scored.where("part is not null"), [document, "part"], [F.desc("worth"), F.col("chunk_index")]).withColumn("own", F.col("part"))
    rest = scored.join(best.select(document, "chunk_index"), [document, "chunk_index"], "left_anti").withColumn("own", F.lit(len(GROUPS)))
    both = best.drop("place").unionByName(rest)
    return first_rows(both, [document], [F.col("own"), F.desc("worth"), F.col("chunk_index")], most).drop("own")


def excerpt(text: Column, heading: Column) -> Column:
    """One sentence of a chunk: under methods and results the one with most of their words, else the first."""
    body = T.summary_text(text, heading)
    said = F.filter(F.transform(F.split(body, T.SENTENCE_END), lambda s: F.btrim(s)), lambda s: s != "")
    terms = lambda words: F.array(*[F.lit(w) for w in words])
    telling = F.when(heading_group(heading) == 1, terms(METHOD_WORDS)).when(heading_group(heading) == 2, terms(RESULT_WORDS)).otherwise(F.array().cast("array<string>"))
    best = F.array_max(F.transform(said, lambda s, i: F.struct(F.size(F.array_intersect(W.word_set(s), telling)).alias("n"), (-i).alias("at"), s.alias("s"))))
    return W.truncated(F.coalesce(best["s"], F.lit("")), LONGEST)


def summaries(chosen: DataFrame, document: str) -> DataFrame:
    """(document, summary, cited): the excerpts of the chosen chunks in the order of the document."""
    told = chosen.withColumn("said", excerpt(F.col("text"), F.col("heading"))).where("said <> ''")
    listed = told.groupBy(document).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "said"))).alias("x"))
    return listed.select(document, F.array_join(F.transform("x", lambda e: e["said"]), " ").alias("summary"), F.transform("x", lambda e: e["chunk_index"]).alias("cited"))


def context(chosen: DataFrame, document: str) -> DataFrame:
    """(document, context): the chosen chunks in order, each under its page and heading."""
    head = F.concat_ws(" ", F.concat(F.lit("Page "), F.col("page_number").cast("string")), "heading")
    part = F.concat(head, F.lit("\n"), F.col("usable_text"))
    listed = chosen.groupBy(document).agg(F.array_sort(F.collect_list(F.struct("chunk_index", part.alias("part")))).alias("x"))
    return listed.select(document, F.array_join(F.transform("x", lambda e: e["part"]), "\n\n").alias("context"))
