"""Questions answered from end to end: planned, searched, reranked, packed, answered, with what was shown and why.

A batch of questions is one job. A question may name the document that it asks
of; all others search the whole corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import words as W
from lectern.operators import answers as A
from lectern.operators import evidence as V
from lectern.operators import ranking as K
from lectern.operators import routing as R
from lectern.operators import search as S
from lectern.operators.reading import image_url, page_url, snippet
from lectern.storage import stored

#: A search by vectors: (parts with qid, part and document_id, k) to (qid, part, chunk_id, score).
VectorSearch = Callable[[DataFrame, int], DataFrame]
HIT = ["chunk_id", "document_id", "page_number", "chunk_index", "section_heading", "text"]
# Why related evidence was not cited, in order, and why nothing was.
NOT_CITED = (
    "Related evidence was not cited because it ranked below the selected answer evidence.",
    "Related evidence matched the broader topic but not the requested answer intent.",
    "Related evidence was kept for context only.",
)
NOTHING_PASSED = "No indexed evidence passed the answerability checks"
NO_CHUNKS = {
    "deferred_ocr": "This selected document needs OCR before it can be searched.",
    "ocr_processing": "OCR is still running for this selected document. Try again after processing completes.",
    "failed": "Document indexing failed. Reindex the document before searching it.",
}
NOT_INDEXED = "This selected document does not have indexed searchable evidence yet."


@dataclass(frozen=True)
class Execution:
    """answers: one row per question. hits: what is shown for it, evidence first. candidates: the best five of each part. packs: chosen and refused evidence."""

    answers: DataFrame
    hits: DataFrame
    candidates: DataFrame
    packs: DataFrame | None


def parts(questions: DataFrame, verified: bool) -> DataFrame:
    """(qid, part_no, part, question, document_id): the parts that a question is searched by; a standard answer searches it whole."""
    if not verified:
        return questions.select("qid", F.lit(0).alias("part_no"), F.col("question").alias("part"), "question", "document_id")

    def run(batches):
        for batch in batches:
            rows = [(q, n, part, text, d) for q, text, d in zip(batch["qid"], batch["question"], batch["document_id"]) for n, part in enumerate(R.plan(text).parts or (text,))]
            yield pd.DataFrame(rows, columns=["qid", "part_no", "part", "question", "document_id"]).astype({"document_id": "Int64"})

    return questions.select("qid", "question", "document_id").mapInPandas(run, "qid long, part_no int, part string, question string, document_id long")


def without_chunks(questions: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, reason) for questions of a document (document_id, status, error_message) that has nothing to search."""
    empty = docs.join(chunks.select("document_id").distinct(), "document_id", "left_anti")
    known = F.create_map(*[F.lit(x) for pair in NO_CHUNKS.items() for x in pair])
    told = F.when(F.col("status") == "deferred_ocr", F.col("error_message"))
    detail = F.when(F.col("status") == "failed", F.concat(F.col("error_message"), F.lit(" Reindex the document before searching it.")))
    reason = F.coalesce(told, detail, F.try_element_at(known, F.col("status")), F.lit(NOT_INDEXED))
    return questions.join(empty, "document_id").select("qid", reason.alias("reason"))


def candidates(asked: DataFrame, chunks: DataFrame, k: int, vector_search: VectorSearch | None = None) -> DataFrame:
    """(qid, part_no, part, question, HIT, vector_score, lexical_score, source_score, score): the reranked hits of each part."""
    fetched = S.candidate_limit(k)
    keyed = asked.withColumn("key", F.xxhash64("qid", "part_no"))
    searched = chunks.withColumn("searchable", F.concat_ws(" ", "section_heading", "text"))
    lexical = S.lexical_top(keyed, searched, fetched, "key", "part", ["document_id", "chunk_index", "chunk_id"], "searchable", scope="document_id")
    lexical = lexical.select("key", "chunk_id", "score")
    if vector_search is None:
        merged = lexical.select("key", "chunk_id", F.lit(0.0).alias("vector_score"), F.col("score").alias("lexical_score"), "score")
    else:
        merged = S.merge_hybrid(vector_search(keyed, fetched).select("key", "chunk_id", "score"), lexical, fetched, ["key", "chunk_id"], "key").drop("rank")
    # Written, so that the few hits are known to be few where they meet the chunks.
    hits = stored(merged, "hits").withColumnRenamed("score", "source_score").join(chunks.select(*HIT), "chunk_id").join(keyed.drop("document_id"), "key").drop("key")
    keyword = W.overlap(W.matching_words(F.col("part")), W.matching_words(F.concat_ws(" ", "section_heading", "text")))
    section = R.section_score(F.col("part"), F.col("section_heading"))
    return hits.withColumns({"keyword": keyword, "section": section}).withColumn("score", F.round(S.rerank_score(F.col("source_score"), F.col("keyword"), F.col("section")), 9))


def answer_ranked(hits: DataFrame) -> DataFrame:
    """The hits of each part with the score by which they answer it; those that don't suffice score 0."""
    fields = ["chunk_id", "text", "score", "source_score", "section_heading"]

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["score", "chunk_id"], ascending=[False, True], kind="stable")
        rows = table[fields].astype(object).where(table[fields].notna(), None).to_dict("records")
        scores = {id(h): s for h, s in A.answer_scores(table["part"].iloc[0], rows)}
        return table.assign(score=[scores[id(h)] for h in rows])

    return hits.groupBy("qid", "part_no").applyInPandas(run, hits.schema)


def modes(hits: DataFrame, embedded: bool) -> DataFrame:
    """(qid, retrieval_mode): hybrid before vector before lexical, over a question's parts."""
    some = lambda c: F.count_if(F.col(c) > 0)
    by_part = hits.groupBy("qid", "part_no").agg(S.retrieval_mode(some("vector_score"), some("lexical_score"), F.lit(embedded)).alias("mode"))
    order = F.when(F.col("mode") == "hybrid", 2).when(F.col("mode") == "vector", 1).otherwise(0)
    return by_part.groupBy("qid").agg(F.max_by("mode", order).alias("retrieval_mode"))


def diagnostics(shown: DataFrame, answers: DataFrame) -> DataFrame:
    """``answers`` (status, cited) with the counts of cited and related hits and why the related ones were not cited."""
    counts = shown.groupBy("qid").agg(F.count_if(F.col("role") == "related").alias("related_count"))
    both = answers.join(counts, "qid", "left").na.fill(0, ["related_count"])
    listed = F.slice(F.array(*[F.lit(x) for x in NOT_CITED]), F.lit(1), F.least(F.col("related_count"), F.lit(3)).cast("int"))
    none = (F.col("status") == "insufficient_evidence") & (F.col("related_count") == 0)
    reasons = F.when(none, F.array(F.lit(NOTHING_PASSED))).otherwise(listed)
    return both.withColumns({"answer_evidence_count": F.size(F.coalesce("cited", F.array().cast("array<bigint>"))), "rejected_reasons": reasons})


def _of_hits(chunks: DataFrame, hits: DataFrame) -> DataFrame:
    """The chunks that some hit is."""
    return stored(chunks.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi").select(*HIT), "cited")


def _shown(hits: DataFrame, answers: DataFrame, chunks: DataFrame) -> DataFrame:
    cited = answers.select("qid", F.posexplode("cited").alias("place", "chunk_id"))
    ordered = K.cited_first(hits.select("qid", "chunk_id", "text", "score", "place"), cited, chunks.select("chunk_id", "text"), ["qid"], "chunk_id")
    named = ordered.drop("text").join(chunks.select(*HIT), "chunk_id")
    role = cited.select("qid", "chunk_id", F.lit("answer").alias("role"))
    doc, page, chunk = F.col("document_id"), F.col("page_number"), F.col("chunk_id")
    linked = named.join(role, ["qid", "chunk_id"], "left").withColumns(
        {"role": F.coalesce("role", F.lit("related")), "snippet": snippet(F.col("text")), "page_image_url": image_url(doc, page), "document_page_url": page_url(doc, page, chunk)}
    )
    return linked.drop("text")


def execute(
    questions: DataFrame,
    chunks: DataFrame,
    k: int = 5,
    verified: bool = False,
    vector_search: VectorSearch | None = None,
    docs: DataFrame | None = None,
    known: DataFrame | None = None,
    fallback: str | None = None,
) -> Execution:
    """Answer questions (qid, question, document_id) from chunks (HIT).

    verified: by parts, an evidence pack and the check of every sentence; else by
    the best hits, or by ``known``, answers (qid, status, answer, cited) of
    document-aware rules, where these are answerable. docs: documents with their
    status, for those that have no chunks. fallback: why there are no vectors.
    """
    asked = questions.select(F.col("qid").cast("long"), "question", F.col("document_id").cast("long"))
    # Searched once: answers, modes and what is shown all go on with the hits.
    hits = stored(candidates(parts(asked, verified), chunks, k, vector_search), "candidates")
    # What is cited is a hit, unless answers are known from elsewhere.
    cited_from = chunks if known is not None else _of_hits(chunks, hits)
    ranked = answer_ranked(hits) if verified else hits
    order = [F.desc("score"), F.desc("source_score"), F.col("document_id"), F.col("chunk_index")]
    packs = None
    if verified:
        top = K.first_rows(ranked, ["qid", "part_no"], order, k)
        found = top.select(
            "qid", "part", "chunk_id", F.col("document_id").cast("long"), F.col("page_number").cast("int"), F.col("text"), "score", "source_score"
        )
        packs = V.evidence_packs(found)
        chosen = packs.where("place is not null").select("qid", "place", "chunk_id", "score")
        items = chosen.join(cited_from.select("chunk_id", "text", "section_heading"), "chunk_id").join(asked.select("qid", "question"), "qid")
        sources = top.groupBy("qid", "chunk_id").agg(F.max("source_score").alias("source_score"))
        packed = items.join(sources, ["qid", "chunk_id"])
        answered = A.verified_answers(packed, "qid", "question")
        shown_hits = packed
    else:
        top = K.first_rows(ranked, ["qid"], order, k)
        own = A.answers(top, "qid", "question").withColumnRenamed("summary", "answer")
        answered = own if known is None else _known_first(known, own)
        shown_hits = top
    reasons = without_chunks(asked, docs, chunks) if docs is not None else None
    whole = _whole(asked, answered, reasons).join(modes(hits, vector_search is not None), "qid", "left")
    whole = whole.withColumns({"query_intent": R.intent(F.col("question")), "fallback_reason": F.lit(fallback).cast("string")})
    shown = _shown(shown_hits, whole, cited_from)
    best = K.first_rows(ranked, ["qid", "part_no"], order, 5).select("qid", "part", F.col("place").alias("rank"), "chunk_id", "score", "source_score")
    return Execution(diagnostics(shown, whole), shown, best, packs)


def _known_first(known: DataFrame, own: DataFrame) -> DataFrame:
    """A document's own answer where it has one, or abstains for a reason; else that of the hits."""
    mine = known.where("status <> 'fall_through'").select("qid", "status", F.col("answer").alias("answer"), "cited", F.lit("moderate").alias("confidence"))
    return mine.unionByName(own.select("qid", "status", "answer", "cited", "confidence").join(mine.select("qid"), "qid", "left_anti"))


def _whole(asked: DataFrame, answered: DataFrame, reasons: DataFrame | None) -> DataFrame:
    """Every question with its answer; one without any hit abstains."""
    both = asked.join(answered.select("qid", "status", "confidence", "answer", "cited"), "qid", "left")
    reason: Column = F.lit(None).cast("string")
    if reasons is not None:
        both = both.join(reasons, "qid", "left")
        reason = F.col("reason")
    empty = F.array().cast("array<bigint>")
    blank = reason.isNotNull() | F.col("status").isNull()
    return both.select(
        "qid", "question", "document_id", F.when(blank, "insufficient_evidence").otherwise(F.col("status")).alias("status"),
        F.when(blank, "weak").otherwise(F.col("confidence")).alias("confidence"), F.when(~blank, F.col("answer")).alias("answer"),
        F.when(blank, empty).otherwise(F.coalesce("cited", empty)).alias("cited"), reason.alias("reason"),
    )
