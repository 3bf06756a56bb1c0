"""Evidence packs, and answers held against them sentence by sentence."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import words as W

MOST = 5
REJECTED = 5


def support_score(score: Column, source: Column, keyword: Column, section: Column) -> Column:
    return F.greatest(score, source, F.coalesce(keyword, F.lit(0.0)), F.coalesce(section, F.lit(0.0)))


def choose(hits: list[dict], most: int = MOST) -> tuple[list[int], list[tuple[int, str]]]:
    """(places of the chosen hits in order, [(place, reason)] of the others) for one question.

    A hit has part (the question's part it was found for), chunk_id, document_id,
    page_number, text, score and source_score. If there are several parts, each
    first reserves its best new hit; then hits come by score, those from a page
    already used only after all others.
    """
    norm = [" ".join(h["text"].lower().split()) for h in hits]
    ranked = sorted(range(len(hits)), key=lambda i: (-hits[i]["score"], -hits[i]["source_score"]))
    taken: list[int] = []
    chunks: set = set()
    texts: set = set()
    pages: set = set()
    refused: list[tuple[int, str]] = []

    def known(i: int) -> str | None:
        if hits[i]["chunk_id"] in chunks:
            return "duplicate chunk"
        if (hits[i]["document_id"], norm[i]) in texts:
            return "duplicate text"
        return None

    def take(i: int) -> None:
        taken.append(i)
        chunks.add(hits[i]["chunk_id"])
        texts.add((hits[i]["document_id"], norm[i]))
        pages.add((hits[i]["document_id"], hits[i]["page_number"]))

    parts = list(dict.fromkeys(h["part"] for h in hits))
    reserved: set = set()
    if len(parts) > 1:
        for part in parts:
            best = next((i for i in ranked if hits[i]["part"] == part and known(i) is None), None)
            if best is not None and len(taken) < most:
                take(best)
                reserved.add((part, hits[best]["chunk_id"]))
    later: list[int] = []
    for i in ranked:
        own = (hits[i]["part"], hits[i]["chunk_id"])
        if own in reserved:
            reserved.remove(own)
        elif reason := known(i):
            refused.append((i, reason))
        elif len(taken) >= most:
            refused.append((i, "limit reached"))
        elif (hits[i]["document_id"], hits[i]["page_number"]) in pages:
            later.append(i)
        else:
            take(i)
    for i in later:
        if len(taken) >= most:
            refused.append((i, "page already used"))
        elif known(i):
            refused.append((i, "duplicate chunk"))
        else:
            take(i)
    return taken, refused[:REJECTED]


PACK = "{qid} long, place int, part string, chunk_id long, document_id long, page_number int, score double, reason string"


def evidence_packs(hits: DataFrame, qid: str = "qid", most: int = MOST) -> DataFrame:
    """One row per chosen hit (place from 1) or refused one (place null, with the reason), per question.

    A question has as many hits as candidate_limit allows for each of its parts.
    """
    fields = ["part", "chunk_id", "document_id", "page_number", "text", "score", "source_score"]

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["part", "chunk_id"], kind="stable")
        rows = table[fields].to_dict("records")
        taken, refused = choose(rows, most)
        out = [(i, n, None) for n, i in enumerate(taken, 1)] + [(i, None, reason) for i, reason in refused]
        picked = table.iloc[[i for i, _, _ in out]]
        found = picked[[qid, "part", "chunk_id", "document_id", "page_number", "score"]].copy()
        found["place"] = pd.array([p for _, p, _ in out], dtype="Int32")
        found["reason"] = [r for _, _, r in out]
        return found[[qid, "place", "part", "chunk_id", "document_id", "page_number", "score", "reason"]]

    return hits.groupBy(qid).applyInPandas(run, PACK.format(qid=qid))


#: Sentences end at . ! ? and white space, but not after "al.".
SENTENCE_END = r"(?i)(?<!\bal\.)(?<=[.!?])\s+"
SIMPLE_END = r"[.!?]\s+"
NUMBER = r"(?<![\p{L}\p{N}_])[+-]?[0-9][0-9,]*(?:\.[0-9]+)?%?(?![\p{L}\p{N}_])"
ENTITY = r"\b[A-Z][A-Za-z0-9-]+\b"


def sentences(text: Column, end: str = SENTENCE_END) -> Column:
    return F.filter(F.transform(F.split(F.btrim(F.coalesce(text, F.lit(""))), end), lambda s: F.btrim(s)), lambda s: s != "")


def numbers(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit(""))))


def entity_words(text: Column) -> Column:
    return W.verifier_words(F.array_join(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), " "))


def sentence_support(
    answers: DataFrame, evidence: DataFrame, qid: str, answer: str, text: str, chunk: str, end: str = SENTENCE_END
) -> DataFrame:
    """(qid, sentence_no, sentence, supported, score, chunk): each answer sentence with its best evidence sentence.

    Supported means: four fifths of its words, all of its numbers and names, and
    the same negations are in one sentence of the evidence.
    """
    said = answers.select(qid, F.posexplode(sentences(F.col(answer), end)).alias("sentence_no", "sentence"))
    said = said.select(
        "*",
        W.verifier_words(F.col("sentence")).alias("s_words"),
        numbers(F.col("sentence")).alias("s_numbers"),
        entity_words(F.col("sentence")).alias("s_names"),
    )
    shown = evidence.select(qid, chunk, F.posexplode(sentences(F.col(text), end)).alias("e_no", "e"))
    shown = shown.select(qid, chunk, "e_no", W.verifier_words(F.col("e")).alias("e_words"), numbers(F.col("e")).alias("e_numbers"))
    negations = F.array(*[F.lit(n) for n in W.NEGATIONS])
    denied = lambda words: F.array_sort(F.array_intersect(words, negations))
    within = lambda a, b: F.size(F.array_except(a, b)) == 0
    score = W.overlap(F.col("s_words"), F.col("e_words"))
    supported = (
        (score >= 0.8)
        & within(F.col("s_numbers"), F.col("e_numbers"))
        & (denied(F.col("s_words")) == denied(F.col("e_words")))
        & within(F.col("s_names"), F.col("e_words"))
    )
    # Evidence is matched within a question only; a sentence without any has none.
    met = said.join(shown, qid, "left").select(
        qid, "sentence_no", "sentence", F.coalesce(supported, F.lit(False)).alias("supported"),
        F.coalesce(score, F.lit(0.0)).alias("score"), chunk, "e_no",
    )
    best = Window.partitionBy(qid, "sentence_no").orderBy(F.desc("supported"), F.desc("score"), F.col(chunk), "e_no")
    first = met.withColumn("turn", F.row_number().over(best)).where("turn = 1")
    return first.select(qid, "sentence_no", "sentence", "supported", "score", F.when(F.col("supported"), F.col(chunk)).alias(chunk))


def verification(support: DataFrame, qid: str) -> DataFrame:
    """Per answer: status, unsupported sentences and their share."""
    counted = support.groupBy(qid).agg(
        F.count("*").alias("n_sentences"), F.count_if(~F.col("supported")).alias("n_unsupported")
    )
    status = (
        F.when(F.col("n_unsupported") == F.col("n_sentences"), "unsupported")
        .when(F.col("n_unsupported") > 0, "partially_supported")
        .otherwise("verified")
    )
    return counted.withColumn("status", status).withColumn("risk", F.col("n_unsupported") / F.col("n_sentences"))


def supported_answer(support: DataFrame, qid: str) -> DataFrame:
    """The answer made of its supported sentences only."""
    kept = support.where("supported").groupBy(qid).agg(F.sort_array(F.collect_list(F.struct("sentence_no", "sentence"))).alias("s"))
    return kept.select(qid, F.array_join(F.transform("s", lambda x: x["sentence"]), " ").alias("answer"))


def normal_text(text: str) -> str:
    return re.sub(r"\s+", " ", text.lower()).strip()
