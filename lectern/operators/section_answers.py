"""Answers from the sections of known documents, many questions at a time.

Everything is a plan over chunks in the order of their documents: headings carry
forward by a window, the best come by an aggregate, sentences are chosen inside
arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import research as T
from lectern.functions import words as W
from lectern.operators.ranking import carried, first_rows, near_best

MOST, LONGEST = 3, 480
# Words of claims, settings that are no results, and where limitations stand.
RESULT_CLAIMS = (
    "achieve achieved achieves achieving demonstrate demonstrated demonstrates finding findings highlight highlighted highlights "
    "improve improved improvement outperform outperformed outperforms performance result results show shown shows"
).split()
METRIC_WORDS = ("top1", "top-1", "top5", "top-5", "f1", "accuracy")
SETTINGS = (
    r"(?i)\b(?:number of .*heads|transformer heads|layers|dimensions?|embedding|width|parameters?|"
    r"H\s*=|L[VTL]?\s*=|D[VTL]?\s*=|batch size|learning rate)\b"
)
RESULT_PLACES = ("RESULT", "RESULTS", "EVALUATION", "EXPERIMENT", "EXPERIMENTS")
LIMIT_PLACES = ("LIMITATION", "LIMITATIONS", "FUTURE WORK", "CONCLUSION", "DISCUSSION")


def _is_reference(heading: Column, text: Column) -> Column:
    return F.coalesce(heading == "REFERENCES", F.lit(False)) | F.lower(W.collapsed(F.concat_ws(" ", heading, text))).startswith("references")


def matching_chunks(asked: DataFrame, chunks: DataFrame, document: str = "document_id") -> DataFrame:
    """The chunks that serve each question: those under its headings, then those with its terms.

    ``asked`` has qid, document, headings, terms, prefer_headings, skip_tables
    and follow (whether chunks without a heading belong to the one before);
    ``chunks`` has document, page_number, chunk_index, heading and text.
    """
    both = asked.join(chunks, document)
    heading, text = F.col("heading"), F.col("text")
    closed = _is_reference(heading, text) | W.contents_like(text)
    table = F.col("skip_tables") & T.table_like(text)
    under = F.coalesce(F.array_contains("headings", heading), F.lit(False))
    order = [F.col("page_number"), F.col("chunk_index")]
    # What each chunk says of the heading in force: it ends, begins, or stays.
    event = F.when(closed, False).when(table, None).when(under, True).when(heading.isNotNull(), False)
    low = F.lower(W.collapsed(F.concat_ws(" ", heading, text)))
    told = F.exists("terms", lambda t: F.contains(low, t))
    marked = both.withColumns({"open": F.coalesce(carried(event, ["qid"], order), F.lit(False)), "closed": closed | table})
    by = F.when(under | F.col("follow") & heading.isNull() & F.col("open"), 0).when(told, 1)
    found = marked.where(~F.col("closed")).withColumn("by", by).where("by is not null")
    headed = found.where("by = 0 and prefer_headings").select("qid").distinct().withColumn("headed", F.lit(True))
    kept = found.join(headed, "qid", "left").where("headed is null or by = 0").drop("headed", "open", "closed")
    return first_rows(kept, ["qid"], [F.col("by"), *order], 2**31 - 1)


def opening_chunks(chunks: DataFrame, document: str = "document_id", most: int = MOST) -> DataFrame:
    """The first chunks of each document that are neither references nor a table of contents."""
    prose = chunks.where(~_is_reference(F.col("heading"), F.col("text")) & ~W.contents_like(F.col("text")))
    return first_rows(prose, [document], [F.col("page_number"), F.col("chunk_index")], most)


def claim_score(text: Column, heading: Column, intent: Column, limits: list[str], future: str) -> Column:
    """How much a chunk of a paper claims for an intent: results or limitations; 0 for any other."""
    body = F.lower(T.clean_research(T.after_heading(text, heading)))
    words = W.word_set(body)
    share = lambda terms: F.size(F.array_intersect(words, F.array(*[F.lit(t) for t in terms])))
    points = lambda c, n: F.coalesce(c, F.lit(False)).cast("int") * n
    results = points(heading.isin(*RESULT_PLACES), 4) + 2 * share(RESULT_CLAIMS) + points(T.contains_any(body, list(METRIC_WORDS)), 3) - points(body.rlike(SETTINGS), 8)
    ahead = body.rlike(future)
    bounds = points(heading.isin(*LIMIT_PLACES), 4) + 2 * share(limits) + points(ahead, 8) - points(body.startswith("this paper presents") & ~ahead, 4)
    return F.when(intent == "results", results).when(intent == "limitations", bounds).otherwise(F.lit(0))


def best_claims(found: DataFrame, score: Column) -> DataFrame:
    """Matching chunks whose claims come near the best of their question, the strongest first."""
    scored = found.drop("place").withColumn("claim", score)
    return first_rows(near_best(scored, ["qid"], "claim"), ["qid"], [F.desc("claim"), F.col("by"), F.col("page_number"), F.col("chunk_index")], 2**31 - 1)


def best_sentence(sentences: Column, terms: Column, first: bool = False) -> Column:
    """The sentence with most of the terms, the first of equals; or simply the first."""
    ranked = F.transform(sentences, lambda s, i: F.struct(F.size(F.array_intersect(W.word_set(s), terms)).alias("n"), (-i).alias("at"), s.alias("s")))
    return F.get(sentences, F.lit(0)) if first else F.array_max(ranked)["s"]


def passage(text: Column, question: Column, first: bool = False) -> Column:
    """The sentence of a text that fits a question best, cut where it is too long; the text itself without any."""
    flat = T.cleaned(text)
    said = F.filter(F.transform(F.split(flat, r"(?<=[.!?])\s+"), lambda s: F.btrim(s)), lambda s: s != "")
    return W.truncated(F.coalesce(best_sentence(said, W.word_set(question), first), flat), LONGEST)


def research_passage(text: Column, question: Column, first: bool = False) -> Column:
    """As ``passage``, among the sentences of a paper that say something; empty without any."""
    return W.truncated(F.coalesce(best_sentence(T.prose_sentences(text), W.word_set(question), first), F.lit("")), LONGEST)


def answers(found: DataFrame, summary: Column, most: int = MOST) -> DataFrame:
    """(qid, answer, cited): the passages of each question's first chunks, joined, and the chunks they are from."""
    shown = found.where(F.col("place") <= most).withColumn("said", summary).where(F.coalesce("said", F.lit("")) != "")
    listed = shown.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "said", "chunk_index"))).alias("x"))
    return listed.select(
        "qid", F.array_join(F.transform("x", lambda e: e["said"]), " ").alias("answer"), F.transform("x", lambda e: e["chunk_index"]).alias("cited")
    )


def chunk_of_facts(facts: DataFrame, chunks: DataFrame, document: str = "document_id") -> DataFrame:
    """``facts`` (document, value) with the first chunk of their document that holds the value, case aside; facts without one go."""
    held = facts.join(chunks.select(document, "page_number", "chunk_index", "text"), document).where(F.contains(F.lower("text"), F.lower("value")))
    first = F.min(F.struct("page_number", "chunk_index")).alias("at")
    return held.groupBy(*facts.columns).agg(first).select(*facts.columns, "at.page_number", "at.chunk_index")


def chunks_with_values(facts: DataFrame, chunks: DataFrame, document: str = "document_id") -> DataFrame:
    """The chunks that hold some value of their document's facts."""
    held = facts.select(document, F.lower("value").alias("value")).join(chunks, document).where(F.contains(F.lower("text"), F.col("value")))
    return held.drop("value").dropDuplicates([document, "page_number", "chunk_index"])
