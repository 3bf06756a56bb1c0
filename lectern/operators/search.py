"""Batch retrieval: lexical and vector top-k, their merge, and reranking.

Questions are rows, so any number of them is one job. Lexical search goes
through an inverted index in blocks, which skips what can't be among a question's
best (``lexical``); questions never meet texts. Vector search multiplies blocks of
vectors and keeps the best of a block before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import words as W
from lectern.operators import lexical as L
from lectern.operators import pivots as P


def candidate_limit(k: int) -> int:
    """How many hits are fetched before reranking picks k."""
    return min(50, max(4 * k, k + 10))


def top_k(rows: DataFrame, k: int, group: list[str], order: list[Column]) -> DataFrame:
    """The first k rows of each group, with their rank."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def lexical_scores(
    questions: DataFrame, chunks: DataFrame, qid: str, question: str, ids: list[str], text: str, scope: str | None = None
) -> DataFrame:
    """(qid, ids, score): share of a question's words that a text has, to six digits, for every text that has any.

    ``scope`` names a column of the questions and one of ``ids``: a question
    searches only the document that it names, all of them where it names none.
    """
    hits = _hits(questions, chunks, qid, question, ids, text, scope)
    return hits.groupBy(qid, *ids).agg(_rounded(F.count("*") / F.first("n_asked")).alias("score"))


def _rounded(share: Column) -> Column:
    return F.bround(share, 6)


def _hits(questions: DataFrame, chunks: DataFrame, qid: str, question: str, ids: list[str], text: str, scope: str | None) -> DataFrame:
    """(qid, ids, n_asked): a row for each word of a question that a text has."""
    asked = questions.select(F.col(qid), W.search_words(F.col(question)).alias("asked"), *([F.col(scope).alias("__scope")] if scope else []))
    asked = asked.select(qid, *(["__scope"] if scope else []), F.size("asked").alias("n_asked"), F.explode("asked").alias("word"))
    postings = chunks.select(*ids, F.explode(W.search_words(F.col(text))).alias("word"))
    if not scope:
        return postings.join(asked, "word")
    # A question that names a document meets the words of that document alone.
    inside = postings.join(asked.where("__scope IS NOT NULL"), (F.col(scope) == F.col("__scope")) & (postings["word"] == asked["word"]))
    return inside.select(qid, *ids, "n_asked")


def lexical_best(
    questions: DataFrame, chunks: DataFrame, k: int, qid: str, question: str, ids: list[str], text: str, scope: str | None = None, slack: int = 0
) -> DataFrame:
    """(qid, ids, score) of each question's k best texts with all their ties, and of some others.

    With ``slack``, of all texts that have at most so many words less than the k-th best.
    Questions that name a document in ``scope`` are scored there in full; the others
    skip the blocks of texts that can't be among their best (see ``lexical``).
    """
    whole = questions.where(F.col(scope).isNull()) if scope else questions
    size = F.size(W.search_words(F.col(question)))
    short, long = whole.where(size <= L.MOST), whole.where(size > L.MOST)
    parts = []
    # Which ways are taken is a matter of the questions alone; no way reads the texts for nothing.
    if not short.isEmpty():
        found = L.candidates(L.asked_words(short, qid, question), L.index(chunks, ids, text), k, slack)
        parts.append(found.select(F.col("qid").alias(qid), "ids.*", _rounded(F.col("score")).alias("score")))
    if not long.isEmpty():
        # A question of more words than a packed count holds is scored against every text.
        parts.append(lexical_scores(long, chunks, qid, question, ids, text))
    if scope:
        parts.append(lexical_scores(questions.where(F.col(scope).isNotNull()), chunks, qid, question, ids, text, scope))
    return reduce(DataFrame.unionByName, parts or [lexical_scores(questions, chunks, qid, question, ids, text)])


def lexical_top(
    questions: DataFrame, chunks: DataFrame, k: int, qid: str, question: str, ids: list[str], text: str, scope: str | None = None
) -> DataFrame:
    scored = lexical_best(questions, chunks, k, qid, question, ids, text, scope)
    return top_k(scored, k, [qid], [F.desc("score"), *map(F.col, ids)])


#: Bytes of question vectors that every task may hold; more meet the rows in blocks.
HELD = 64_000_000


def vector_top(
    questions: DataFrame, rows: DataFrame, k: int, qid: str, rid: str, vector: str = "embedding", block: int = 2048
) -> DataFrame:
    """(qid, rid, score, rank): exact nearest rows by cosine, scores rounded to six digits, ties by id.

    Where all question vectors fit into ``HELD`` bytes, every task holds them and the
    rows stay where they are. Otherwise questions meet the blocks of rows that bounds
    around pivots don't rule out (``pivots``).
    """
    questions, rows = (df.where(F.col(vector).isNotNull()) for df in (questions, rows))
    size = questions.agg(F.coalesce(F.sum(F.size(vector)), F.lit(0)).alias("values")).first()
    if 8 * size["values"] > HELD:
        return P.top(questions, rows, k, qid, rid, vector)
    asked = questions.select(F.col(qid).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).toArrow()
    qs, names = asked["i"].to_numpy(), [qid, rid, "score"]
    held = rows.sparkSession.sparkContext.broadcast((qs, np.array(asked["v"].to_pylist(), np.float64)))

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = held.value
        for batch in batches:
            if batch.num_rows and len(own):
                rs, r = batch.column(0).to_numpy(), P.matrix(batch.column(1), batch.num_rows)
                for at in range(0, len(own), block):
                    yield P.nearest(own[at : at + block], q[at : at + block], rs, r, k, names)

    found = rows.select(F.col(rid).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(stay, f"{qid} long, {rid} long, score double")
    return top_k(found, k, [qid], [F.desc("score"), F.col(rid)])


def scoped_vector_top(
    questions: DataFrame, rows: DataFrame, k: int, qid: str, rid: str, scope: str, vector: str = "embedding"
) -> DataFrame:
    """As ``vector_top``, each question among the rows of the document that it names: an equi-join on ``scope``."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    asked = questions.select(F.col(qid), F.col(scope), F.col(vector).cast("array<double>").alias("__q"))
    both = rows.select(F.col(rid), F.col(scope), F.col(vector).cast("array<double>").alias("__r")).join(asked, scope)
    norms = F.sqrt(dot(F.col("__q"), F.col("__q")) * dot(F.col("__r"), F.col("__r")))
    score = W.similarity_score(1 - F.coalesce(F.try_divide(dot(F.col("__q"), F.col("__r")), norms), F.lit(0.0)))
    scored = both.select(qid, rid, F.round(score, 6).alias("score"))
    return top_k(scored, k, [qid], [F.desc("score"), F.col(rid)])


def merge_hybrid(vector: DataFrame, lexical: DataFrame, k: int, keys: list[str], group: str) -> DataFrame:
    """Both lists by key: the better score counts, a missing one reads 0."""
    both = vector.select(*keys, F.col("score").alias("vector_score")).join(
        lexical.select(*keys, F.col("score").alias("lexical_score")), keys, "full"
    )
    filled = both.na.fill(0.0, ["vector_score", "lexical_score"])
    scored = filled.withColumn("score", F.greatest("vector_score", "lexical_score"))
    return top_k(scored, k, [group], [F.desc("score"), *[F.col(x) for x in keys if x != group]])


def retrieval_mode(n_vector: Column, n_lexical: Column, embedded: Column) -> Column:
    """Which search served a question."""
    return (
        F.when(~embedded, "lexical")
        .when((n_vector > 0) & (n_lexical > 0), "hybrid")
        .when(n_vector > 0, "vector")
        .otherwise("lexical")
    )


def rerank_score(source: Column, keyword: Column, section: Column) -> Column:
    """Three quarters retrieval, the rest keyword overlap and section intent."""
    return 0.75 * source + 0.15 * keyword + 0.10 * section
