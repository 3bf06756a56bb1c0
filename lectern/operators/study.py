"""Study aids: grading, questions, and summaries of leading sentences; ``likeness`` tells questions that ask the same."""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import words as W
from lectern.operators.evidence import sentences

# Stop words of grading, and the bands of a grade.
STOPWORDS = "a an and are as at be by for from how in is it of on or that the this to what with".split()
SIMILAR_STOPWORDS = "a about an and are as be by for from in is it of on or that the this to uses what which with".split()
STRONG, PARTIAL = 0.75, 0.4
SAME_WORDS, SAME_TEXT = 0.82, 0.88


def grading_words(text: Column) -> Column:
    return F.array_except(W.word_set(text), F.array(*[F.lit(w) for w in STOPWORDS]))


def grading_sql(text: str) -> str:
    """The same words in SQL."""
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return f"list_filter(list_distinct(regexp_extract_all(lower({text}), '[a-z0-9]+')), lambda w: NOT list_contains([{stop}], w))"


def grade(pairs: DataFrame, expected: str, given: str) -> DataFrame:
    """Adds n_expected, score (share of the expected words that are given), up to eight missing words, and the band."""
    e, g = F.col("__e"), F.col("__g")
    worded = pairs.withColumns({"__e": grading_words(F.col(expected)), "__g": grading_words(F.col(given))})
    score = F.when(F.size(e) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(e, g)) / F.size(e))
    graded = worded.withColumns(
        {"n_expected": F.size(e), "score": score, "missing": F.slice(F.array_sort(F.array_except(e, g)), 1, 8)}
    )
    band = F.when(F.col("score") >= STRONG, "strong").when(F.col("score") >= PARTIAL, "partial").otherwise("needs work")
    return graded.withColumn("band", band).drop("__e", "__g")


# What an answer's writer is told.
NOTHING_EXPECTED = "No expected answer was available for grading."
ALL_SAID = "Strong answer. It covers the key terms."
MISSING, NONE_SAID = "Missing terms: ", "No key terms matched. "


def evaluate(pairs: DataFrame, question: str, expected: str, given: str) -> DataFrame:
    """Adds score, to two digits, and feedback: the share of the expected words that an answer has, the question's where none are expected."""
    wanted = W.bound(grading_words(F.col(expected)), lambda e: F.when(F.size(e) > 0, e).otherwise(grading_words(F.col(question))))

    def told(e: Column) -> Column:
        said = grading_words(F.col(given))
        score = F.bround(F.size(F.array_intersect(e, said)) / F.size(e), 2)
        missing = F.array_sort(F.array_except(e, said))
        line = F.concat(F.lit(MISSING), F.array_join(F.slice(missing, 1, 8), ", "), F.lit("."))
        short = F.when(score == 0, F.concat(F.lit(NONE_SAID), line)).otherwise(line)
        result = lambda s, f: F.struct(s.alias("score"), f.alias("feedback"))
        return F.when(F.size(e) == 0, result(F.lit(0.0), F.lit(NOTHING_EXPECTED))).otherwise(
            F.when(F.size(missing) == 0, result(F.lit(1.0), F.lit(ALL_SAID))).otherwise(result(score, short))
        )

    return pairs.select("*", W.bound(wanted, told).alias("__told")).select(*pairs.columns, "__told.score", "__told.feedback")


def jaccard_pairs(items: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """(first_id, second_id, jaccard) of pairs that share at least that much of their words.

    Only pairs that share one of their rarest words meet: with a share of t, two sets of
    n words have a common word among the n - ceil(t * n) + 1 rarest of either.
    """
    sets = items.select(F.col(key).alias("id"), grading_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    spread = sets.select("id", F.explode("w").alias("word"), F.size("w").alias("n"))
    common = spread.groupBy("word").agg(F.count("*").alias("df"))
    ordered = spread.join(common, "word").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("s"))
    rare = ordered.select("id", F.explode(F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))).alias("x"))
    keyed = rare.select("id", F.col("x.word").alias("word"))
    a, b = keyed.withColumnRenamed("id", "first_id"), keyed.withColumnRenamed("id", "second_id")
    met = a.join(b, "word").where("first_id < second_id").select("first_id", "second_id").distinct()
    with_first = met.join(sets.withColumnsRenamed({"id": "first_id", "w": "w1"}), "first_id")
    with_both = with_first.join(sets.withColumnsRenamed({"id": "second_id", "w": "w2"}), "second_id")
    jaccard = F.size(F.array_intersect("w1", "w2")) / F.size(F.array_union("w1", "w2"))
    return with_both.select("first_id", "second_id", jaccard.alias("jaccard")).where(F.col("jaccard") >= least)


def similar(first: str, second: str) -> bool:
    """Whether two questions ask the same, by their words or letter by letter."""
    stop = set(SIMILAR_STOPWORDS)
    words = [{w for w in re.findall("[a-z0-9]+", t.lower()) if w not in stop and len(w) > 1} for t in (first, second)]
    if not all(words):
        return False
    shared = len(words[0] & words[1]) / len(words[0] | words[1])
    return shared >= SAME_WORDS or SequenceMatcher(None, first.lower(), second.lower()).ratio() >= SAME_TEXT


def context(text: Column) -> Column:
    """Lines of a context without page marks, contents and dotted leaders, joined by blanks."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(x))
    noise = lambda x: x.rlike(r"^Page\s+[0-9]+") | F.lower(x).contains("table of contents") | x.rlike(r"\.{4,}")
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~noise(x)), " ")


def summarize(docs: DataFrame, text: str, detailed: bool = False) -> DataFrame:
    """Adds summary: the first two sentences of the context, or three."""
    leading = F.slice(sentences(context(F.col(text)), r"(?<=[.!?])\s+"), 1, 3 if detailed else 2)
    none = F.lit("No usable context was available for summarization.")
    return docs.withColumn("summary", F.when(F.size(leading) == 0, none).otherwise(F.array_join(leading, " ")))


# Topics that questions are made of, in order.
TOPICS = (
    "overview objective", "design approach", "development pipeline", "training pipeline", "payment terms",
    "confidentiality obligations", "total amount", "contract parties", "datasets", "methods", "results", "limitations",
)
ASKING = {
    "exam": "Which evidence does the document give about {}?",
    "revision": "What should you remember about {}?",
    "balanced": "What does the document say about {}?",
}


def _python_words(text: str) -> set[str]:
    return {w for w in re.findall("[a-z0-9]+", text.lower()) if w not in STOPWORDS}


def make_questions(said: list[str], count: int, mode: str = "balanced") -> list[tuple[str, str]]:
    """(question, expected answer) pairs from sentences: known topics first, then each sentence's first two words."""
    shape = ASKING.get(mode, ASKING["balanced"])
    found: dict[str, str] = {}

    lowered = [s.lower() for s in said]
    whole = "\n".join(lowered)

    def about(topic: str) -> str | None:
        words = _python_words(topic)
        if not all(w in whole for w in words):
            return None
        named = next((s for s, low in zip(said, lowered) if topic in low), None)
        # Only a sentence that has the letters of all words is cut into words.
        return named or next((s for s, low in zip(said, lowered) if all(w in low for w in words) and words <= _python_words(low)), None)

    # Made one by one: later ones are not needed once there are enough.
    topics = ((t, about(t)) for t in TOPICS)
    leading = ((" ".join(sorted(_python_words(s))[:2]), s) for s in said)
    for topic, sentence in chain(topics, leading):
        if len(found) >= count:
            break
        if topic and sentence:
            found.setdefault(shape.format(topic), sentence)
    if not found and count > 0:
        found["What are the main points in this document?"] = " ".join(said[:2]) or "No usable context was available for summarization."
    return list(found.items())


def study_questions(docs: DataFrame, key: str, text: str, count: int, mode: str = "balanced") -> DataFrame:
    """(key, number, question, expected_answer): questions about every document."""
    split = docs.select(key, sentences(context(F.col(text)), r"(?<=[.!?])\s+").alias("said"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [
                (k, n, q, a)
                for k, said in zip(batch[key], batch["said"])
                for n, (q, a) in enumerate(make_questions(list(said), count, mode))
            ]
            yield pd.DataFrame(rows, columns=[key, "number", "question", "expected_answer"])

    return split.mapInPandas(run, f"`{key}` {kind}, number int, question string, expected_answer string")
