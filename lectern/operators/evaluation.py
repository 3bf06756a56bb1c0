"""Metrics of retrieval and answers, as ratios that keep their numerators and denominators."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hit_rate(expected: Column, ranked: Column, k: int) -> Column:
    """1 where one of the first k is expected."""
    if k <= 0:
        raise ValueError("k must be positive")
    return F.arrays_overlap(expected, F.slice(ranked, 1, k)).cast("double")


def reciprocal_rank(expected: Column, ranked: Column) -> Column:
    """One over the place of the first expected item; 0 without any."""
    places = F.filter(F.transform(expected, lambda e: F.array_position(ranked, e)), lambda p: p > 0)
    return F.coalesce(1 / F.array_min(places), F.lit(0.0))


def citation_accuracy(expected: Column, cited: Column) -> Column:
    """Expected among the cited; without any expected, 1 if none is cited."""
    none = F.size(F.array_distinct(cited)) == 0
    right = F.size(F.array_intersect(expected, cited)) / F.size(F.array_distinct(cited))
    return F.when(F.size(expected) == 0, none.cast("double")).when(none, F.lit(0.0)).otherwise(right)


def abstention_safety(answerable: Column, abstained: Column) -> Column:
    """1 where a question was answered if it can be, and not if it cannot."""
    return (answerable != abstained).cast("double")


def hallucination_risk(unsupported: Column, total: Column) -> Column:
    return F.when(total <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), unsupported / total)))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null where there is nothing to divide by."""
    return numerator / F.nullif(denominator, F.lit(0))


def ratios_of_sums(measured: DataFrame, group: list[str], value: str = "numerator", of: str = "denominator") -> DataFrame:
    summed = measured.groupBy(*group).agg(F.sum(value).alias("numerator"), F.sum(of).alias("denominator"))
    return summed.withColumn("value", ratio(F.col("numerator"), F.col("denominator")))


def failed_metrics(metrics: Column, required: list[str]) -> Column:
    """Required metrics of a map that are not exactly 1; a missing one has failed too."""
    names = F.array(*[F.lit(r) for r in required])
    return F.filter(names, lambda n: F.coalesce(F.try_element_at(metrics, n), F.lit(-1.0)) != 1.0)


def stored_retrieval_metrics(log: DataFrame, question: str, rank: str, k: int = 5) -> DataFrame:
    """Share of questions with a logged rank up to k, and the mean reciprocal of the best; zeros without any."""
    best = log.groupBy(question).agg(F.min(rank).alias("best"))
    return best.agg(
        F.coalesce(F.avg((F.col("best") <= k).cast("double")), F.lit(0.0)).alias("hit_rate"),
        F.coalesce(F.avg(1 / F.col("best")), F.lit(0.0)).alias("mrr"),
    )


def fact_tokens(text: Column) -> Column:
    """Words, signed numbers and comparisons in order; thousands are joined, n't is not."""
    plain = F.regexp_replace(F.lower(text), r"(?<=[0-9]),(?=[0-9]{3}(?:[^0-9]|$))", "")
    plain = F.replace(F.regexp_replace(plain, r"n['’]t\b", " not"), F.lit("−"), F.lit("-"))
    return F.regexp_extract_all(plain, F.lit(r"[a-z][a-z0-9]*|[+-]?[0-9]+(?:\.[0-9]+)?|[<>]=?|[=%+]"), F.lit(0))


def says(answer: Column, pattern: Column) -> Column:
    """Whether one sentence of the answer holds the pattern's tokens in a row, denied as often."""
    wanted = fact_tokens(pattern)
    denied = lambda tokens: F.size(F.filter(tokens, lambda t: t.isin("not", "no", "never", "without", "neither", "cannot")))
    sentences = F.split(answer, r"(?i)(?<!\bal\.)(?<=[.!?])\s+")

    def holds(tokens: Column) -> Column:
        last = F.size(tokens) - F.size(wanted)
        starts = F.when(last >= 0, F.sequence(F.lit(1), last + 1)).otherwise(F.array().cast("array<int>"))
        return (F.size(wanted) > 0) & F.exists(starts, lambda i: F.slice(tokens, i, F.size(wanted)) == wanted) & (denied(tokens) == denied(wanted))

    return F.exists(F.transform(sentences, fact_tokens), holds)


def source_text(text: str) -> str:
    """Words that a hyphen and white space cut become whole, and white space collapses."""
    return " ".join(re.sub(r"(?<=[A-Za-z])-\s+(?=[A-Za-z])", "", text).split())


def join_sources(texts: Iterable[str]) -> str:
    """One text of overlapping ones: the longest end of what is there that begins the next, up to a word's end, counts once."""
    joined = ""
    for text in map(source_text, texts):
        shared = 0
        for size in range(min(len(joined), len(text)), 0, -1):
            if joined.endswith(text[:size]) and (size == len(text) or text[size].isspace()):
                shared = size
                break
        joined = joined + text[shared:] if shared else f"{joined} {text}" if joined else text
    return joined


def readiness(indexed: Column, reviewed: Column, fresh: Column | None = None) -> Column:
    """Whether a case can be run: its document indexed, itself reviewed, and the pages as they were then."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    stale = ~sure(fresh) if fresh is not None else F.lit(False)
    return F.when(~sure(reviewed), "draft").when(~sure(indexed), "unavailable").when(stale, "stale").otherwise("ready")


def case_scores(results: DataFrame) -> DataFrame:
    """Measurements of every case as (case_id, metric, numerator, denominator).

    ``results`` has, per case: negative, answered, facts_said, n_facts, anchors_recalled,
    anchors_cited, anchors_packed, n_anchors, right_citations, n_citations,
    sentences_verified, n_sentences and duration_ms. What only a positive case
    can show has denominator 0 for a negative one.
    """
    positive = (~F.col("negative")).cast("int")
    abstained = (F.col("negative") & ~F.col("answered")).cast("int")
    right = (F.col("negative") != F.col("answered")).cast("int")
    shown = lambda n, d: (F.col(n) * positive, F.col(d) * positive)
    pairs = {
        "outcome_match": (right, F.lit(1)),
        "fact_match": shown("facts_said", "n_facts"),
        "retrieval_anchor_recall_at_5": shown("anchors_recalled", "n_anchors"),
        "citation_precision": shown("right_citations", "n_citations"),
        "citation_anchor_coverage": shown("anchors_cited", "n_anchors"),
        "pack_anchor_coverage": shown("anchors_packed", "n_anchors"),
        "abstention_match": (abstained, F.col("negative").cast("int")),
        "checker_support": (F.col("sentences_verified"), F.col("n_sentences")),
        "latency": (F.col("duration_ms"), F.lit(1)),
    }
    rows = [F.struct(F.lit(k).alias("metric"), n.cast("double").alias("numerator"), d.cast("int").alias("denominator")) for k, (n, d) in pairs.items()]
    return results.select("case_id", F.explode(F.array(*rows)).alias("m")).select("case_id", "m.*")


#: What a case must show to pass, by whether it is answerable.
REQUIRED = {
    False: (
        "outcome_match", "fact_match", "retrieval_anchor_recall_at_5", "citation_precision", "citation_anchor_coverage",
        "pack_anchor_coverage", "checker_support",
    ),
    True: ("outcome_match", "abstention_match"),
}


def case_verdicts(scores: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, negative, failed): the required metrics of each case that are not exactly 1; passed without any."""
    both = scores.join(cases.select("case_id", "negative"), "case_id")
    names = lambda v: F.array(*[F.lit(n) for n in REQUIRED[v]])
    needed = F.array_contains(F.when(F.col("negative"), names(True)).otherwise(names(False)), F.col("metric"))
    bad = F.coalesce(ratio(F.col("numerator"), F.col("denominator")), F.lit(-1.0)) != 1.0
    failed = F.array_sort(F.collect_set(F.when(needed & bad, F.col("metric"))))
    return both.groupBy("case_id", "negative").agg(failed.alias("failed")).withColumn("passed", F.size("failed") == 0)
