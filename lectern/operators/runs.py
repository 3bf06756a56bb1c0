"""Benchmark cases and runs: ownership, review and staleness, states of a run, and what its results add up to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import words as W
from lectern.operators.evaluation import ratio

# States of a run, which of them hold the one active place, and the metrics of tagged cases.
ACTIVE = ("queued", "running")
MOVES = {
    ("queued", "start"): "running",
    ("queued", "cancel"): "cancelled",
    ("running", "cancel"): "cancelled",
    ("running", "finish"): "completed",
    ("queued", "interrupt"): "interrupted",
    ("running", "interrupt"): "interrupted",
    ("queued", "fail"): "failed",
    ("running", "fail"): "failed",
}
TAGS = {"table_case_pass_rate": "table", "multi_part_case_pass_rate": "multi-part"}
INTERRUPTED = "Backend restarted before this run finished; completed results were retained."


def next_state(state: Column, event: Column) -> Column:
    """Where an event takes a run; an event that its state doesn't know changes nothing."""
    known = F.create_map(*[F.lit(x) for (s, e), to in MOVES.items() for x in (f"{s}|{e}", to)])
    return F.coalesce(F.try_element_at(known, F.concat_ws("|", state, event)), state)


def replay(runs: DataFrame, events: DataFrame, run: str = "run_id", order: str = "seq") -> DataFrame:
    """(run, status): runs (status) after their events in order, which are few for each."""
    listed = events.groupBy(run).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "event"))), lambda e: e["event"]).alias("events"))
    both = runs.join(listed, run, "left").withColumn("events", F.coalesce("events", F.array().cast("array<string>")))
    return both.withColumn("status", F.aggregate("events", F.col("status"), next_state)).drop("events")


def interrupted(runs: DataFrame) -> DataFrame:
    """Runs that were active when the service stopped are interrupted; their results stay."""
    active = F.col("status").isin(*ACTIVE)
    return runs.withColumns({"error": F.when(active, INTERRUPTED).otherwise(F.col("error")), "status": next_state(F.col("status"), F.lit("interrupt"))})


def next_case(state: Column, cancel_requested: Column, completed: Column, total: Column) -> Column:
    """What a running run does between two cases: it is cancelled, done, or goes on."""
    return F.when(state != "running", "stop").when(cancel_requested, "cancel").when(completed >= total, "finish").otherwise("run")


def free_slot(runs: DataFrame) -> DataFrame:
    """One row: whether a new run may begin, as one is active at most."""
    return runs.agg((F.count_if(F.col("status").isin(*ACTIVE)) == 0).alias("free"))


def owned(cases: DataFrame, suites: DataFrame, docs: DataFrame) -> DataFrame:
    """Cases whose suite and document exist."""
    return cases.join(suites.select("suite_id"), "suite_id", "left_semi").join(docs.select("document_id"), "document_id", "left_semi")


def with_chunks(docs: DataFrame, chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents that have a chunk at all."""
    return docs.join(chunks.select(key), key, "left_semi")


def updated(cases: DataFrame, changes: DataFrame, key: str, content: list[str]) -> DataFrame:
    """Cases with their new content; one that really changed is a new version, a draft, and no longer reviewed."""
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in content], F.lit(True).alias("given"))
    both = cases.join(new, key, "left")
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"new_{c}")) for c in content])
    changed = F.coalesce(F.col("given"), F.lit(False)) & differs
    columns = {c: F.when(changed, F.col(f"new_{c}")).otherwise(F.col(c)) for c in content}
    columns |= {
        "content_version": F.col("content_version") + changed.cast("int"),
        "review_state": F.when(changed, "draft").otherwise(F.col("review_state")),
        "review_hashes": F.when(changed, F.create_map().cast("map<string,string>")).otherwise(F.col("review_hashes")),
    }
    return both.select(*[columns.get(c, F.col(c)).alias(c) for c in cases.columns])


def page_hashes(cases: DataFrame, pages: DataFrame, document: str = "document_id", page: str = "page_number") -> DataFrame:
    """(case_id, hashes): the hash of each page that a case rests on, its anchors' pages or, for a negative one, all."""
    hashed = pages.select(document, F.col(page).alias("n"), W.page_hash(F.col("text")).alias("hash"))
    both = cases.select("case_id", document, "negative", "anchor_pages").join(hashed, document)
    used = both.where(F.col("negative") | F.array_contains("anchor_pages", F.col("n")))
    return used.groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col("n").cast("string"), "hash")))).alias("hashes"))


def same_hashes(expected: Column, found: Column) -> Column:
    """Whether two maps of page hashes are equal, whatever their order."""
    entries = lambda m: F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))))
    return entries(expected) == entries(found)


def readiness(cases: DataFrame) -> DataFrame:
    """Adds availability and reason to cases (document_status, has_file, review_state, n_pages, fresh, unresolved, has_chunks).

    fresh: whether the pages are as they were when reviewed; unresolved: anchors
    that no run of chunks holds. A document comes before review, and review
    before its sources.
    """
    sure = lambda c: F.coalesce(F.col(c), F.lit(False))
    reasons = (
        ("unavailable", F.col("document_status").isNull(), "The selected document is no longer available."),
        ("unavailable", (F.col("document_status") != "indexed") | ~sure("has_file"), "Document must be indexed and its local file must exist."),
        ("draft", F.col("review_state") != "reviewed", "This case has not been reviewed."),
        ("stale", F.coalesce("n_pages", F.lit(0)) == 0, "Document pages are missing; review the source again."),
        ("stale", ~sure("fresh"), "Source pages changed after review; review the case again."),
        ("stale", F.coalesce("unresolved", F.lit(0)) > 0, "A quote is not represented in the indexed chunks of its page."),
        ("unavailable", ~sure("has_chunks"), "Document has no indexed evidence; restore its index before evaluation."),
    )
    state, why = F.lit("ready"), F.lit(None).cast("string")
    for name, holds, text in reversed(reasons):
        state, why = F.when(holds, name).otherwise(state), F.when(holds, text).otherwise(why)
    return cases.withColumns({"availability": state, "reason": why})


def review_refusal(cases: DataFrame) -> DataFrame:
    """Adds refusal: why a case (negative, n_facts, n_anchors, review_rationale, content_version, asked_version) can't be reviewed; null if it can."""
    positive = ~F.col("negative") & ((F.col("n_facts") == 0) | (F.col("n_anchors") == 0))
    negative = F.col("negative") & ((F.col("n_facts") > 0) | (F.btrim(F.coalesce("review_rationale", F.lit(""))) == ""))
    why = (
        F.when(F.col("content_version") != F.col("asked_version"), "Case changed; reload and review the current version.")
        .when(positive, "Answerable cases require expected facts and source quotes.")
        .when(negative, "Negative cases require a scope-review rationale and no required facts.")
    )
    return cases.withColumn("refusal", why)


def measurements(results: DataFrame, scores: DataFrame) -> DataFrame:
    """(metric, numerator, denominator, value) over the cases that passed or failed, with the pass rates of tagged ones.

    ``results`` has case_id, status and tags; ``scores`` case_id, metric, numerator and denominator.
    """
    scored = results.where(F.col("status").isin("pass", "fail"))
    sums = scores.join(scored.select("case_id"), "case_id", "left_semi").groupBy("metric").agg(F.sum("numerator").alias("numerator"), F.sum("denominator").cast("long").alias("denominator"))
    names = F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(t).alias("tag")) for n, t in TAGS.items()])
    tagged = scored.select("status", "tags", F.explode(names).alias("x")).groupBy("x.metric").agg(
        F.count_if(F.array_contains("tags", F.col("x.tag")) & (F.col("status") == "pass")).cast("double").alias("numerator"),
        F.count_if(F.array_contains("tags", F.col("x.tag"))).alias("denominator"),
    )
    both = sums.unionByName(tagged)
    return both.withColumn("value", ratio(F.col("numerator"), F.col("denominator")))


def golden_summary(cases: DataFrame) -> DataFrame:
    """One row: cases, passes, pass rate to four digits, and histograms of types and dimensions, for (passed, expected_status, document_type, quality_dimension)."""
    named = cases.select(F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("name")) for c in ("document_type", "quality_dimension")])).alias("x"))
    counts = named.groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))
    histogram = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.struct("name", "n"))))).alias(f"{c}s")
    n = F.count("*")
    totals = cases.agg(
        n.alias("total"), F.count_if("passed").alias("passed"), F.count_if(F.col("expected_status") == "answerable").alias("answerable"),
        F.coalesce(F.round(F.try_divide(F.count_if("passed"), n), 4), F.lit(0.0)).alias("pass_rate"),
    )
    # One row each.
    histograms = counts.agg(histogram("document_type"), histogram("quality_dimension"))
    return totals.withColumn("one", F.lit(1)).join(histograms.withColumn("one", F.lit(1)), "one").drop("one")


def mean_metrics(scores: DataFrame, cases: DataFrame, eligible: dict[str, Column]) -> DataFrame:
    """(metric, value): means, to four digits, of each metric over the cases that it is for."""
    both = scores.join(cases, "case_id")
    holds = reduce(lambda a, b: a | b, [(F.col("metric") == m) & c for m, c in eligible.items()])
    return both.where(holds).groupBy("metric").agg(F.round(F.avg("value"), 4).alias("value"))


def cited_hits(cited: DataFrame, trace: DataFrame, pack: DataFrame, keys: list[str]) -> DataFrame:
    """The hits that citations name, where the trace or the pack has them, each once."""
    seen = trace.unionByName(pack).dropDuplicates(keys)
    return seen.join(cited.select(*keys), keys, "left_semi")
