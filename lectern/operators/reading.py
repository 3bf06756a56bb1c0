"""Read models: what lists, pages, hits, suites and study aids show, as plans over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import words as W
from lectern.operators import chunks as C
from lectern.operators.ranking import first_rows, recent


def image_url(document: Column, page: Column) -> Column:
    return F.concat(F.lit("/documents/"), document.cast("string"), F.lit("/pages/"), page.cast("string"), F.lit("/image"))


def page_url(document: Column, page: Column, chunk: Column) -> Column:
    return F.concat(F.lit("/documents/"), document.cast("string"), F.lit("?page="), page.cast("string"), F.lit("&chunk="), chunk.cast("string"))


def snippet(text: Column) -> Column:
    return W.truncated(text, 260)


def shown_hits(hits: DataFrame, cited: DataFrame, keys: list[str]) -> DataFrame:
    """Hits (document_id, page_number, chunk_id, text and scores) as they are shown, with links and role."""
    ids = cited.select(*keys, F.lit(True).alias("is_cited")).distinct()
    doc, page, chunk = F.col("document_id"), F.col("page_number"), F.col("chunk_id")
    return hits.join(ids, keys, "left").withColumns(
        {
            "role": F.when(F.col("is_cited"), "answer").otherwise("related"),
            "snippet": snippet(F.col("text")),
            "page_image_url": image_url(doc, page),
            "document_page_url": page_url(doc, page, chunk),
        }
    ).drop("is_cited")


def documents(docs: DataFrame, pages: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Every document with its counts of pages and chunks."""
    n_pages = pages.groupBy(key).agg(F.count("*").alias("page_count"))
    n_chunks = chunks.groupBy(key).agg(F.count("*").alias("chunk_count"))
    return docs.join(n_pages, key, "left").join(n_chunks, key, "left").na.fill(0, ["page_count", "chunk_count"])


def newest(rows: DataFrame, order: str, tie: str, most: int | None = None) -> DataFrame:
    """Rows in the order of lists, newest first; with a limit, by a top-k plan."""
    ordered = rows.orderBy(F.desc(order), tie)
    return ordered if most is None else ordered.limit(most)


def oldest(rows: DataFrame, order: str, tie: str) -> DataFrame:
    return rows.orderBy(order, tie)


def chunks_of_page(chunks: DataFrame, page: int, number: str = "page_number", index: str = "chunk_index") -> DataFrame:
    return chunks.where(F.col(number) == page).orderBy(index)


def page_reads(pages: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Pages (text, text_source, ocr_confidence, width, height) with their preview, counts, quality, state and whether they need review."""
    counted = chunks.groupBy(*keys).agg(F.count("*").alias("chunk_count"), F.sum("token_estimate").alias("token_estimate"))
    both = pages.join(counted, keys, "left").na.fill(0, ["chunk_count", "token_estimate"])
    chars = F.length(F.coalesce("text", F.lit("")))
    quality = page_quality(F.col("text_source"), F.col("ocr_confidence"))
    return both.withColumns(
        {
            "text_preview": W.page_preview(F.col("text")),
            "character_count": chars,
            "text_density": F.round(C.page_density(chars, F.col("width"), F.col("height")), 3),
            "ocr_quality": quality,
            "processing_status": page_state(quality),
            "needs_review": needs_review(F.col("text"), F.col("chunk_count"), quality),
        }
    )


def page_quality(source: Column, confidence: Column) -> Column:
    """Native text needs no recognition; of recognized text, how sure it is."""
    return F.when(source == "native", "native").when(confidence.isNull(), "missing").otherwise(C.ocr_quality(confidence))


def page_state(quality: Column) -> Column:
    return F.when(quality == "native", "native_text").when(quality == "missing", "missing_text").otherwise(F.concat(F.lit("ocr_"), quality))


def needs_review(text: Column, n_chunks: Column, quality: Column) -> Column:
    """A page without text or chunks, or with text that was badly recognized or not at all."""
    return (F.btrim(F.coalesce(text, F.lit(""))) == "") | (n_chunks == 0) | quality.isin("weak", "missing")


def dashboard(docs: DataFrame) -> DataFrame:
    """How many documents (status, warnings) are indexed, and all their warnings."""
    return docs.agg(
        F.count_if(F.col("status") == "indexed").alias("indexed"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).cast("long").alias("warnings")
    )


def unique_facts(facts: DataFrame, document: str, order: str) -> DataFrame:
    """Facts as they are shown: each label and value of a document once, case and blanks aside, the first in order."""
    shown = facts.withColumns({"own_label": W.collapsed(F.lower("label")), "own_value": W.collapsed(F.lower("value"))})
    return first_rows(shown, [document, "own_label", "own_value"], [F.col(order)]).drop("own_label", "own_value", "place")


def quality_badge(likelihood: Column, ocr_pages: Column) -> Column:
    return F.when(ocr_pages > 0, "OCR text").when(likelihood == "high", "Needs OCR").when(likelihood == "medium", "Sparse text").otherwise("Text ready")


def source_summary(counts: Column) -> Column:
    """The sources of a document's text with their pages, those without any left out: "2 native, 1 ocr"."""
    some = F.array_sort(F.map_entries(F.map_filter(counts, lambda _, n: n > 0)))
    return F.array_join(F.transform(some, lambda e: F.concat(e["value"].cast("string"), F.lit(" "), e["key"])), ", ")


def result_filter(results: DataFrame, name: str) -> DataFrame:
    """Results (status, human_assessment) of one of the lists All, Failed, Unavailable, Errors and Needs review."""
    status = F.col("status")
    kept = {
        "All": F.lit(True),
        "Failed": status == "fail",
        "Unavailable": status == "unavailable",
        "Errors": status == "error",
        "Needs review": F.col("human_assessment").isNull() | (F.col("human_assessment") == "needs_review"),
    }
    return results.where(kept[name])


def suites(all_suites: DataFrame, cases: DataFrame) -> DataFrame:
    """Every suite with how many cases it has and how many of them are reviewed."""
    counted = cases.groupBy("suite_id").agg(F.count("*").alias("case_count"), F.count_if(F.col("review_state") == "reviewed").alias("reviewed_count"))
    return all_suites.join(counted, "suite_id", "left").na.fill(0, ["case_count", "reviewed_count"])


def run_counters(results: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: results by state, fallbacks, and how often each retrieval mode served a scored case."""
    status = F.col("status")
    counts = results.groupBy(run).agg(
        F.count_if(status == "pass").alias("passed"),
        F.count_if(status == "fail").alias("failed"),
        F.count_if(status == "error").alias("errors"),
        F.count_if(status == "unavailable").alias("unavailable"),
        F.count_if(F.coalesce("fallback_reason", F.lit("")) != "").alias("fallbacks"),
    )
    modes = results.where(status.isin("pass", "fail") & F.col("retrieval_mode").isNotNull()).groupBy(run, "retrieval_mode").agg(F.count("*").alias("n"))
    listed = modes.groupBy(run).agg(F.array_sort(F.collect_list(F.struct("retrieval_mode", "n"))).alias("modes"))
    none = F.array().cast("array<struct<retrieval_mode:string,n:bigint>>")
    return counts.join(listed, run, "left").withColumn("modes", F.map_from_entries(F.coalesce("modes", none)))


def study_reads(questions: DataFrame, answers: DataFrame, key: str = "question_id") -> DataFrame:
    """Questions with whether they are grounded, how many answers they have, and the latest three."""
    given = recent(answers, [key], "answer_id", "created_at", "answer_id").withColumnRenamed("n", "answer_count")
    read = questions.withColumn("citation_quality", F.when(F.size("citations") > 0, "grounded").otherwise("ungrounded"))
    return read.join(given, key, "left").na.fill(0, ["answer_count"])


def pack_stats(items: DataFrame, group: list[str]) -> DataFrame:
    """Per evidence pack: chosen chunks, distinct pages, and their mean support to six digits."""
    return items.groupBy(*group).agg(
        F.count("*").alias("selected"),
        F.count_distinct(F.struct("document_id", "page_number")).alias("pages"),
        F.round(F.avg("support"), 6).alias("mean_support"),
    )


def ocr_totals(pages: DataFrame, key: str) -> DataFrame:
    """Per document: pages that were recognized, alone or beside native text, and the time it took."""
    return pages.groupBy(key).agg(
        F.count_if(F.col("text_source").isin("ocr", "hybrid")).alias("ocr_pages"),
        F.coalesce(F.sum(F.coalesce("ocr_duration_ms", F.lit(0))), F.lit(0)).cast("long").alias("ocr_duration_ms"),
    )


def full_text(pages: DataFrame, key: str, page: str = "page_number", text: str = "text") -> DataFrame:
    """(key, text): the pages of each document in order, a line each."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(page).alias("n"), F.coalesce(text, F.lit("")).alias("t"))))
    return pages.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text"))


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds a running number from 0."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
