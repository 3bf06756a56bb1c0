"""Word windows of pages, and what else is measured on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import words as W

SIZE, OVERLAP = 900, 120


def _windows(text: Column, size: int, overlap: int) -> Column:
    """The windows of a text: an array of (word_start, n_words, chunk)."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("a window needs a positive size and a smaller overlap")
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")

    def cut(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(size - overlap))
        taken = lambda s: F.slice(words, s + 1, size)
        window = lambda s: F.struct(s.alias("word_start"), F.size(taken(s)).alias("n_words"), F.array_join(taken(s), " ").alias("chunk"))
        return F.filter(F.transform(starts, window), lambda w: w["n_words"] > 0)

    return F.get(F.transform(F.array(tokens), cut), F.lit(0))


def windows(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, word_start, n_words, chunk): windows of ``size`` words, each beginning ``size - overlap`` after the last.

    The last window is kept even if the one before covers it.
    """
    return docs.select(key, F.explode(_windows(F.col(text), size, overlap)).alias("x")).select(key, "x.*")


def chunks(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The usable windows that are no tables of contents, numbered per document from 0; no row leaves its place for it."""
    kept = F.filter(_windows(F.col(text), size, overlap), lambda w: W.usable(w["chunk"]) & ~W.contents_like(w["chunk"]))
    numbered = docs.select(key, F.posexplode(kept).alias("chunk_index", "x"))
    return numbered.select(key, "chunk_index", "x.word_start", "x.n_words", W.letter_density(F.col("x.chunk")).alias("density"), "x.chunk")


def parse_quality(pages: DataFrame, key: str, text: str = "text", source: str = "text_source") -> DataFrame:
    """Per document: pages, pages with text, empty and low pages, sizes, low-page ratio, and its verdict with warnings.

    Where pages tell their text_source, ocr_confidence and ocr_duration_ms, so do the
    pages of each source, the mean confidence and the time spent.
    """
    n = F.length(W.collapsed(F.col(text)))
    sized = pages.withColumn("n_text", n)
    known = F.coalesce(F.col(source), F.lit("native")) if source in pages.columns else F.lit("native")
    confidence = F.col("ocr_confidence") if "ocr_confidence" in pages.columns else F.lit(None).cast("double")
    duration = F.col("ocr_duration_ms") if "ocr_duration_ms" in pages.columns else F.lit(0)
    counted = sized.groupBy(key).agg(
        F.count("*").alias("pages"),
        F.count_if(F.col("n_text") >= 20).alias("text_pages"),
        F.count_if(F.col("n_text") == 0).alias("empty_pages"),
        F.count_if(F.col("n_text") < 80).alias("low_pages"),
        F.sum("n_text").alias("total_chars"),
        F.bround(F.avg("n_text"), 2).alias("mean_chars"),
        *[F.count_if(known == x).alias(f"{x}_pages") for x in ("native", "ocr", "hybrid")],
        F.bround(F.avg(confidence.cast("double")), 2).alias("ocr_confidence"),
        F.coalesce(F.sum(F.coalesce(duration, F.lit(0))), F.lit(0)).cast("long").alias("ocr_duration_ms"),
    )
    ratio = F.col("low_pages") / F.col("pages")
    verdict = counted.withColumn("scan_likelihood", scan_likelihood(ratio)).withColumn("low_ratio", F.bround(ratio, 4))
    return verdict.withColumn("warnings", warnings(F.col("scan_likelihood")))


def scan_likelihood(ratio: Column) -> Column:
    return F.when(ratio >= 0.75, "high").when(ratio >= 0.35, "medium").otherwise("low")


def warnings(likelihood: Column) -> Column:
    """What a document's reader is told about its text."""
    found = F.when(likelihood == "high", "This PDF has very little extractable text and may need OCR.").when(
        likelihood == "medium", "Some pages have sparse extractable text."
    )
    return F.array_compact(F.array(found))


def ocr_quality(confidence: Column) -> Column:
    return F.when(confidence.isNull(), "unknown").when(confidence >= 85, "strong").when(confidence >= 65, "moderate").otherwise("weak")


def page_density(chars: Column, width: Column, height: Column) -> Column:
    """Characters per thousand units of area; 0 without an area."""
    area = F.coalesce(width * height, F.lit(0.0))
    return F.when(area <= 0, F.lit(0.0)).otherwise(chars / area * 1000)


def sparse_pages(pages: DataFrame, key: str, page: str = "page_number", text: str = "text", most: int = 25) -> DataFrame:
    """The first ``most`` pages per document with fewer than 80 characters: those that need OCR."""
    order = Window.partitionBy(key).orderBy(page)
    low = pages.where(F.length(W.collapsed(F.col(text))) < 80)
    return low.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most).drop("turn")


def merge_ocr(native: DataFrame, ocr: DataFrame, keys: list[str]) -> DataFrame:
    """Native and recognized text of each page: whichever there is, or both on lines of their own."""
    both = native.join(ocr.withColumnRenamed("text", "ocr_text"), keys, "left")
    seen, found = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("ocr_text"), F.lit(""))
    text = F.when(found == "", seen).when(seen == "", found).otherwise(F.concat_ws("\n", seen, found))
    source = F.when(found == "", "native").when(seen == "", "ocr").otherwise("hybrid")
    return both.withColumns({"text": text, "text_source": source}).drop("ocr_text")


# Stages with their labels and the progress that a document shows while each is active, and what it says then.
STAGES = (
    ("upload", "Upload saved", 10, "Upload saved. Waiting to start document processing."),
    ("extract", "Text extracted", 25, "Extracting readable text and page structure."),
    ("ocr", "OCR completed", 40, "Running OCR for scanned or image-only pages."),
    ("chunk", "Chunks created", 60, "Creating page-aware evidence chunks."),
    ("embed", "Embeddings stored", 80, "Embedding evidence chunks for semantic search."),
    ("ready", "Ready", 100, "Document is indexed and ready for search."),
    ("failed", "Needs attention", 0, "Document processing needs attention."),
)
RECOGNIZING = ("ocr_processing", "deferred_ocr")


def _counted(n: Column, what: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {what}"), F.when(n == 1, "").otherwise("s"))


def processing_status(docs: DataFrame) -> DataFrame:
    """Adds stage, progress, message and stages (key, label, status, detail) to (status, n_pages, n_chunks).

    n_embedded, n_ocr_pages and error_message count where there are such columns.
    """
    given = lambda c, other: F.col(c) if c in docs.columns else other
    status, pages, chunks = F.col("status"), F.col("n_pages"), F.col("n_chunks")
    embedded, ocr = given("n_embedded", F.lit(0)), given("n_ocr_pages", F.lit(0))
    error = given("error_message", F.lit(None).cast("string"))
    active = (
        F.when(status == "indexed", "ready")
        .when(status == "failed", "failed")
        .when(status.isin(*RECOGNIZING), "ocr")
        .when(status == "embedding", "embed")
        .when(status == "uploaded", "upload")
        .when(pages == 0, "extract")
        .when(chunks == 0, "chunk")
        .otherwise("embed")
    )
    done = {
        "upload": status != "uploaded", "extract": pages > 0, "ocr": (ocr > 0) & (status != "ocr_processing"), "chunk": chunks > 0,
        "embed": (chunks > 0) & (embedded == chunks), "ready": F.lit(False), "failed": F.lit(False),
    }
    there = {"ocr": status.isin(*RECOGNIZING) | (ocr > 0), "failed": status == "failed"}
    details = {
        "extract": F.when(pages > 0, _counted(pages, "page")),
        "ocr": F.when(status == "deferred_ocr", error).otherwise(_counted(ocr, "OCR page")),
        "chunk": F.when(chunks > 0, _counted(chunks, "chunk")),
        "embed": F.when(chunks > 0, F.concat(embedded.cast("string"), F.lit("/"), chunks.cast("string"), F.lit(" embedded"))),
        "failed": error,
    }
    none = F.lit(None).cast("string")

    def state(key: str) -> Column:
        broken = F.lit(key == "failed") | (F.lit(key == "ocr") & (status == "deferred_ocr"))
        return (
            F.when(status == "indexed", "complete").when(broken, "failed").when(F.col("stage") == key, "active")
            .when(done[key], "complete").otherwise("pending")
        )

    rows = [
        F.when(there.get(key, F.lit(True)), F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), state(key).alias("status"), details.get(key, none).alias("detail")))
        for key, label, _, _ in STAGES
    ]
    by_stage = lambda at: F.create_map(*[F.lit(x) for row in STAGES for x in (row[0], row[at])])
    listed = docs.withColumn("stage", active).withColumn("stages", F.array_compact(F.array(*rows)))
    complete = F.size(F.filter("stages", lambda x: x["status"] == "complete"))
    failed = F.when((pages == 0) & (chunks == 0), 0).otherwise(F.bround(complete * 100 / F.size("stages")))
    progress = F.when(F.col("stage") == "failed", failed).otherwise(F.try_element_at(by_stage(2), F.col("stage")))
    told = F.when(status.isin("failed", "deferred_ocr"), error)
    return listed.withColumns({"progress": progress.cast("int"), "message": F.coalesce(told, F.try_element_at(by_stage(3), F.col("stage")))})
