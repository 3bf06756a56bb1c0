"""Cases with known answers, run through the same rules that answer any question, and what they come to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import chunks as C
from lectern.operators import routing as R
from lectern.operators.document_answers import document_answers

ABSTAINS = "insufficient_evidence"


def answered(cases: DataFrame, pages: DataFrame) -> DataFrame:
    """``cases`` (case_id, document_key, question) with intent, status, answer and document_type, from pages (document_key, filename, page_number, text)."""
    routed = cases.withColumn("intent", R.intent(F.col("question")))
    asked = routed.select("case_id", "document_key", "question", "intent").join(pages, "document_key").drop("document_key")
    return routed.join(document_answers(asked, "case_id"), "case_id", "left")


def judged(found: DataFrame) -> DataFrame:
    """Adds failures and passed to answered cases (expected_status, expected_terms, expected_intent).

    An intent that the document's rules leave to the search abstains here.
    """
    status = F.when(F.coalesce(F.col("status"), F.lit("fall_through")) == "answerable", "answerable").otherwise(ABSTAINS)
    said = F.lower(F.coalesce("answer", F.lit("")))
    lacking = F.filter(F.coalesce("expected_terms", F.array().cast("array<string>")), lambda t: ~F.contains(said, F.lower(t)))
    reasons = F.array_compact(
        F.array(
            F.when(status != F.col("expected_status"), F.concat(F.lit("status is "), status)),
            F.when((F.col("expected_status") == "answerable") & (F.size(lacking) > 0), F.concat(F.lit("lacks "), F.array_join(lacking, ", "))),
            F.when(F.col("expected_intent").isNotNull() & (F.col("intent") != F.col("expected_intent")), F.concat(F.lit("intent is "), F.col("intent"))),
        )
    )
    return found.withColumns({"status": status, "failures": reasons}).withColumn("passed", F.size("failures") == 0)


def evaluate(cases: DataFrame, pages: DataFrame) -> DataFrame:
    """Every case with its answer, its failures and whether it passed; ``runs.golden_summary`` adds them up."""
    return judged(answered(cases, pages))


def reading(cases: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Cases on how well documents can be read, with their failures and whether they passed.

    ``cases`` has case_id, document_key, question, quality_dimension, expected_status, expected_terms, and what is expected
    where it isn't null: expected_likelihood, expected_sparse (pages that need recognition) and expected_document_status;
    ``documents`` document_key, status and error_message; ``pages`` document_key, page_number and text. What a reader is told
    is the first warning, else the document's message; a document without pages has but the latter. Nothing is answered.
    """
    found = C.parse_quality(pages, "document_key").select("document_key", "low_pages", "scan_likelihood", "warnings")
    joined = cases.join(documents.select("document_key", F.col("status").alias("document_status"), "error_message"), "document_key", "left").join(found, "document_key", "left")
    told = F.coalesce(F.try_element_at("warnings", F.lit(1)), "error_message", F.lit(""))
    sparse = F.coalesce("low_pages", F.lit(0))
    lacking = F.filter(F.coalesce("expected_terms", F.array().cast("array<string>")), lambda t: ~F.contains(F.lower(told), F.lower(t)))

    def differs(expected: str, got, what: str):
        wrong = F.col(expected).isNotNull() & ~F.col(expected).cast("string").eqNullSafe(got.cast("string"))
        return F.when(wrong, F.concat(F.lit(f"{what} is "), F.coalesce(got.cast("string"), F.lit("unknown"))))

    reasons = F.array_compact(
        F.array(
            differs("expected_likelihood", F.col("scan_likelihood"), "likelihood"),
            differs("expected_sparse", sparse, "number of sparse pages"),
            differs("expected_document_status", F.col("document_status"), "document"),
            F.when(F.col("expected_status") != ABSTAINS, F.lit(f"status is {ABSTAINS}")),
            F.when(F.size(lacking) > 0, F.concat(F.lit("lacks "), F.array_join(lacking, ", "))),
        )
    )
    shown = joined.select(*cases.columns, F.col("quality_dimension").alias("document_type"), F.lit(ABSTAINS).alias("status"), told.alias("quality_reason"), reasons.alias("failures"))
    return shown.withColumn("passed", F.size("failures") == 0)
