"""What a document says about itself: its type, and the dates and amounts in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Date and amount formats. Patterns are tried one after the other over a page, and a year
# inside a longer date is a fact of its own.
MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*"
DATES = (
    r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b",
    rf"(?i)\b{MONTH}\.?\s+[0-9]{{1,2}}(?:st|nd|rd|th)?,?\s+[0-9]{{4}}\b",
    rf"(?i)\b[0-9]{{1,2}}(?:st|nd|rd|th)?\s+{MONTH}\.?\s+[0-9]{{4}}\b",
    r"\b(?:19|20)[0-9]{2}\b",
)
AMOUNTS = (r"(?i)\b(?:RM|USD|EUR|GBP|MYR|\$|€|£)\s?[0-9][0-9,]*(?:\.[0-9]{2})?\b",)
MOST = 12


def facts(pages: DataFrame, patterns: tuple[str, ...], key: str, page: str, text: str, most: int = MOST) -> DataFrame:
    """(key, place, value): the first ``most`` distinct values in order of page, pattern and place in the page."""
    found = F.flatten(
        F.array(
            *[
                _numbered(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)), k)
                for k, p in enumerate(patterns)
            ]
        )
    )
    rows = pages.select(key, page, F.explode(found).alias("f")).select(key, page, "f.pattern", "f.at", "f.value")
    first = rows.groupBy(key, "value").agg(F.min(F.struct(page, "pattern", "at")).alias("first"))
    order = Window.partitionBy(key).orderBy("first", "value")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(key, "place", "value")


def _numbered(values: Column, pattern: int) -> Column:
    return F.transform(values, lambda v, i: F.struct(F.lit(pattern).alias("pattern"), i.alias("at"), v.alias("value")))


# What phrases tell of a document's type; types in the order in which a tie is decided.
TYPE_WORDS = {
    "academic_report": {
        "academic session": 5, "assessment title": 5, "course code": 5, "course name": 5,
        "deep reinforcement learning": 2, "final report": 4, "lecturer": 4, "prepared by": 5,
        "project submission": 5, "student id": 4,
    },
    "research_paper": {
        "abstract": 4, "references": 3, "introduction": 2, "method": 2, "methodology": 2, "results": 2,
        "experiments": 2, "doi": 3, "et al": 2, "benchmark": 2, "dataset": 2, "table": 1, "figure": 1,
    },
    "resume": {
        "resume": 3, "curriculum vitae": 4, "education": 2, "experience": 2, "technical skills": 4, "projects": 2,
        "cgpa": 2, "linkedin": 1, "github": 1,
    },
    "invoice": {
        "invoice": 5, "bill to": 4, "subtotal": 3, "total due": 5, "balance due": 4, "payment terms": 3, "tax": 2,
        "due date": 3,
    },
    "contract": {
        "agreement": 4, "contract": 4, "parties": 3, "obligations": 4, "termination": 3, "governing law": 3,
        "confidentiality": 3, "whereas": 2, "shall": 2,
    },
    "report": {
        "executive summary": 4, "findings": 3, "recommendations": 3, "risk": 2, "analysis": 2, "next steps": 2,
        "objectives": 2,
    },
}
#: Said of an interface or a schema, a contract is none.
TECHNICAL = r"(?i)\b(?:feature|interface|state|data|observation|schema|api|dimensional|reward|action)\s+contract\b"


# Signs of an academic report, and what headings tell: (type, weight, headings, how many of them).
SIGNALS = (
    r"\bcourse\s+code\b", r"\bcourse\s+name\b", r"\bacademic\s+session\b", r"\bassessment\s+title\b", r"\bprepared\s+by\b",
    r"\bstudent\s+id\b", r"\bproject\s+submission\b", r"\bfinal\s+report\b", r"\blecturer\b",
)
PAPER_HEADINGS = (
    "ABSTRACT", "INTRODUCTION", "OVERVIEW", "OBJECTIVES", "RELATED WORK", "LITERATURE REVIEW", "METHODOLOGY", "METHOD", "METHODS",
    "APPROACH", "MODEL", "EXPERIMENT", "EXPERIMENTS", "EXPERIMENTAL SETUP", "EVALUATION", "RESULT", "RESULTS", "DISCUSSION",
    "LIMITATION", "LIMITATIONS", "FUTURE WORK", "CONCLUSION", "DATASET", "DATASETS",
)
BONUSES = (
    ("research_paper", 4, ("ABSTRACT",), 1), ("research_paper", 2, ("KEYWORDS",), 1), ("research_paper", 3, PAPER_HEADINGS, 2),
    ("research_paper", 5, ("ABSTRACT", "REFERENCES"), 2), ("invoice", 4, ("TOTAL", "PAYMENT SUMMARY", "INVOICE SUMMARY"), 1),
    ("contract", 4, ("OBLIGATIONS", "TERMINATION", "PARTIES"), 1), ("resume", 3, ("TECHNICAL SKILLS", "CORE SKILLS", "PROJECTS", "EDUCATION"), 1),
    ("report", 4, ("EXECUTIVE SUMMARY", "FINDINGS", "RECOMMENDATIONS"), 1),
)
#: With two signs a report is academic, the more so with these headings; with three it is no contract.
ACADEMIC_HEADINGS = ("OVERVIEW", "METHOD", "RESULTS")


def document_types(docs: DataFrame, key: str, text: str, filename: str | None = None, headings: str | None = None) -> DataFrame:
    """(key, document_type, type_score): most weight of the phrases that occur and the headings there are.

    Every text scores 1 as generic, which comes before all others; among equals
    types told by phrases come first, in their order, then those told by headings.
    """
    low = F.lower(F.concat_ws(" ", *([F.col(filename)] if filename else []), F.coalesce(F.col(text), F.lit(""))))
    plain = F.regexp_replace(low, TECHNICAL, " ")
    signs = sum((low.rlike(p).cast("int") for p in SIGNALS), F.lit(0))
    present = F.coalesce(F.col(headings), F.array().cast("array<string>")) if headings else F.array().cast("array<string>")
    named = lambda names, least: F.size(F.array_intersect(present, F.array(*[F.lit(n) for n in names]))) >= least
    read = docs.select(key, low.alias("low"), plain.alias("plain"), signs.alias("signs"), present.alias("present"))
    present, signs = F.col("present"), F.col("signs")
    scores = [F.struct(F.lit(1).alias("score"), F.lit(0).alias("rank"), F.lit("generic").alias("name"))]
    for rank, (name, phrases) in enumerate(TYPE_WORDS.items(), 1):
        where = F.col("plain" if name == "contract" else "low")
        weight = sum((F.when(where.contains(phrase), w).otherwise(0) for phrase, w in phrases.items()), F.lit(0))
        bonus = sum((F.when(named(names, least), w).otherwise(0) for t, w, names, least in BONUSES if t == name), F.lit(0))
        if name == "academic_report":
            bonus = F.when(signs >= 2, 6 + 2 * signs + F.when(named(ACADEMIC_HEADINGS, 1), 3).otherwise(0)).otherwise(0)
        if name == "contract":
            bonus = bonus - F.when(signs >= 3, 4).otherwise(0)
        place = F.when(weight > 0, -rank).otherwise(-rank - len(TYPE_WORDS))
        scores.append(F.struct((weight + bonus).alias("score"), place.alias("rank"), F.lit(name).alias("name")))
    best = read.select(key, F.array_max(F.array(*scores)).alias("best"))
    return best.select(key, F.col("best.name").alias("document_type"), F.col("best.score").alias("type_score"))
