"""Answers from one document that is known: by its profile's facts, or the sections that serve an intent."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

from lectern.operators import papers
from lectern.operators.answers import words
from lectern.operators.profile import profile, shortened
from lectern.operators.routing import INVOICE_AMOUNTS
from lectern.operators.section_answers import LIMIT_PLACES, METRIC_WORDS, RESULT_CLAIMS, RESULT_PLACES, SETTINGS
from lectern.operators.sections import contents_like, split

# Where the evidence of an intent stands, and the words that tell it without a heading.
PLACES: dict[str, tuple[str, str]] = {
    "payment_due": ("PAYMENT TERMS|PAYMENT SUMMARY|PAYMENT", "payment due|due date|balance due|total due"),
    "payment_terms": ("PAYMENT TERMS|PAYMENT SUMMARY|PAYMENT", "payment terms|payment term|due date|balance due|total due"),
    "datasets": ("EXPERIMENTS|EVALUATION|RESULTS|DATASET|DATASETS", "dataset|datasets|benchmark|benchmarks|corpus"),
    "methods": (
        "METHODOLOGY|METHOD|METHODS|APPROACH|MODEL",
        "approach|architecture|attention|encoder|framework|fusion|method|model|module|pipeline|propose|proposed|temporal|transformer|visual",
    ),
    "results": ("RESULT|RESULTS|EVALUATION|FINDINGS|EXPERIMENTS", "result|accuracy|performance|top1|top5|f1|findings|improve"),
    "findings": ("RESULT|RESULTS|EVALUATION|FINDINGS|EXPERIMENTS", "result|accuracy|performance|top1|top5|f1|findings|improve"),
    "recommendations": ("RECOMMENDATIONS|NEXT STEPS|CONCLUSION", "recommendation|recommendations|recommend|should|next steps"),
    "skills": ("TECHNICAL SKILLS|CORE SKILLS|SKILLS", ""),
    "programming_language": ("PROGRAMMING LANGUAGES", ""),
    "frameworks": ("FRAMEWORKS & LIBRARIES|FRAMEWORKS AND LIBRARIES", ""),
    "tools": ("TOOLS & PLATFORMS|TOOLS AND PLATFORMS", ""),
    "projects": ("PROJECTS|KEY PROJECTS|PROJECT EXPERIENCE", ""),
    "education": ("EDUCATION", ""),
    "experience": ("EXPERIENCE|WORK EXPERIENCE|PROFESSIONAL EXPERIENCE|INTERNSHIP EXPERIENCE", ""),
}
RISKS = (
    "LIMITATION|LIMITATIONS|FUTURE WORK|DISCUSSION|RISKS|OBLIGATIONS|RESPONSIBILITIES|TERMINATION|LIABILITY|RECOMMENDATIONS",
    "limitation|limitations|future|challenge|risk|obligation|shall|must|responsible|termination|liability",
)
PLACES |= dict.fromkeys(("limitations", "risks", "obligations"), RISKS)
PARTIES = ("PARTIES|BILL TO|VENDOR|CLIENT", "between|bill to|vendor|client|customer|supplier")
#: Intents that facts answer: the kinds of fact, and what they are called.
FACTS = {
    "dates": ("date", "dates"), "payment_due": ("date", "dates"), "amounts": ("amount|percentage|metric", "amounts and metrics"),
    "parties": ("entity", "parties or entities"), "datasets": ("dataset", "datasets"),
}
RESUME = frozenset("skills programming_language frameworks tools projects education experience".split())
LEARNED = frozenset({"research_paper", "academic_report"})
MOST_CHUNKS, MOST_DATASETS, LONGEST = 3, 8, 480
# What makes a fact fit a question: (words of the question, where to look, words there, weight).
BOOSTS = (
    ("total", "label", "total", 6), ("due", "label", "due", 5), ("payment", "source", "payment", 2), ("payment", "label", "due", 2),
    ("issue", "label", "issue", 5), ("effective", "label", "effective", 5), ("subtotal", "label", "subtotal", 5), ("tax", "label", "tax", 5),
    ("billed to", "source", "bill to", 5), ("bill to", "source", "bill to", 5),
)
LIMIT_CLAIMS = frozenset(
    "adaptation bottleneck bottlenecks challenge challenges direction directions future goal limitation limitations limited mapping overcome refinement room".split()
)
AHEAD = r"\b(?:future research directions include|future directions include|future work|to address these challenges)\b"
ADMITS = re.compile(
    r"\b(?:future\s+(?:work|direction|directions|research|improvement|improvements)|further\s+(?:work|research)|limitation|limitations|limited\s+by"
    r"|remaining\s+(?:issue|issues|challenge|challenges)|could\s+be\s+improved|should\s+be\s+improved|we\s+(?:plan|recommend|suggest)\b)",
    re.I,
)
DECLARES = re.compile(r"\b(?:own\s+work\s+declaration|academic\s+misconduct|plagiarism|retained\s+for\s+future\s+comparisons)\b", re.I)
ADMITTING = ("CONCLUSION", "DISCUSSION", "FUTURE WORK", "LIMITATION", "LIMITATIONS", "NEXT STEPS", "RECOMMENDATIONS")
FRAGMENT = re.compile(r"^(?:and|but|or|unlike|where|which)\b|^\d+(?:-\d+)?\s+", re.I)
METHOD_WORDS = frozenset("architecture attention encoder framework fusion model module pipeline prompt temporal token transformer visual".split())
ASKING = frozenset("a an and are about does document discussed in is mentioned or reported the this used what which".split())
OPENINGS = {
    "research_paper": (("ABSTRACT",), ("INTRODUCTION", "CONCLUSION")),
    "other": (("ABSTRACT", "EXECUTIVE SUMMARY", "SUMMARY", "ABOUT ME", "OVERVIEW", "INTRODUCTION"),),
}
NONE_FOUND = {
    "dates": "No dates were detected in this document.",
    "payment_due": "No payment due date evidence was detected in this document.",
    "amounts": "No amounts, totals, or measurable metrics were detected in this document.",
    "parties": "No party, vendor, client, or bill-to evidence was detected in this document.",
    "authors": "No lecturer or prepared-by evidence was detected in this document.",
    "limitations": "No explicit limitations or future-work evidence was detected in this academic report.",
}
NO_INVOICE = "This document is a {}, so invoice totals or payment due amounts are not expected. Ask about {} instead."
TOPICS = {
    "academic_report": ("academic report", "objectives, methods, results, contributors, or limitations"),
    "research_paper": ("research paper", "metrics, datasets, results, methods, or limitations"),
}


def relevance(question: str, fact: dict) -> int:
    """Words that a question shares with a fact and its surroundings, and what boosts it; its label counts for what it names."""
    asked, norm = words(question), " ".join(re.findall("[a-z0-9]+", question.lower()))
    where = {"label": fact["label"].lower(), "source": fact["source_text"].lower()}
    shared = len(asked & words(f"{fact['label']} {fact['kind']} {fact['source_text']}"))
    once = {(place, needle): w for said, place, needle, w in BOOSTS if said in norm and needle in where[place]}
    measured = fact["kind"] == "metric" and any(w in norm for w in ("amount", "total", "metric", "number"))
    return shared + sum(once.values()) + measured


def best_facts(question: str, found: list[dict]) -> list[dict]:
    """The facts that fit a question best, three at most; where none fits, the first ones."""
    scores = [relevance(question, f) for f in found]
    best = max(scores, default=0)
    return [f for f, s in zip(found, scores) if best <= 0 or s == best][:MOST_CHUNKS]


def _named(name: str, found: list[dict]) -> str | None:
    return f"{name} mentioned: " + ", ".join(f"{f['label'][:1].upper()}{f['label'][1:]}: {f['value']}" for f in found) + "." if found else None


def from_facts(question: str, intent: str, found: list[dict]) -> str | None:
    """The facts of an intent's kinds: all data sets, else those that fit the question best."""
    kinds, name = FACTS[intent]
    fit = [f for f in found if f["kind"] in kinds.split("|")]
    if intent == "amounts" and any(f["kind"] == "amount" for f in fit):
        fit = [f for f in fit if f["kind"] == "amount"]
    if intent == "datasets":
        values = list(dict.fromkeys(f["value"] for f in fit))[:MOST_DATASETS]
        return f"Datasets mentioned: {', '.join(values)}." if values else None
    return _named(name.capitalize(), best_facts(question, fit))


def people(found: list[dict]) -> str | None:
    """Who made a report and who read it."""
    named = [f for label in ("Prepared by", "Lecturer") for f in found if f["kind"] == "academic_metadata" and f["label"] == label]
    return _named("Contributors", named)


def claim(section, intent: str) -> int:
    """How much a section of a paper claims for an intent."""
    body = papers.clean_paper(papers.after_heading(section.text, section.heading)).lower()
    said = words(body)
    ahead = re.search(AHEAD, body) is not None
    if intent == "results":
        points = 4 * (section.heading in RESULT_PLACES) + 2 * len(said & set(RESULT_CLAIMS)) + 3 * any(m in body for m in METRIC_WORDS)
        return points - 8 * (re.search(SETTINGS, body) is not None)
    points = 4 * (section.heading in LIMIT_PLACES) + 2 * len(said & LIMIT_CLAIMS) + 8 * ahead
    return points - 4 * (body.startswith("this paper presents") and not ahead)


def strongest(found: list, intent: str) -> list:
    """Sections whose claims come within two of the best, the strongest first; all where none claims anything."""
    if intent not in ("results", "limitations"):
        return found
    scores = [claim(s, intent) for s in found]
    best = max(scores, default=0)
    if best <= 0:
        return found
    kept = sorted((-n, i) for i, n in enumerate(scores) if n >= max(1, best - 2))
    return [found[i] for _, i in kept]


def told(section, question: str, intent: str, learned: bool, first: bool = False) -> str:
    """What a section says to a question: in papers its most telling sentence, else its body."""
    body = re.sub(rf"(?i)^\s*{re.escape(section.heading)}\s*[:.-]?\s*", "", section.text) or section.text if section.heading else section.text
    if not learned:
        return shortened(body, LONGEST)
    said = papers.sentences(body)
    if not said or FRAGMENT.match(said[0]):
        return ""
    said = [s for s in said if not FRAGMENT.match(s)]
    if first:
        return shortened(" ".join(said[: 3 if intent == "overview" else 1]), LONGEST)
    asked = words(question) - ASKING

    def telling(sentence: str) -> tuple[int, int]:
        own, low = words(sentence), sentence.lower()
        if intent == "methods":
            points = len(own & METHOD_WORDS)
        elif intent == "results":
            points = len(own & set(RESULT_CLAIMS)) + 2 * any(m in low for m in METRIC_WORDS) - 4 * (re.search(SETTINGS, sentence) is not None)
        elif intent == "limitations":
            points = len(own & LIMIT_CLAIMS) + 5 * (re.search(AHEAD, low) is not None)
        else:
            points = int(bool(own & {"achieve", "achieved", "result", "results", "propose", "proposed", "method", "future"}))
        return points, len(own & asked)

    return shortened(max(said, key=telling), LONGEST)


def serving(every: list, headings: list[str], terms: list[str], prefer: bool, follow: bool = False, no_tables: bool = False) -> list:
    """The sections under some headings, and what follows them without one, then those with a term; or only the former where they are preferred."""
    under, with_term, open_ = [], [], False
    for s in every:
        low = f"{s.heading or ''} {s.text}".strip().lower()
        if s.heading == "REFERENCES" or low.startswith("references") or contents_like(s.text):
            open_ = False
        elif no_tables and papers.table_like(s.text):
            continue
        elif s.heading in headings or follow and open_ and s.heading is None:
            under.append(s)
            open_ = True
        else:
            open_ = open_ and s.heading is None
            if any(t and t in low for t in terms):
                with_term.append(s)
    return under if prefer and under else under + with_term


def from_sections(question: str, intent: str, every: list, kind: str) -> str | None:
    """What the sections that serve an intent say, three at most."""
    headings, terms = (x.split("|") for x in PLACES.get(intent, PARTIES))
    paper = kind == "research_paper"
    follow = paper and intent in ("results", "findings", "limitations", "risks", "obligations")
    fit = serving(every, headings, terms, paper or intent in RESUME, follow, paper and intent == "methods")
    if kind == "academic_report" and intent == "limitations":
        fit = [s for s in every if admits(s)]
    if paper or kind == "academic_report" and intent == "limitations":
        fit = strongest(fit, intent)
    said = [told(s, question, intent, kind in LEARNED) for s in fit[:MOST_CHUNKS]]
    return " ".join(dict.fromkeys(filter(None, said))) or None


def admits(section) -> bool:
    """Whether a section of a report owns to limits: by its heading, or in so many words."""
    body = papers.clean_paper(papers.after_heading(section.text, section.heading))
    if section.heading == "REFERENCES" or not body or contents_like(section.text) or DECLARES.search(body):
        return False
    return section.heading in ("FUTURE WORK", "LIMITATION", "LIMITATIONS") or (section.heading is None or section.heading in ADMITTING) and ADMITS.search(body) is not None


def overview(question: str, every: list, own: dict) -> str | None:
    """What the sections that open a document say, or its first three."""
    kind = own["document_type"]
    for names in OPENINGS.get(kind, OPENINGS["other"]):
        fit = [s for s in every if s.heading in names]
        if fit:
            break
    else:
        fit = [s for s in every if s.heading != "REFERENCES" and not contents_like(s.text)][:MOST_CHUNKS]
    said = [told(s, question, "overview", kind in LEARNED, True) for s in fit[:MOST_CHUNKS]]
    return " ".join(filter(None, said)) or own["overview"]


def answer(question: str, intent: str, filename: str, pages: list[tuple[int, str]], mismatch: str | None = None) -> dict:
    """status, answer and reason. An intent that says nothing of a document's parts has status fall_through."""
    own = profile(filename, pages)
    kind, every = own["document_type"], [s for _, text in pages for s in split(text)]

    def done(text: str | None, reason: str | None = None) -> dict:
        found = reason or NONE_FOUND.get(intent, f"No evidence of {intent} was detected in this document.")
        return {"status": "answerable" if text else "insufficient_evidence", "answer": text, "reason": None if text else found, "document_type": kind}

    if mismatch:
        return done(None, mismatch)
    if intent == "overview":
        return done(overview(question, every, own))
    if intent == "authors" and kind == "academic_report" or intent == "parties" and kind == "academic_report":
        return done(people(own["facts"]))
    norm = " ".join(re.findall("[a-z0-9]+", question.lower()))
    if intent == "amounts" and kind in LEARNED and any(p in norm for p in INVOICE_AMOUNTS):
        return done(None, NO_INVOICE.format(*TOPICS[kind]))
    if intent not in FACTS and intent not in PLACES or intent in RESUME and kind != "resume":
        return {"status": "fall_through", "answer": None, "reason": None, "document_type": kind}
    text = from_facts(question, intent, own["facts"]) if intent in FACTS else None
    if text is None and (intent in PLACES or intent == "parties"):
        text = from_sections(question, intent, every, kind)
    return done(text)


FIELDS = "status string, answer string, reason string, document_type string"


def document_answers(asked: DataFrame, qid: str) -> DataFrame:
    """(qid, FIELDS) for rows of (qid, question, intent, filename, page_number, text), a group being one question's document."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("page_number")
        pages = [(int(n), t or "") for n, t in zip(table["page_number"], table["text"])]
        first = table.iloc[0]
        found = answer(first["question"], first["intent"], first["filename"] or "", pages)
        return pd.DataFrame([{qid: first[qid], **found}])

    kind = asked.schema[qid].dataType.simpleString()
    return asked.groupBy(qid).applyInPandas(run, f"`{qid}` {kind}, {FIELDS}")
