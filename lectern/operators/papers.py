"""Papers and reports read in Python, page by page: titles, telling sentences, labelled values.

The same fixed values as ``functions.research`` has for columns; here a document
is in hand, as profiles are made of its pages one after the other.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from lectern.functions import research as T
from lectern.operators.sections import HEADINGS, Section, canonical, contents_like, split, tidy

_BOILERPLATE = [re.compile(p, re.I) for p in T.BOILERPLATE]
_LINE = re.compile("|".join(f"(?:{p})" for p in (*T.NOISE_LINES, *T.BOILERPLATE)), re.I)
_NO_PROSE, _END = re.compile(T.NO_PROSE), re.compile(T.SENTENCE_END)
_FIGURE, _ACRONYM = re.compile(r"\d+(?:\.\d+)?%?"), re.compile(r"[A-Z][A-Z0-9/-]+")
#: Whole sentences that say nothing, by their form alone.
_EMPTY = [
    re.compile(p)
    for p in (r"^(?:[A-Z]\.\s*)+$", rf"[{T.MARKS}]|^\[\d+\]", T.DANGLING, r"\b[A-Z][a-z]+\s+[A-Z],.*\b(?:19|20)\d{2}\b")
]
_AUTHORS, _CONTRIBUTES = re.compile(T.AUTHORS), re.compile(T.CONTRIBUTES)
_PLACES, _INDUSTRY = re.compile(T.PLACES), re.compile(T.INDUSTRY)
_LABEL, _VALUE_END = re.compile(T.REPORT_LABELS), re.compile(T.VALUE_END)
LONGEST_TITLE, LONGEST_LINE, MORE_LINES = 160, 120, 3
# What papers claim, where, and by which words; methods have words of prose and of tables.
CLAIMS = (
    ("research_contribution", "Contribution", ("ABSTRACT", "INTRODUCTION"), "propose proposes present presents introduce introduces develop develops".split(), False),
    (
        "research_method", "Method", ("METHODOLOGY", "METHOD", "METHODS", "APPROACH", "MODEL"),
        "approach architecture attention encoder framework fusion method model module pipeline proposed temporal transformer visual".split(), True,
    ),
    ("research_result", "Result", ("RESULT", "RESULTS", "EVALUATION", "EXPERIMENT", "EXPERIMENTS"), "achieve achieves result results accuracy top1 top5 f1".split(), False),
)
METHOD_PROSE = "approach architecture attention encoder fine-tuning framework fusion model module pipeline proposed temporal token transformer visual".split()
METHOD_TABLES = ("avg acc", "baseline comparison", "comparison with sota", "method pretrain", "pretrain top1", "table", "top1", "top5")
REPORT_NAMES = {
    "course code": "Course code", "course name": "Course name", "lecturer": "Lecturer", "academic session": "Academic session",
    "assessment title": "Assessment title", "prepared by": "Prepared by",
}
NOT_READ = frozenset({"REFERENCES", "KEYWORDS", "BIBLIOGRAPHY"})


def clean(text: str) -> str:
    return " ".join(re.sub(r"(?<=\w)-\s+(?=\w)", "", tidy(text)).split())


def clean_paper(text: str) -> str:
    """A text without what publishers print."""
    out = text
    for pattern in _BOILERPLATE:
        out = pattern.sub(" ", out)
    out = re.sub(r"\btechnical paper\s+(?=[A-Z0-9])", "", out, flags=re.I)
    return clean(re.sub(r"\bjournal of manufacturing systems\b", " ", out, flags=re.I))


def noise_line(line: str) -> bool:
    flat = clean(line)
    return not flat or _LINE.search(flat) is not None


def table_like(text: str) -> bool:
    flat = clean_paper(text)
    many = len(re.findall(r"\b\d+(?:\.\d+)?\b", flat)) >= 2
    return bool(re.search(T.TABLE_HEAD, flat) or many and re.search(T.TABLE_SIGNAL, flat))


def says_nothing(sentence: str) -> bool:
    """Too short, figures or acronyms, a reference, authors, or a publisher's line."""
    flat = clean_paper(sentence)
    words = [w.strip(".,;()") for w in flat.split()]
    figures, acronyms = (sum(p.fullmatch(w) is not None for w in words) for p in (_FIGURE, _ACRONYM))
    crowded = 3 * figures >= len(words) and (figures > 2 or figures == 2 and table_like(flat)) or acronyms > 2 and 2 * acronyms >= len(words)
    named = _AUTHORS.search(flat) is not None and _CONTRIBUTES.search(flat) is None
    return len(words) < 5 or crowded or named or any(p.search(flat) for p in _EMPTY) or noise_line(flat)


def sentences(text: str) -> list[str]:
    """The sentences before keywords and references that say something."""
    prose = clean_paper(_NO_PROSE.split(tidy_lines(text), maxsplit=1)[0])
    return [s for s in map(str.strip, _END.split(prose)) if s and not says_nothing(s)]


def tidy_lines(text: str) -> str:
    """Spaced headings closed up, line ends kept."""
    return "\n".join(map(tidy, text.split("\n")))


def _part_of_title(line: str) -> str | None:
    """What a line may add to a title: not a publisher's, the authors' or a place's."""
    flat = clean_paper(line).strip(" .")
    located = re.search(r"\b\d{5,}\b", flat) and _PLACES.search(flat)
    return None if not flat or noise_line(flat) or _AUTHORS.search(flat) or located else flat


def title(pages: Iterable[tuple[int, str]]) -> str | None:
    """The first line of the first two pages that reads like a paper's title, with up to three lines that go on with it."""
    for _, text in list(pages)[:2]:
        lines = text.splitlines()
        for at, line in enumerate(lines):
            first = _part_of_title(line)
            first = first and re.sub(r"(?i)^(?:technical paper|research article|article)\s+", "", first).strip(" .")
            if not first or len(clean(line)) > 180 or canonical(clean(line)) in HEADINGS or len(first.split()) < 4 and ":" not in first:
                continue
            parts = [first]
            for more in lines[at + 1 : at + 1 + MORE_LINES]:
                part = _part_of_title(more)
                if part is None or len(part) > LONGEST_LINE or canonical(part) in HEADINGS or len(" ".join(parts)) >= LONGEST_TITLE:
                    break
                parts.append(part)
            return clean(" ".join(parts))
    return None


def noise_number(value: str, text: str, at: int) -> bool:
    """Whether a number of a paper is an address, a version, a small count, a postal code or a year."""
    near = text[max(0, at - 32) : at + len(value) + 32].lower()
    whole = value.isdigit()
    small = re.fullmatch(r"\d+\.\d+", value) is not None and float(value) < 10
    year = len(value) == 4 and value[:2] in ("19", "20")
    return any(x in near for x in ("doi", "http", "www.")) or small or year or whole and (len(value) >= 5 or int(value) < 10)


def _sections(pages: Iterable[tuple[int, str]]) -> Iterator[tuple[int, Section]]:
    for page, text in pages:
        for section in split(text):
            if section.heading not in NOT_READ and not contents_like(section.text):
                yield page, section


def claims(pages: list[tuple[int, str]]) -> Iterator[tuple[str, str, str, int]]:
    """(kind, label, sentence, page): a paper's contribution, method and result, the most telling sentence of each."""
    read = [(page, s, sentences(after_heading(s.text, s.heading))) for page, s in _sections(pages)]
    for kind, label, headings, terms, anywhere in CLAIMS:
        best: tuple[int, int] | None = None
        chosen: tuple[str, str, str, int] | None = None
        for page, section, said in read:
            under = section.heading in headings
            if not under and not (anywhere and section.heading is None and any(t in section.text.lower() for t in terms)):
                continue
            for n, sentence in enumerate(said):
                low = sentence.lower()
                score = 5 * under + 3 * any(t in low for t in terms) + min(len(sentence.split()), 36)
                if label == "Method":
                    score += sum(t in low for t in METHOD_PROSE) - 3 * sum(t in low for t in METHOD_TABLES)
                if best is None or (score, -n) > best:
                    best, chosen = (score, -n), (kind, label, sentence, page)
        if chosen:
            yield chosen


def after_heading(text: str, heading: str | None) -> str:
    flat = clean(text)
    return re.split(rf"(?i)\b{re.escape(heading)}\b\s*[:.-]?\s*", flat, maxsplit=1)[-1].strip() if heading else flat


def labelled(text: str) -> Iterator[tuple[str, str]]:
    """(label, value) pairs of a report's page, before its table of contents."""
    page = clean(re.split(r"(?i)\bTable\s+of\s+Contents\b", text, maxsplit=1)[0])
    found = list(_LABEL.finditer(page))
    for m, end in zip(found, [*(f.start() for f in found[1:]), len(page)]):
        key = " ".join(re.sub(r"\s*:?\s*$", "", m[0]).lower().split())
        value = page[m.end() : end]
        if key == "assessment title":
            value = re.split(r"(?i)\bDue\s+Date\b", value, maxsplit=1)[0]
        if key == "prepared by":
            value = _VALUE_END.split(value, maxsplit=1)[0]
        if clean(value).strip(" ,;:."):
            yield REPORT_NAMES[key], clean(value).strip(" ,;:.")
