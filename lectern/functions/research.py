"""Text of papers and reports as Column functions: boilerplate, noise, sentences, numbers and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import words as W
from lectern.operators.sections import HEADINGS

# What publishers print on papers, and lines that say nothing of the subject.
BOILERPLATE = (
    r"\bcontents lists available at sciencedirect\b",
    r"\bjournal homepage\s*:?\s*\S+",
    r"\bwww\.elsevier\.com/\S+",
    r"\ball rights are reserved[^.]*\.?",
    r"\btext and data mining[^.]*\.?",
    r"\bai training,? and similar technologies[^.]*\.?",
    r"\bavailable online\s+\d{1,2}\s+[A-Za-z]+\s+\d{4}\b",
    r"\breceived\s+\d{1,2}\s+[A-Za-z]+\s+\d{4}\b",
    r"\brevised\s+\d{1,2}\s+[A-Za-z]+\s+\d{4}\b",
    r"\baccepted\s+\d{1,2}\s+[A-Za-z]+\s+\d{4}\b",
    r"\*?\s*corresponding author[^.]*\.?",
)
NOISE_LINES = (
    r"^journal of\b", r"^technical paper$", r"^research article$", r"^article info$",
    r"^credit authorship contribution statement\b", r"^declaration of competing interest\b", r"^acknowledgments?\b",
    r"^data availability\b", r"^school of\b", r"^state key laboratory\b", r"\b[a-z]\s+school of\b",
)
AUTHORS = r"(?i)\b[a-z],[a-z]\b|\bet al\.?\b"
PLACES = r"(?i)\b(?:shanghai|beijing|china|malaysia)\b"
INDUSTRY = r"(?i)\b(?:shanghai|beijing|china|malaysia|industry\s+4\.0|industry\s+5\.0)\b"
CONTRIBUTES = r"(?i)\b(?:this paper|we)\s+(?:propose|proposes|present|presents|introduce|introduces|develop|develops)\b"
TABLE_SIGNAL = r"(?i)\b(?:TOP1|TOP5|Avg\s+acc|Avg\s+pre|Avg\s+recall|F1\s+score|Pretrain|Train/Val/Test|Classes\s+Videos|Table\s+\d+)\b"
TABLE_HEAD = r"(?i)^(?:method\s+)?(?:pretrain\s+)?TOP1\s*\(%\)\s+TOP5"
DANGLING = r"(?i)\b(?:fig(?:ure)?s?|tables?|eq(?:uation)?s?|sections?|refs?|references?)\.?\s*$|\[[^\]]*$"
NO_PROSE = (
    r"\b(?:Keywords|KEYWORDS|References|REFERENCES|Bibliography|BIBLIOGRAPHY)\b\s*:?"
    r"|\b(?:keywords|references|bibliography)\s*:|(?:^|\n)\s*\[\d+\]"
)
SENTENCE_END = r"(?<!Fig\.)(?<!fig\.)(?<!Figs\.)(?<!figs\.)(?<!Eq\.)(?<!eq\.)(?<!Sec\.)(?<!sec\.)(?<!Ref\.)(?<!ref\.)(?<=[.!?])\s+"
MARKS = "✓✔✗✘"
# Labels of academic reports, and what ends their values.
REPORT_LABELS = r"(?i)\b(?:Course\s+Code|Course\s+Name|Lecturer|Academic\s+Session|Assessment\s+Title|Prepared\s+by)\s*:?\s*"
REPORT_SIGNALS = (
    r"\bcourse\s+code\b", r"\bcourse\s+name\b", r"\bacademic\s+session\b", r"\bassessment\s+title\b", r"\bprepared\s+by\b",
    r"\bstudent\s+id\b", r"\bproject\s+submission\b", r"\bfinal\s+report\b", r"\blecturer\b",
)
VALUE_END = (
    r"(?i)\b(?:Date\s+Received|Feedback\s+from|Mark|Table\s+of\s+Contents|Observation\s*:|Design\s+Approach|Results\s*&\s*Verification)"
)
# Labels that open a summary, and generated text that can't stand.
LEADING = (
    r"(?i)^(?:\d+(?:\.\d+)*\.?\s+"
    r"|(?:overview\s*&\s*objective|design\s+approach|results\s*&\s*verification)\s*[:.-]?\s+"
    r"|development\s+pipeline\s+phase\s+\d+\s*:\s*[^.!?]{0,120}?(?=\b(?:before|the|this|training|a|an|on|in)\b))+"
)
NUMBERS = r"(?i)\b\d[\d,]*(?:\.\d+)?(?:st|nd|rd|th)?%?\b"
UNFINISHED = r"(?i)(?:[-,:;]|\b(?:and|as|by|for|from|in|of|or|the|to|via|with))$"
JOURNALS = r"(?i)\b(?:ACM Computing Surveys|International Journal|Physics of Life Reviews|Journal of)\b"
SALAD = (
    r"(?i)\b(?:human-robot collaboration|large language models)\s+"
    r"(?:large language models|resilient manufacturing systems|embodied intelligence)\b"
)
STUDY_STOPWORDS = "a about an and are as be by for from in is it of on or that the this to uses what which with".split()
SUPPORT_STOPWORDS = [*STUDY_STOPWORDS, "answer", "cited", "context", "document", "evidence", "paper", "report", "study", "summarizes", "summary"]

_COMPACT = {h.replace(" ", "").replace("&", "").replace("/", ""): h for h in HEADINGS}
_SPACED = "|".join(r"\s+".join(c) for c in sorted((c for c in _COMPACT if len(c) >= 4 and c.isalpha()), key=lambda c: (-len(c), c)))


def tidied(text: Column) -> Column:
    """Headings whose letters stand apart ("A B S T R A C T") closed up."""
    pattern = rf"(?i)\b(?:{_SPACED})\b"
    known = F.create_map(*[F.lit(x) for pair in sorted(_COMPACT.items()) for x in pair])

    def closed(whole: Column) -> Column:
        found = F.transform(F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)), lambda x: F.try_element_at(known, F.upper(F.regexp_replace(x, r"\s+", ""))))
        pieces = F.zip_with(F.split(whole, pattern, -1), found, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
        # Few texts have four letters that stand apart at all.
        apart = whole.rlike(r"\s[A-Za-z]\s+[A-Za-z]\s") & whole.rlike(r"(?i)\b[a-z](?:\s+[a-z]\b){3}")
        return F.when(apart, F.array_join(pieces, "")).otherwise(whole)

    return W.bound(F.coalesce(text, F.lit("")), closed)


def cleaned(text: Column) -> Column:
    """Tidied headings, words joined that a hyphen cuts, white space collapsed."""
    return W.collapsed(F.regexp_replace(tidied(text), r"(?U)(?<=\w)-\s+(?=\w)", ""))


def clean_research(text: Column) -> Column:
    """Cleaned text without what publishers print."""
    out = tidied(text)
    for pattern in BOILERPLATE:
        out = F.regexp_replace(out, f"(?i){pattern}", " ")
    out = F.regexp_replace(out, r"(?i)\btechnical paper\s+(?=[A-Z0-9])", "")
    return cleaned(F.regexp_replace(out, r"(?i)\bjournal of manufacturing systems\b", " "))


def _literal(heading: Column) -> Column:
    """A heading as part of an expression: known headings hold letters, blanks, &, / and hyphens."""
    return F.regexp_replace(heading, r"([^A-Za-z0-9 ])", r"\\$1")


def strip_heading(text: Column, heading: Column) -> Column:
    """The cleaned text without a leading heading, or with it where nothing else is left."""
    pattern = F.concat(F.lit(r"(?i)^\s*"), _literal(heading), F.lit(r"\s*[:.-]?\s*"))
    rest = lambda flat: F.nullif(F.btrim(F.regexp_replace(flat, pattern, F.lit(""))), F.lit(""))
    return W.bound(cleaned(text), lambda flat: F.coalesce(rest(flat), flat))


def after_heading(text: Column, heading: Column) -> Column:
    """The cleaned text that follows the first place of a heading."""
    pattern = F.concat(F.lit(r"(?i)\b"), _literal(heading), F.lit(r"\b\s*[:.-]?\s*"))
    return W.bound(cleaned(text), lambda flat: F.coalesce(F.btrim(F.get(F.split(flat, pattern, 2), F.lit(1))), flat))


def noise_line(line: Column) -> Column:
    """Whether a line is empty or a publisher's."""
    return W.bound(cleaned(line), lambda flat: (flat == "") | flat.rlike("(?i)" + "|".join(f"(?:{p})" for p in (*NOISE_LINES, *BOILERPLATE))))


def location_like(line: Column) -> Column:
    """A postal code beside a known place."""
    return line.rlike(r"\b\d{5,}\b") & line.rlike(PLACES)


def table_like(text: Column) -> Column:
    """Whether a text reads like the rows of a table of results."""
    return W.bound(clean_research(text), _table_like)


def _table_like(flat: Column) -> Column:
    return (flat != "") & (flat.rlike(TABLE_HEAD) | flat.rlike(TABLE_SIGNAL) & (F.regexp_count(flat, F.lit(r"\b\d+(?:\.\d+)?\b")) >= 2))


def noise_sentence(sentence: Column) -> Column:
    """Whether a sentence says nothing: too short, figures, acronyms, references, authors or a publisher's line."""
    return W.bound(clean_research(sentence), _noise_sentence)


def _noise_sentence(flat: Column) -> Column:
    bare = lambda w: F.btrim(w, F.lit(".,;()"))
    words = F.transform(F.filter(F.split(flat, " "), lambda w: w != ""), bare)

    def counted(ws: Column) -> Column:
        n = F.size(ws)
        figures = F.size(F.filter(ws, lambda w: w.rlike(r"^\d+(?:\.\d+)?%?$")))
        acronyms = F.size(F.filter(ws, lambda w: w.rlike(r"^[A-Z][A-Z0-9/-]+$")))
        many = (figures >= 3) | (figures >= 2) & _table_like(flat)
        return (n < 5) | many & (figures * 3 >= n) | (acronyms >= 3) & (acronyms * 2 >= n)

    return (
        W.bound(words, counted)
        | flat.rlike(r"^(?:[A-Z]\.\s*)+$")
        | flat.rlike(rf"[{MARKS}]|^\[\d+\]")
        | flat.rlike(DANGLING)
        | flat.rlike(r"\b[A-Z][a-z]+\s+[A-Z],.*\b(?:19|20)\d{2}\b")
        | flat.rlike(AUTHORS) & ~flat.rlike(CONTRIBUTES)
        | noise_line(flat)
    )


def prose_sentences(text: Column) -> Column:
    """The sentences before keywords and references that say something."""
    prose = F.get(F.split(tidied(text), NO_PROSE, 2), F.lit(0))
    said = F.transform(F.split(clean_research(prose), SENTENCE_END), lambda s: F.btrim(s))
    return F.filter(said, lambda s: (s != "") & ~noise_sentence(s))


def noise_number(value: Column, before: Column, after: Column) -> Column:
    """Whether a number of a paper is an address, a version, a small count, a postal code or a year; with what stands around it."""
    near = F.lower(F.concat(before, value, after))
    plain = value.rlike(r"^\d+$")
    return (
        near.rlike(r"doi|http|www\.")
        | value.rlike(r"^\d+\.\d+$") & (value.try_cast("double") < 10)
        | plain & ((F.length(value) >= 5) | (value.try_cast("int") < 10))
        | value.isin("4.0", "5.0") & F.concat(before, value, after).rlike(INDUSTRY)
        | (F.length(value) == 4) & value.rlike("^(?:19|20)")
    )


def report_signals(text: Column) -> Column:
    """How many signs of an academic report a text has."""
    return sum((text.rlike(f"(?i){p}").cast("int") for p in REPORT_SIGNALS), F.lit(0))


def label_key(label: Column) -> Column:
    return W.collapsed(F.lower(label))


def label_value(key: Column, raw: Column) -> Column:
    """The value of a report's label, up to what ends it."""
    flat = cleaned(raw)
    head = lambda pattern: F.get(F.split(flat, pattern, 2), F.lit(0))
    cut = F.when(key == "assessment title", head(r"(?i)\bDue\s+Date\b")).when(key == "prepared by", head(VALUE_END)).otherwise(flat)
    return F.btrim(W.collapsed(cut), F.lit(" ,;:."))


def report_labels(text: Column) -> Column:
    """The labelled values of a page of an academic report: an array of (label, value)."""
    page = cleaned(F.get(F.split(F.coalesce(text, F.lit("")), r"(?i)\bTable\s+of\s+Contents\b", 2), F.lit(0)))
    labels = F.regexp_extract_all(page, F.lit(REPORT_LABELS), F.lit(0))
    values = F.split(page, REPORT_LABELS, -1)
    key = lambda x: label_key(F.regexp_replace(x, r"\s*:?\s*$", ""))
    pairs = F.zip_with(labels, F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: F.struct(key(a).alias("label"), label_value(key(a), b).alias("value")))
    return F.filter(pairs, lambda p: p["value"] != "")


def number_set(text: Column) -> Column:
    """The numbers of a text without separators, ordinal endings and percent signs."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBERS), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: F.regexp_replace(F.replace(n, F.lit(","), F.lit("")), r"(?i)(?:st|nd|rd|th|%)$", "")))


def unsupported_numbers(answer: Column, context: Column) -> Column:
    """Whether an answer has a number that its context lacks."""
    return F.size(F.array_except(number_set(answer), number_set(context))) > 0


def contains_any(text: Column, terms: list[str]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t))


def unique_phrases(text: Column, phrases: list[tuple[str, str]]) -> Column:
    """The phrases whose markers a text holds, in their order, each once."""
    low = F.lower(text)
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(m)), F.lit(p)) for m, p in phrases])))


def listed(phrases: Column) -> Column:
    """Phrases in a row: "a", "a and b", "a, b, and c"."""
    n = F.size(phrases)
    several = F.concat(F.array_join(F.slice(phrases, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.get(phrases, n - 1))
    return F.when(n <= 1, F.array_join(phrases, "")).when(n == 2, F.array_join(phrases, " and ")).otherwise(several)


def json_part(text: Column) -> Column:
    """The outermost object or list in a model's output, without a fence around it."""
    bare = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", "$1"))
    inner = F.regexp_extract(bare, r"(?s)([\[{].*[\]}])", 1)
    return F.when(inner == "", bare).otherwise(inner)


def unlabelled(text: Column) -> Column:
    """A summary without the numbers and labels that open it, however many follow one another."""
    return F.btrim(F.regexp_replace(cleaned(text), LEADING, ""))


def summary_text(text: Column, heading: Column) -> Column:
    """What of a chunk a summary can use: empty for a table of contents."""
    body = F.regexp_replace(strip_heading(text, heading), r"(?i)\bPage\s+\d+(?:\s+[A-Z][A-Z &/-]{1,40})?\b", " ")
    return W.bound(unlabelled(body), lambda out: F.when(W.contents_like(out), F.lit("")).otherwise(out))


def study_words(text: Column) -> Column:
    return F.filter(F.array_except(W.word_set(text), F.array(*[F.lit(w) for w in STUDY_STOPWORDS])), lambda w: F.length(w) > 1)


def reference_list(text: Column) -> Column:
    """Whether an answer reads like a list of references."""

    def told(flat: Column) -> Column:
        numbers, marks = F.size(number_set(flat)), F.regexp_count(flat, F.lit(r"\[\d+\]"))
        columns = F.contains(flat, F.lit("√")) | flat.rlike(r"(?i)\bv\s+v\b")
        return (flat != "") & (columns & (marks > 0) & (numbers >= 4) | (marks >= 2) & (numbers >= 6) | flat.rlike(JOURNALS) & (numbers >= 5))

    return W.bound(cleaned(text), told)


def meaningful_answer(text: Column) -> Column:
    """Whether a text can stand as an answer: four words, finished, prose."""
    finished = lambda flat: (F.size(study_words(flat)) >= 4) & ~flat.rlike(UNFINISHED) & ~flat.rlike(SALAD) & ~W.contents_like(flat)
    return W.bound(cleaned(text), finished) & ~reference_list(text)


def supported_answer(text: Column, context: Column, strict: bool = False) -> Column:
    """Whether a generated text can stand and its numbers are its context's; strictly, a quarter of its words too."""
    good = meaningful_answer(text) & ~unsupported_numbers(cleaned(text), context)
    if not strict:
        return good
    terms = F.array_except(study_words(cleaned(text)), F.array(*[F.lit(w) for w in SUPPORT_STOPWORDS]))
    shared = F.size(F.array_intersect(terms, study_words(context)))
    return good & ((F.size(terms) < 4) | (4 * shared >= F.size(terms)))
