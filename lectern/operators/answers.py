"""Extractive answers: the sentence that holds the value asked for, from evidence that suffices."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from lectern.functions.words import VARIANTS
from lectern.operators.routing import INTENT_PHRASES, INTENT_TERMS, SECTIONS

# Word lists and formats that decide what a question wants.
STOPWORDS = frozenset(
    "a about an and are background candidate can could did do does document file for from have has how in is it listed "
    "many mentioned of on pdf paper resume remained show that the this to what when where which who why with work working "
    "works used was were report reported".split()
)
COUNT_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
UNFOCUSED = frozenset("total initially initial original obtained records record results result entries entry before after".split())
INITIAL = frozenset("initial initially original before began identified obtained collected".split())
FINAL = frozenset("after remained retained consolidated resulting final".split())
LIST_COUNTS = "two three four five six seven eight nine ten".split()
SENTENCE = re.compile(r"(?<!\bal\.)(?<!\bfig\.)(?<!\beq\.)(?<=[.!?])\s+", re.I)
COUNT = re.compile(r"\bhow\s+many\b", re.I)
DATE = re.compile(r"\bdates?\b|\bwhen\s+(?:is|was|were|did|will)\b", re.I)
PUBLICATION = re.compile(r"\b(?:published|publication|release|released|issued)\b", re.I)
CALENDAR = re.compile(r"\b(?:19|20)\d{2}\b|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b")
MONTH = (
    "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?"
    "|Nov(?:ember)?|Dec(?:ember)?"
)
PUBLISHED_ON = re.compile(
    rf"\b(?:{MONTH})\s+(?:\d{{1,2}}[, ]+)?(?:19|20)\d{{2}}\b|\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b"
    r"|\b(?:published|released|issued)\s+(?:(?:on|in|during)\s+)?(?:19|20)\d{2}\b",
    re.I,
)
DURATION = re.compile(r"\b\d+\s+(?:days?|weeks?|months?|years?)\b", re.I)
NUMBER = re.compile(r"\b\d+(?:[,.]\d+)*\b")
PRICE = re.compile(r"\bprices?\b|\bcost\b", re.I)
COST_FUNCTION = re.compile(r"\bcost functions?\b", re.I)
MONEY = re.compile(
    r"(?:\b(?:USD|EUR|GBP|MYR|RM)\s*|[$£€])\d|\d+(?:[,.]\d+)*\s+(?:Malaysian\s+)?(?:Ringgit|dollars?|euros?|pounds?)\b", re.I
)
BILL_TO = re.compile(r"\bbill(?:ed)?\s+to\b", re.I)
PARTIES = re.compile(r"^who\s+(?:are|were)\s+(?:the\s+)?parties\b", re.I)
DEGREE = re.compile(r"\b(?:listed|completed|completion|earned|education|academic|graduated)\b", re.I)
UNFINISHED = re.compile(
    r"\b(?:started|starting|began|enrolled|enrolment|enrollment|expected|anticipated|pursuing)\b|\bin progress\b", re.I
)
FINISHED = re.compile(r"\b(?:completed|graduated|earned)\b", re.I)
LISTED = re.compile(
    rf"^(?:what|which)\s+(?:are|were)\s+(?:the\s+)?(?P<n>\d+|{'|'.join(LIST_COUNTS)})\s+(?P<item>[a-z][a-z-]*)\b", re.I
)
MOST = 3


def words(text: str) -> set[str]:
    return {VARIANTS.get(w, w) for w in re.findall("[a-z0-9]+", text.lower())}


def stem(word: str) -> str:
    return word[:-1] if len(word) > 3 and word.endswith("s") else word


def with_stems(text: str) -> set[str]:
    found = words(text)
    return found | {stem(w) for w in found}


@dataclass(frozen=True)
class Wanted:
    """What a question asks for, read once."""

    question: str

    @property
    def words(self) -> set[str]:
        return words(self.question)

    @property
    def counts(self) -> bool:
        return COUNT.search(self.question) is not None

    @property
    def dated(self) -> bool:
        return DATE.search(self.question) is not None

    @property
    def published(self) -> bool:
        return PUBLICATION.search(self.question) is not None

    @property
    def priced(self) -> bool:
        return PRICE.search(self.question) is not None and COST_FUNCTION.search(self.question) is None

    @property
    def degree(self) -> bool:
        return "degree" in self.words and DEGREE.search(self.question) is not None

    def terms(self) -> set[str]:
        """The words that evidence is held against."""
        left = self.words - STOPWORDS
        if PARTIES.search(self.question):
            left -= {"agreement", "contract", "service", "services"}
        if self.degree:
            left = left - {"degree"} | {"education"}
        if self.priced:
            left -= {"price", "prices", "cost"}
        if "education" in left and self.dated:
            left -= {"completed", "completion"}
        if self.counts:
            left = left - UNFOCUSED or left
        return {stem(w) for w in left}

    def intents(self) -> set[str]:
        norm = " ".join(re.findall("[a-z0-9]+", self.question.lower()))
        found = {k for k, v in INTENT_TERMS.items() if self.words & set(v.split())}
        found |= {k for k, phrases in INTENT_PHRASES.items() if any(p in norm for p in phrases)}
        return found | {"skill"} if found & {"framework", "programming_language", "tool"} else found

    def held_by(self, sentence: str) -> bool:
        """Whether a sentence has the kind of value that is asked for; every rule that applies must hold."""
        return all(rule(sentence) for applies, rule in self._rules() if applies)

    def _rules(self):
        asked = self.words
        yield self.counts, lambda s: bool(NUMBER.search(s) or words(s) & COUNT_WORDS)
        yield self.counts and "before" in asked, lambda s: "before" in words(s)
        yield self.counts and bool(asked & {"initial", "initially", "original"}), lambda s: bool(words(s) & INITIAL)
        yield self.counts and "after" in asked, lambda s: bool(words(s) & FINAL)
        yield self.dated, lambda s: bool(CALENDAR.search(s) or not self.published and DURATION.search(s))
        yield (
            self.dated and self.published,
            lambda s: bool(words(s) & {"publish", "release", "released", "issued"} and PUBLISHED_ON.search(s)),
        )
        yield self.dated and self.degree, self._completed
        yield self.priced, lambda s: MONEY.search(s) is not None
        yield BILL_TO.search(self.question) is not None, lambda s: BILL_TO.search(s) is not None
        yield LISTED.search(self.question) is not None, self._complete_list

    @staticmethod
    def _completed(sentence: str) -> bool:
        """A year of enrolment is no year of completion, unless a clause of its own speaks of completion."""
        clauses = re.split(r"\s+and\s+|;", sentence, flags=re.I)
        finished = any(FINISHED.search(c) and not UNFINISHED.search(c) for c in clauses)
        return finished or UNFINISHED.search(sentence) is None

    def _complete_list(self, sentence: str) -> bool:
        """As many items as asked for, after their number and name."""
        asked = LISTED.search(self.question)
        given = asked["n"].lower()
        n = int(given) if given.isdigit() else LIST_COUNTS.index(given) + 2
        forms = "|".join([str(n), *LIST_COUNTS[n - 2 : n - 1]] if n >= 2 else [str(n)])
        tail = re.search(rf"\b(?:{forms})\s+{re.escape(asked['item'])}\s*(?::|\b(?:named|called)\b)\s*(.+)", sentence, re.I)
        return tail is not None and len(re.split(r",\s*(?:and\s+)?|\s+and\s+", tail[1])) >= n

    def spans(self, text: str) -> list[str]:
        """The pieces of a text that may answer: sentences, or clauses where prices must stay with their items."""
        found = SENTENCE.split(" ".join(text.split()))
        if self.published:
            follows = lambda s: re.match(r"(?:published|released|issued)\b", s, re.I)
            found = [
                f"{before} {s}" if before and follows(s) and "publish" in words(before) else s
                for before, s in zip(["", *found], found)
            ]
        if self.priced:
            cut = r";|\s+(?:but|whereas)\s+" + ("" if re.search(r"\band\b", self.question, re.I) else r"|\s+and\s+")
            found = [clause for s in found for clause in re.split(cut, s, flags=re.I)]
        return [s.strip() for s in found if s.strip() and self.held_by(s)]

    def snippet(self, text: str) -> str:
        """The piece with most of the terms, the densest and then the first of equals."""
        terms = self.terms()
        rank = lambda s: (len(terms & with_stems(s)), len(terms & with_stems(s)) / max(1, len(s.split())))
        return max(self.spans(text), key=rank, default="")


def section_serves(intents: set[str], heading: str | None) -> float:
    return float(bool(intents & set(SECTIONS.get(" ".join((heading or "").upper().split()), "").split())))


def signal(wanted: Wanted, hit: dict) -> dict:
    """The features by which a hit (text, score, source_score, section_heading) is ranked and judged."""
    terms = wanted.terms()
    matched = terms & with_stems(" ".join(filter(None, (hit.get("section_heading"), hit["text"]))))
    snippet = wanted.snippet(hit["text"])
    found = len(terms & with_stems(snippet))
    out = {"terms": len(terms), "matched": len(matched), "keyword": len(matched) / len(terms) if terms else 0.0}
    out |= {"snippet": snippet, "found": found, "coverage": found / max(1, len(terms)), "density": found / max(1, len(snippet.split()))}
    out["section"] = section_serves(wanted.intents(), hit.get("section_heading"))
    out["sufficient"] = sufficient(wanted, hit, out)
    return out


def sufficient(wanted: Wanted, hit: dict, s: dict) -> bool:
    if not s["snippet"] or not s["terms"] or wanted.dated and s["coverage"] < 0.5:
        return False
    if s["terms"] == 1:
        trusted = hit["source_score"] >= 0.5 or s["section"] >= 1
        return s["matched"] == 1 and trusted and (s["found"] > 0 or s["section"] >= 1)
    enough = 0.5 if s["section"] >= 1 else 0.6
    return s["found"] > 0 and s["matched"] >= 2 and s["keyword"] >= enough


def ranked(question: str, hits: list[dict]) -> list[tuple[dict, dict]]:
    """(hit, signal) pairs, the most promising first."""
    wanted = Wanted(question)
    pairs = [(h, signal(wanted, h)) for h in hits]
    key = lambda p: (bool(p[1]["snippet"]), p[1]["coverage"], p[1]["keyword"], p[1]["density"], p[1]["section"], p[0]["score"], p[0]["source_score"])
    return sorted(pairs, key=key, reverse=True)


def answer_scores(question: str, hits: list[dict]) -> list[tuple[dict, float]]:
    """Hits by how well they answer; those that don't suffice score 0."""
    scored = []
    for hit, s in ranked(question, hits):
        value = 0.6 + 0.2 * s["coverage"] + 0.1 * s["keyword"] + 0.05 * min(1.0, 10 * s["density"]) + 0.05 * hit["score"]
        scored.append((hit, round(value, 6) if s["sufficient"] else 0.0))
    return sorted(scored, key=lambda p: p[1], reverse=True)


def confidence(s: dict) -> str:
    if s["keyword"] >= (0.5 if s["section"] >= 1 else 0.75):
        return "strong"
    return "moderate" if s["section"] >= 1 or s["keyword"] >= 0.45 else "weak"


def grounded_answer(question: str, hits: list[dict]) -> dict:
    """status, confidence, summary and the cited chunk_ids of the best hits that suffice, three at most."""
    wanted = Wanted(question)
    counted = lambda s: not wanted.counts or any(w.isdigit() or w in COUNT_WORDS for w in words(s["snippet"]))
    chosen = [(h, s) for h, s in ranked(question, hits) if s["sufficient"] and counted(s)][:MOST]
    if not chosen:
        return {"status": "insufficient_evidence", "confidence": "weak", "summary": None, "cited": []}
    return {
        "status": "answerable",
        "confidence": confidence(chosen[0][1]),
        "summary": " ".join(s["snippet"] for _, s in chosen),
        "cited": [h["chunk_id"] for h, _ in chosen],
    }


def answers(hits: DataFrame, qid: str, question: str) -> DataFrame:
    """(qid, status, confidence, summary, cited): an answer per question from its hits, a bounded candidate list."""
    fields = ["chunk_id", "text", "score", "source_score", "section_heading"]

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["score", "chunk_id"], ascending=[False, True])
        rows = table[fields].astype(object).where(table[fields].notna(), None).to_dict("records")
        return pd.DataFrame([{qid: table[qid].iloc[0], **grounded_answer(table[question].iloc[0], rows)}])

    kind = hits.schema[qid].dataType.simpleString()
    return hits.groupBy(qid).applyInPandas(run, f"`{qid}` {kind}, status string, confidence string, summary string, cited array<long>")


# Names that don't tell what a follow-up is about.
GENERIC_NAMES = frozenset("a an the education project report framework degree method invoice receipt".split())
FOLLOW_UP = re.compile(r"\band\s+when\b.*\bit\b", re.I)


def same_referent(first: str, second: str) -> bool:
    """Whether a follow-up names what the first answer was about."""
    names = {w.lower() for w in re.findall(r"\b[A-Z][A-Za-z0-9-]+\b", first)} - GENERIC_NAMES
    return first == second or bool(names) and names <= set(re.findall("[a-z0-9-]+", second.lower()))


def draft(question: str, parts: list[str], items: list[dict]) -> str:
    """The joined answers to all parts, each from its best item alone; empty unless every part has one."""
    found: list[str] = []
    for part in parts or [question]:
        whole = grounded_answer(part, items)
        best = [h for h in items if whole["cited"][:1] == [h["chunk_id"]]]
        summary = grounded_answer(part, best)["summary"] if best else None
        if summary is None or found and FOLLOW_UP.search(question) and not same_referent(found[0], summary):
            return ""
        if summary not in found:
            found.append(summary)
    return " ".join(found)


VERIFIED = "status string, confidence string, answer string, cited array<long>, n_sentences int, n_unsupported int, risk double"


def verified(question: str, parts: list[str], items: list[dict]) -> dict:
    """An answer whose every sentence one sentence of the chosen evidence supports, or an abstention."""
    from lectern.operators.verify import check

    none = {"status": "insufficient_evidence", "confidence": "weak", "answer": None, "cited": [], "n_sentences": 0, "n_unsupported": 0, "risk": 1.0}
    text = draft(question, parts, items) if items else ""
    if not text:
        return none
    checked = check(text, items)
    kept = [s for s in checked if s["supported"]]
    counts = {"n_sentences": len(checked), "n_unsupported": len(checked) - len(kept), "risk": 1 - len(kept) / len(checked)}
    if not kept:
        return none | counts
    support = sum(max(h["score"], h["source_score"]) for h in items) / len(items)
    cited = {s["chunk_id"] for s in kept}
    return {
        "status": "answerable",
        "confidence": "strong" if support >= 0.75 else "moderate",
        "answer": " ".join(s["sentence"] for s in kept),
        "cited": [h["chunk_id"] for h in items if h["chunk_id"] in cited],
        **counts,
    }


def verified_answers(packs: DataFrame, qid: str, question: str) -> DataFrame:
    """(qid, VERIFIED) per question from the items of its evidence pack."""
    from lectern.operators.routing import plan

    fields = ["chunk_id", "text", "score", "source_score", "section_heading"]

    def run(table: pd.DataFrame) -> pd.DataFrame:
        rows = table.sort_values("place")[fields]
        items = rows.astype(object).where(rows.notna(), None).to_dict("records")
        asked = table[question].iloc[0]
        return pd.DataFrame([{qid: table[qid].iloc[0], **verified(asked, list(plan(asked).parts), items)}])

    kind = packs.schema[qid].dataType.simpleString()
    return packs.groupBy(qid).applyInPandas(run, f"`{qid}` {kind}, {VERIFIED}")
