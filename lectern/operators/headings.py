"""Sections of pages by their headings, and section-aware word windows, as columns.

Lines are told heading from text by a grammar of known headings and numbered
titles; sections begin at heading lines, and each is looked into for headings
within its text. Everything happens inside the row: arrays of lines and pieces,
cut at the places of headings, so no page moves and no state grows with it.

Cases: a null or blank page has no sections; a page without a heading is one; a
page of one line, of headings only, or of any length is read whole; a row is a
page, so repeated rows are pages of their own; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import words as W
from lectern.functions.research import tidied
from lectern.operators.sections import HEADINGS, MAJOR, TITLES, Title

ANY = "|".join(sorted(HEADINGS, key=len, reverse=True))
#: A heading within a text, alone on its line, and a numbered title.
BY_LETTER = "|".join(f"{a}(?:{'|'.join(h[1:] for h in sorted(HEADINGS, key=len, reverse=True) if h[0] == a)})" for a in sorted({h[0] for h in HEADINGS}))
WITHIN = rf"(?i)(?<![A-Za-z0-9])({BY_LETTER})(?![A-Za-z0-9])"
#: Whatever reads as a heading within a text begins with a capital, so a text without this holds none.
CAPITAL = rf"(?=[A-Z])(?<![A-Za-z0-9])(?i:{BY_LETTER})(?![A-Za-z0-9])"
ALONE = rf"(?i)^\s*(?:[-*#]+\s*)?(?:\d+(?:\.\d+)*\.?\s*)?({ANY})\s*:?\s*$"
NUMBERED = r"^\s*(\d+(?:\.\d+)*\.)\s*([A-Za-z][A-Za-z0-9 /&:,\-–]{2,90})\s*:?\s*$"
CAPTION = r"(?i)^(?:fig|figure|table)\.?\s+\d+"
LINE_END = r"[\v\x1C-\x1E]"
#: More signs than a title has, read no further than these.
LONG = r"^(?:\s*+\S){111}"
SECTION = "array<struct<text:string,word_start:int,heading:string>>"


def flat(text: Column) -> Column:
    """Spaced headings closed up and white space collapsed; hyphens stay."""
    return W.collapsed(tidied(text))


def canonical(found: Column) -> Column:
    """The known heading that a found one is, whatever its case and signs."""
    compact = lambda x: F.upper(F.regexp_replace(x, "[^A-Za-z0-9]", ""))
    known = F.create_map(*[F.lit(x) for h in HEADINGS for x in ("".join(c for c in h if c.isalnum()), h)])
    return F.try_element_at(known, compact(found))


def _holds(rule: Title, title: Column, words: Column) -> Column:
    if rule.whole:
        some = F.arrays_overlap(words, F.array(*map(F.lit, rule.terms)))
    else:
        some = F.lit(False)
        for term in rule.terms:
            some = some | title.contains(term)
    return some & title.contains(rule.also) if rule.also else some


def alias(line: Column) -> Column:
    """The known heading that an unlisted title stands for, by the first rule that holds; null for others."""

    def told(text: Column) -> Column:
        numbered = text.rlike(NUMBERED)
        title = F.when(numbered, F.regexp_extract(text, NUMBERED, 2)).otherwise(text)
        words = F.regexp_extract_all(F.lower(title), F.lit("[a-z0-9]+"), F.lit(0))

        def by_rule(parts: Column) -> Column:
            joined = F.array_join(parts, " ")
            major = F.regexp_extract(text, r"^\s*(\d+)", 1)
            found = F.try_element_at(F.create_map(*[F.lit(x) for pair in MAJOR.items() for x in pair]), F.when(numbered, major))
            for rule in reversed(TITLES):
                asked = _holds(rule, joined, parts)
                if rule.numbered is not None:
                    asked = asked & (numbered if rule.numbered else ~numbered)
                found = F.when(asked, F.lit(rule.heading)).otherwise(found)
            return found

        shut = (F.length(text) == 0) | (F.length(text) > 110) | text.contains("....") | text.rlike(CAPTION) | (~numbered & text.rlike("[.!?]$"))
        return F.when(~shut, W.bound(words, by_rule))

    return W.bound(flat(line), told)


def line_heading(line: Column) -> Column:
    """The heading that a line without white space at its ends is, or null."""
    told = W.bound(F.regexp_extract(line, ALONE, 1), lambda alone: F.when(alone != "", canonical(alone)).when(~line.rlike(LONG), alias(line)))
    # A heading ends like a sentence only if a number begins it; lines of prose are told by their last sign.
    prose = line.endswith(".") | line.endswith("!") | line.endswith("?")
    return F.when(~prose | F.substring(line, 1, 1).between("0", "9"), told)


def _reads_as_heading(found: Column, titles: Column) -> Column:
    """Capitals always do; a title of several words where titles count."""
    capital = F.forall(F.split(found, r"[\s&]+"), lambda w: (w == "") | w.rlike("^[A-Z]"))
    return (found == F.upper(found)) | (titles & canonical(found).contains(" ") & capital)


def _cuts(items: Column, begins) -> Column:
    """Places of an array where a group begins, the first always."""
    return F.array_compact(F.transform(items, lambda x, i: F.when(begins(x) | (i == 0), i)))


def _groups(items: Column, cuts: Column, body) -> Column:
    """Each run of items from a cut up to the next, as ``body`` of them."""
    end = lambda k: F.coalesce(F.get(cuts, k + 1), F.size(items))
    return F.transform(cuts, lambda at, k: body(F.slice(items, at + 1, end(k) - at)))


def within(text: Column, titles: Column) -> Column:
    """Sections that begin at headings in a tidied text; none without one."""

    def cut(marks: Column) -> Column:
        whole = lambda run: F.array_join(F.transform(run, lambda x: F.concat(x["found"], x["rest"])), "")
        first = lambda run: F.get(run, F.lit(0))
        raw = W.bound(
            _cuts(marks, lambda x: x["mark"]),
            lambda cuts: _groups(marks, cuts, lambda run: F.struct(whole(run).alias("raw"), F.when(first(run)["mark"], canonical(first(run)["found"])).alias("heading"))),
        )

        def placed(parts: Column) -> Column:
            # Words are parted by single blanks, so blanks tell how many came before.
            blanks = F.transform(parts, lambda x: F.length(x["raw"]) - F.length(F.replace(x["raw"], F.lit(" "), F.lit(""))))
            open_end = F.transform(parts, lambda x: ((x["raw"] != "") & ~x["raw"].endswith(" ")).cast("int"))
            starts = F.zip_with(
                W.before(blanks, F.lit(0), lambda a, b: a + b), F.concat(F.array(F.lit(0)), open_end), lambda n, more: n + more
            )
            sections = F.zip_with(
                parts,
                F.slice(starts, F.lit(1), F.size(parts)),
                lambda x, at: F.struct(F.btrim(x["raw"]).alias("text"), at.alias("word_start"), x["heading"].alias("heading")),
            )
            return F.filter(sections, lambda x: x["text"] != "")

        return F.when(F.exists(marks, lambda x: x["mark"]), W.bound(raw, placed)).otherwise(F.array().cast(SECTION))

    # What follows a heading lies beside it; the first piece follows none.
    found = F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(WITHIN), F.lit(1)))
    marks = F.zip_with(
        found,
        F.split(text, WITHIN, -1),
        lambda x, rest: F.struct(x.alias("found"), rest.alias("rest"), ((x != "") & _reads_as_heading(x, titles)).alias("mark")),
    )
    return W.bound(marks, cut)


def by_lines(lines: Column) -> Column:
    """Sections of lines (line, heading) that begin at those with a heading."""
    said = lambda x: F.when(x["heading"].isNotNull(), F.regexp_replace(x["line"], ":+$", "")).otherwise(x["line"])

    def body(run: Column) -> Column:
        return F.struct(
            flat(F.array_join(F.transform(run, said), " ")).alias("text"),
            F.aggregate(run, F.lit(0), lambda n, x: n + F.size(F.split(x["line"], r"\s+"))).alias("words"),
            F.get(run, F.lit(0))["heading"].alias("heading"),
        )

    def placed(parts: Column) -> Column:
        starts = W.before(F.transform(parts, lambda x: x["words"]), F.lit(0), lambda a, b: a + b)
        sections = F.zip_with(parts, starts, lambda x, at: F.struct(x["text"].alias("text"), at.alias("word_start"), x["heading"].alias("heading")))
        return F.filter(sections, lambda x: x["text"] != "")

    return W.bound(W.bound(_cuts(lines, lambda x: x["heading"].isNotNull()), lambda cuts: _groups(lines, cuts, body)), placed)


def _refined(section: Column) -> Column:
    """A section of lines, cut at the headings within its text; the first part keeps its heading."""

    def parts(found: Column) -> Column:
        moved = F.transform(
            found,
            lambda p, i: F.struct(
                p["text"].alias("text"),
                (p["word_start"] + section["word_start"]).alias("word_start"),
                F.coalesce(p["heading"], F.when(i == 0, section["heading"])).alias("heading"),
            ),
        )
        return F.when(F.size(found) > 0, moved).otherwise(F.array(section))

    return F.when(section["text"].rlike(CAPITAL), W.bound(within(section["text"], F.lit(True)), parts)).otherwise(F.array(section))


def sections(text: Column) -> Column:
    """(text, word_start, heading) of a page: by heading lines, each looked into for more; else by headings in the text; else the whole."""
    # Of white space only blanks and tabs don't end a line.
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END, -1), lambda x: F.btrim(x, F.lit(" \t")))
    told = F.transform(F.filter(trimmed, lambda x: x != ""), lambda x: F.struct(x.alias("line"), line_heading(x).alias("heading")))

    def whole(page: Column) -> Column:
        capitals = F.size(F.filter(F.regexp_extract_all(page, F.lit(WITHIN), F.lit(1)), lambda h: h == F.upper(h)))
        one = F.array(F.struct(page.alias("text"), F.lit(0).alias("word_start"), F.lit(None).cast("string").alias("heading")))
        plain = F.when(page != "", one).otherwise(F.array().cast(SECTION))
        found = W.bound(within(page, capitals >= 2), lambda x: F.when(F.size(x) > 0, x).otherwise(plain))
        # Most pages hold no heading at all and are read for one once.
        return F.when(page.rlike(CAPITAL), found).otherwise(plain)

    def read(lines: Column) -> Column:
        titled = F.exists(lines, lambda x: x["heading"].isNotNull())
        refined = F.flatten(F.transform(by_lines(lines), _refined))
        return F.when(titled, refined).otherwise(W.bound(flat(text), whole))

    return W.bound(told, read)


def section_chunks(pages: DataFrame, keys: list[str], text: str = "text", size: int = 900, overlap: int = 120) -> DataFrame:
    """Section-aware windows of every page, numbered on the page; a document's number is their order over its pages."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("a window needs a positive size and a smaller overlap")

    step = size - overlap

    def windows(section: Column) -> Column:
        text = section["text"]

        def window(at: Column, n: Column, body: Column) -> Column:
            begin = section["word_start"]
            return F.struct(
                (begin + at).alias("word_start"), (begin + F.least(n, at + size)).alias("word_end"), section["heading"].alias("section_heading"), body.alias("text")
            )

        def cut(n: Column) -> Column:
            # Runs of a step's words; a window is as many as it reaches into, up to its last word.
            runs = F.regexp_extract_all(text, F.lit(rf"[^ ]++(?: [^ ]++){{0,{step - 1}}}+"), F.lit(0))
            body = lambda every, k: F.substring_index(F.array_join(F.slice(every, k + 1, -(-size // step)), " "), " ", size)
            several = W.bound(runs, lambda every: F.transform(every, lambda _, k: window(k * step, n, body(every, k))))
            return F.when(n <= step, F.array(window(F.lit(0), n, text))).otherwise(several)

        # Words are parted by single blanks.
        return W.bound(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1, cut)

    every = F.flatten(F.transform(sections(F.col(text)), windows))
    kept = F.filter(every, lambda x: W.usable(x["text"]) & ~W.contents_like(x["text"]))
    numbered = pages.select(*keys, F.posexplode(kept).alias("chunk_on_page", "x"))
    blanks = F.col("x.word_end") - F.col("x.word_start") - 1
    density = W.letter_density(F.col("x.text"), F.length("x.text") - blanks)
    return numbered.select(*keys, "chunk_on_page", "x.word_start", "x.word_end", "x.section_heading", density.alias("text_density"), "x.text")
