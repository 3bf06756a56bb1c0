"""Tokenizers and small text functions, as Column -> Column.

Six tokenizers differ in stop words, folding and least length; each has a name
here, so that no operator picks the wrong one. All take ``[a-z0-9]+`` words of
the lower-case text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word forms that count as one word, and the stop words of each tokenizer.
VARIANTS = {
    "billed": "bill", "introduced": "introduce", "introduces": "introduce", "publication": "publish",
    "published": "publish", "screened": "screen", "screening": "screen", "duplicates": "duplicate",
    "eliminate": "remove", "eliminated": "remove", "eliminating": "remove", "elimination": "remove",
    "removed": "remove", "removes": "remove", "removing": "remove", "removal": "remove",
}
SEARCH_STOPWORDS = "a an and are does for from how in is of on or the this to what when who with".split()
VERIFIER_STOPWORDS = "a an and are as from in is it of on or the this to used were was with study".split()
NEGATIONS = "not no never without neither cannot".split()


def bound(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Values whose running totals are taken at a time.
TOTALLED = 64


def before(values: Column, zero: Column, merge) -> Column:
    """For each value of an array all values before it, merged; groups of values are merged first, so the work grows little faster than the array."""

    def grouped(every: Column) -> Column:
        groups = F.sequence(F.lit(0), F.call_function("div", F.greatest(F.size(every) - 1, F.lit(0)), F.lit(TOTALLED)).cast("int"))
        return F.transform(groups, lambda g: F.slice(every, g * TOTALLED + 1, TOTALLED))

    def within(group: Column, base: Column) -> Column:
        return F.transform(group, lambda _, i: F.aggregate(F.slice(group, F.lit(1), i), base, merge))

    def placed(groups: Column) -> Column:
        totals = F.transform(groups, lambda group: F.aggregate(group, zero, merge))
        up_to = lambda t, g: F.aggregate(F.slice(t, F.lit(1), g), zero, merge)
        return bound(totals, lambda t: F.flatten(F.transform(groups, lambda group, g: bound(up_to(t, g), lambda base: within(group, base)))))

    return bound(bound(values, grouped), placed)


def word_list(text: Column) -> Column:
    """All words in order, repeats included."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def word_set(text: Column) -> Column:
    """Distinct words without folding."""
    return F.array_distinct(word_list(text))


def matching_words(text: Column) -> Column:
    """Distinct words with their forms folded together."""
    forms = F.create_map(*[F.lit(x) for pair in VARIANTS.items() for x in pair])
    return F.array_distinct(F.transform(word_list(text), lambda w: F.coalesce(F.try_element_at(forms, w), w)))


def search_words(text: Column) -> Column:
    """Folded words of two letters or more, without the stop words of search."""
    stop = F.array(*[F.lit(w) for w in SEARCH_STOPWORDS])
    return F.filter(F.array_except(matching_words(text), stop), lambda w: F.length(w) > 1)


def verifier_words(text: Column) -> Column:
    """Unfolded words of two letters or more, without the verifier's stop words."""
    stop = F.array(*[F.lit(w) for w in VERIFIER_STOPWORDS])
    return F.filter(F.array_except(word_set(text), stop), lambda w: F.length(w) > 1)


def normalized(text: Column) -> Column:
    """The words joined by single blanks."""
    return F.array_join(word_list(text), " ")


#: White space that isn't a single blank already.
WIDE = r"\s(?:\s++|(?<! ))"


def collapsed(text: Column) -> Column:
    """White space collapsed to single blanks, none at the ends."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), WIDE, " "))


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's words that the text has; 0 without any."""
    size = F.size(query)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query, text)) / size)


def cut_with_ellipsis(text: Column, size: int, kept: int | None = None) -> Column:
    """The collapsed text, cut to ``kept`` characters and an ellipsis where it is longer than ``size``."""
    flat = collapsed(text)
    kept = size - 3 if kept is None else kept
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, kept)), F.lit("...")))


def truncated(text: Column, size: int = 320) -> Column:
    return cut_with_ellipsis(text, size)


def page_preview(text: Column, size: int = 240) -> Column:
    """A page's preview keeps one character less than its limit, before the ellipsis."""
    return cut_with_ellipsis(text, size, size - 1)


def usable(text: Column) -> Column:
    """At least four words and sixteen ASCII letters; a text is read no further than these."""
    return text.rlike("^[^A-Za-z0-9]*+(?:[A-Za-z0-9]++[^A-Za-z0-9]*+){4}") & text.rlike("^(?:[^A-Za-z]*+[A-Za-z]){16}")


def letter_density(text: Column, solid: Column | None = None) -> Column:
    """ASCII letters among the characters that are not white space (``solid``, where known), to four digits."""
    solid = F.length(F.regexp_replace(text, r"\s+", "")) if solid is None else solid
    return F.when(solid == 0, F.lit(0.0)).otherwise(F.bround(F.length(F.regexp_replace(text, "[^A-Za-z]++", "")) / solid, 4))


def contents_like(text: Column) -> Column:
    """Whether a text reads like a table of contents."""

    def told(flat: Column) -> Column:
        low = F.lower(flat)
        leaders = F.regexp_count(flat, F.lit(r"\.{4,}"))
        entries = F.regexp_count(flat, F.lit(r"\b[0-9]+(?:\.[0-9]+)*\.?\s+[A-Za-z][A-Za-z0-9 &:/,\-–]{2,90}\s+\.{4,}\s+[0-9]+\b"))
        topics = low.rlike(r"\b(?:contents|overview|objective|design|method|result|pipeline|verification)\b")
        # Every rule asks for dots in a row, so most texts are told at once.
        return (leaders > 0) & ((low.contains("table of contents")) | (entries >= 2) | (leaders >= 2) & topics)

    return F.when(F.contains(text, F.lit("....")), bound(collapsed(text), told)).otherwise(F.lit(False))


def similarity_score(distance: Column) -> Column:
    """A cosine distance as a score between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def page_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def joined_lines(text: Column) -> Column:
    """Words that a hyphen and white space cut become whole, then white space collapses."""
    whole = F.regexp_replace(text, r"(?<=[A-Za-z])-\s+(?=[A-Za-z])", "")
    return F.btrim(F.regexp_replace(whole, r"\s+", " "))
