"""Quality rules with adaptive limits from mergeable quantile sketches.

Every document is measured on its whole text inside the JVM. A sketch per
(language, source) group summarises each ratio of the documents that pass the
base rules: counts in buckets whose width grows with their value, an error of
three percent at most. Such sketches merge by adding counts, in any order and
with the same result; those of a language's groups merge into the language's,
which serves groups too small to speak for themselves.

Limits are fences in the scale of ratios: the upper quartile times a power of
the quartiles' quotient. No width and no limit is a constant; the sketches alone
decide. They come back to the rows by an equi-join on the group key.

Cases: a null text is an empty one (no words, rejected); a null language or
source forms a group of its own, named by the empty string; repeated rows are
judged like any other; an empty table gives an empty result; extra columns pass
through ``filter_quality`` untouched unless they bear a name of ``RESULT``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.storage import cut, let, unused

BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@dataclass(frozen=True)
class Ratio:
    """A count over another one, both plus one. fence: quartile quotients beyond the quartile that still pass; low: whether below it too."""

    name: str
    count: str
    of: str
    fence: int
    low: bool = False


@dataclass(frozen=True)
class QualityRules:
    """Base limits, and how the adaptive ones are drawn from the sketches.

    min_group: passing documents that a group needs to have limits of its own.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    min_group: int = 100
    ratios: tuple[Ratio, ...] = (
        Ratio("symbols", "n_symbols", "n_words", 2),
        Ratio("dup_lines", "n_dup_lines", "n_lines", 4),
        Ratio("repeats", "n_repeat_words", "n_words", 4),
        Ratio("word_length", "word_chars", "n_words", 5, True),
    )


def _repeat_words(words: Column) -> Column:
    """Word positions covered by 3-word windows that occur twice or more."""
    none = F.array().cast("array<bigint>")
    windows = F.when(
        F.size(words) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
        ),
    ).otherwise(none)

    def covered(ordered: Column) -> Column:
        repeated = F.filter(
            ordered,
            lambda x, k: (F.get(ordered, k - 1)["h"] == x["h"]) | (F.get(ordered, k + 1)["h"] == x["h"]),
        )
        starts = F.sort_array(F.transform(repeated, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("total"), F.lit(-3).alias("last"))
        return F.aggregate(
            starts,
            start,
            lambda a, p: F.struct(
                (a["total"] + F.least(F.lit(3), p - a["last"])).alias("total"), p.alias("last")
            ),
            lambda a: a["total"],
        )

    def count(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(F.sort_array(pairs), covered)
        )

    return let(windows, count)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of ``RESULT`` up to ``n_repeat_words`` and ``n_lines``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(whole, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    n_words, chars, repeat = (
        lambda w: F.size(w).cast("long"),
        lambda w: F.length(F.array_join(w, "")).cast("long"),
        lambda w: _repeat_words(w).cast("long"),
    )
    counts = let(words, lambda w: F.struct(n_words(w).alias("n"), chars(w).alias("c"), repeat(w).alias("r")))
    by_line = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")
        ),
    )
    kept = [c for c in docs.columns if c not in (*RESULT, "n_lines")]
    measured = docs.select(
        *[F.col(c) for c in kept],
        counts.alias("__words"),
        by_line.alias("__lines"),
        F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    return measured.select(
        *[F.col(c) for c in kept],
        F.col("__words.n").alias("n_words"),
        F.col("__words.c").alias("word_chars"),
        "n_symbols",
        F.col("__lines.d").alias("n_dup_lines"),
        F.col("__words.r").alias("n_repeat_words"),
        F.col("__lines.n").alias("n_lines"),
    )


#: Ratios are whole numbers of this part; buckets up to LINEAR hold one value, later ones a sixteenth of their power of two.
UNIT, LINEAR = 1 << 20, 32


def scaled(ratio: Ratio) -> Column:
    """The ratio in units; one more of either keeps zero counts apart by the length of their text."""
    return F.call_function("div", (F.col(ratio.count) + 1) * F.lit(UNIT), F.col(ratio.of) + 1)


def bucket(value: Column) -> Column:
    """The sketch's bucket of a value: its power of two and the four bits that follow the first."""
    bits = F.length(F.bin(value))
    shifted = F.call_function("shiftright", value, F.greatest(bits - 5, F.lit(0)))
    return F.when(value < LINEAR, value).otherwise(bits.cast("long") * LINEAR + shifted)


def edge(found: Column, upper: int) -> Column:
    """Where a bucket begins (0) or ends (1)."""
    power = F.pow(F.lit(2.0), F.call_function("div", found, F.lit(LINEAR)) - 5)
    return F.when(found < LINEAR, found.cast("double")).otherwise((F.pmod(found, F.lit(LINEAR)) + upper) * power)


def sketches(passed: DataFrame, ratios: tuple[Ratio, ...]) -> DataFrame:
    """(q_lang, q_source, ratio, bucket, n): the sketches of all groups, a few hundred buckets each at most."""
    each = F.array(*[F.struct(F.lit(r.name).alias("ratio"), bucket(scaled(r)).alias("bucket")) for r in ratios])
    rows = passed.select("q_lang", "q_source", F.explode(each).alias("x")).select("q_lang", "q_source", "x.ratio", "x.bucket")
    return rows.groupBy("q_lang", "q_source", "ratio", "bucket").agg(F.count("*").alias("n"))


def merged(found: DataFrame, *keys: str) -> DataFrame:
    """The sketches of fewer keys: sums of the counts."""
    return found.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))


def quartiles(found: DataFrame, *keys: str) -> DataFrame:
    """(keys, ratio, total, q1, q3) of sketches: where the lower quartile's bucket begins and the upper one's ends."""
    group = Window.partitionBy(*keys, "ratio")
    up_to = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = found.select(*keys, "ratio", "bucket", F.sum("n").over(up_to).alias("below"), F.sum("n").over(group).alias("total"))
    at = lambda quarters: F.min(F.when(4 * F.col("below") >= quarters * F.col("total"), F.col("bucket")))
    return ranked.groupBy(*keys, "ratio").agg(F.max("total").alias("total"), edge(at(1), 0).alias("q1"), edge(at(3), 1).alias("q3"))


def limits(found: DataFrame, rules: QualityRules) -> DataFrame:
    """One row per (language, source) of the sketches, with the fences that hold there."""
    own = quartiles(found, "q_lang", "q_source")
    all_of = quartiles(merged(found, "q_lang"), "q_lang").withColumnsRenamed({"q1": "all_q1", "q3": "all_q3", "total": "all_total"})
    joined = own.join(all_of, ["q_lang", "ratio"])
    enough = F.col("total") >= rules.min_group
    low, high = F.when(enough, F.col("q1")).otherwise(F.col("all_q1")), F.when(enough, F.col("q3")).otherwise(F.col("all_q3"))
    rows = joined.select("q_lang", "q_source", "ratio", low.alias("low"), high.alias("high"), (high / low).alias("spread"))
    bounds = []
    for r in rules.ratios:
        least, most = F.col("low"), F.col("high")
        for _ in range(r.fence):
            least, most = least / F.col("spread"), most * F.col("spread")
        here = F.col("ratio") == r.name
        bounds.append(F.max(F.when(here, most)).alias(f"{r.name}_max"))
        if r.low:
            bounds.append(F.max(F.when(here, least)).alias(f"{r.name}_min"))
    return rows.groupBy("q_lang", "q_source").agg(*bounds)


def quality(
    docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """All columns of ``docs`` but the text, with counts, ``base_failed`` and ``kept``."""
    others = [c for c in docs.columns if c != text and c not in (*RESULT, "n_lines")]
    group = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # Columns of the caller's travel in one, so that no name here can be one of theirs.
    keyed = docs.select(F.struct(*others).alias("row"), F.col(text).alias("t"), group(lang).alias("q_lang"), group(source).alias("q_source"))
    # Measured once: both the sketches and the verdict read the small counts.
    measured = cut(measure(keyed, "t").drop("t"))
    failed = (F.col("n_words") < rules.min_words) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(rules.max_repeat_percent) * F.col("n_words")
    )
    found = cut(sketches(measured.where(~failed), rules.ratios))
    fences = limits(found, rules).withColumnsRenamed({"q_lang": "f_lang", "q_source": "f_source"})
    inside = F.lit(True)
    for r in rules.ratios:
        inside = inside & (scaled(r) <= F.col(f"{r.name}_max"))
        if r.low:
            inside = inside & (scaled(r) >= F.col(f"{r.name}_min"))
    judged = measured.join(
        fences, (measured["q_lang"] == fences["f_lang"]) & (measured["q_source"] == fences["f_source"]), "left"
    )
    return judged.select(
        "row.*",
        *[c for c in measured.columns if c not in ("row", "q_lang", "q_source")],
        failed.alias("base_failed"),
        (~failed & F.coalesce(inside, F.lit(True))).alias("kept"),
    )


def filter_quality(docs: DataFrame, rules: QualityRules = QualityRules(), key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose document passes; columns as they were.

    Rows are matched by (key, text), so rows that share a key by mistake are
    judged each by its own text; a null key is a value like any other.
    """
    own = unused(docs, "q_text")
    marked = docs.withColumn(own, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    asked = marked.select(F.col(key).alias("g_key"), F.col(own).alias("g_text"), "text", "lang", "source")
    good_key, good_text = unused(marked, "good_key"), unused(marked, "good_text")
    good = quality(asked, rules).where("kept").select(F.col("g_key").alias(good_key), F.col("g_text").alias(good_text)).distinct()
    rows = marked.join(good, F.col(key).eqNullSafe(F.col(good_key)) & (F.col(own) == F.col(good_text)), "left_semi")
    return rows.drop(own)
