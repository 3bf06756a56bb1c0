"""Secret scans: regular expressions behind a trigram inverted index.

Each rule's expression is parsed, and what every match must contain becomes a
Boolean query of trigrams: alternatives are joined by OR, the trigrams of the
literal runs of one alternative by AND. The trigrams that occur in queries are
indexed over all texts as postings (trigram, text), a text being known by its
64-bit hash. The postings of an alternative are intersected by counting; texts
that satisfy a query are candidates of its rule. Candidates are written before
they meet the texts, so that Spark knows their size and moves texts only where
they are many; there the expression is run. A rule whose expression has an
alternative without a trigram scans every text.

Spans are offsets in code points. They come from the pieces between matches and
the matches themselves, whose lengths add up to positions.

Cases: a null or empty text has no spans; texts of any length are scanned whole;
overlapping kinds all report; repeated rows share their postings; should two texts
share a hash, each is a candidate of the other's rules, which costs a look; an
empty table gives an empty result; extra columns pass through untouched, but
for one named as the column that ``scan`` is told to give.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

try:
    from re import _constants as codes
    from re import _parser as parser
except ImportError:  # Python before 3.11
    import sre_constants as codes
    import sre_parse as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.storage import let, stored, unused


@dataclass(frozen=True)
class Rule:
    """A kind of secret. least: characters that the match, or its group ``part``, has at least."""

    kind: str
    pattern: str
    least: int = 0
    part: int = 0


#: The first three are fixed by contract and report first where spans begin together.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\r\n]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9+/_.=-]{20,}"),
    Rule("url", r"[a-z][a-z0-9+.]{0,30}://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/:@]+@"),
)
RULES = BASE + MORE
#: Longest class of characters, and most alternatives, that a query spells out.
WIDE, MANY = 8, 64
#: Values whose running totals are taken at a time.
TOTALLED = 64
#: Characters of the pieces in which a long text is masked.
PIECE = 1024


def _spell(parsed) -> list[list[str]]:
    """Alternatives of an expression, each a list of literal runs that a match holds, in order.

    A run that may go on with the next item is marked by being last; "" cuts it.
    """
    ways: list[list[str]] = [[""]]
    for op, arg in parsed:
        if op is codes.LITERAL:
            options: list[list[str]] = [[chr(arg).lower()]]
        elif op is codes.IN and all(o is codes.LITERAL for o, _ in arg) and len(arg) <= WIDE:
            options = [[x] for x in sorted({chr(c).lower() for _, c in arg})]
        elif op is codes.SUBPATTERN:
            options = _spell(arg[-1])
        elif op is codes.BRANCH:
            options = [way for branch in arg[1] for way in _spell(branch)]
        elif op is codes.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
            options = [[""], *_spell(arg[2])]
        else:
            options = [["", ""]]
        if len(ways) * len(options) > MANY:
            options = [["", ""]]
        ways = [[*a[:-1], a[-1] + b[0], *b[1:]] for a, b in product(ways, options)]
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR of ANDs of lower-case trigrams that every match satisfies; None if it must scan."""
    clauses = set()
    for way in _spell(parser.parse(pattern)):
        grams = frozenset(run[i : i + 3] for run in way for i in range(len(run) - 2))
        if not grams:
            return None
        clauses.add(grams)
    # A clause that asks for more than another one adds nothing.
    return sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted)


def postings(docs: DataFrame, grams: list[str], text: str, key: str) -> DataFrame:
    """(gram, key): the inverted index of the trigrams that queries ask for."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    return docs.select(F.col(key).alias("key"), F.explode(found).alias("gram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], text: str, key: str) -> DataFrame:
    """(key, rules): a bit per rule whose query some text of that key satisfies."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not None}
    grams = sorted({g for q in queries.values() for clause in q for g in clause})
    asked = [
        (grams.index(g), n, i, len(clause))
        for n, (i, clause) in enumerate((i, clause) for i, q in queries.items() for clause in q)
        for g in clause
    ]
    spark = docs.sparkSession
    # As many rows as the rules have trigrams.
    clauses = F.broadcast(spark.createDataFrame(asked, "gram int, clause int, rule int, needed int"))
    # A text has each of its trigrams once, so a count is the size of the intersection.
    met = (
        postings(docs, grams, text, key)
        .distinct()
        .join(clauses, "gram")
        .groupBy("key", "clause", "rule", "needed")
        .agg(F.count("*").alias("n"))
        .where("n = needed")
    )
    return met.groupBy("key").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("rule"))).alias("rules"))


def before(values: Column, zero: Column, merge) -> Column:
    """For each value of an array all values before it, merged; groups of values are merged first, so the work grows little faster than the array."""

    def grouped(all_values: Column) -> Column:
        groups = F.sequence(F.lit(0), F.call_function("div", F.greatest(F.size(all_values) - 1, F.lit(0)), F.lit(TOTALLED)).cast("int"))
        return F.transform(groups, lambda g: F.slice(all_values, g * TOTALLED + 1, TOTALLED))

    def within(group: Column, base: Column) -> Column:
        return F.transform(group, lambda _, i: F.aggregate(F.slice(group, F.lit(1), i), base, merge))

    def placed(groups: Column) -> Column:
        totals = F.transform(groups, lambda group: F.aggregate(group, zero, merge))
        from_totals = lambda t: F.flatten(F.transform(groups, lambda group, g: let(F.aggregate(F.slice(t, F.lit(1), g), zero, merge), lambda base: within(group, base))))
        return let(totals, from_totals)

    return let(let(values, grouped), placed)


def _matches(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, kind order, end) of a rule's matches in a text."""
    pattern = F.lit(_run(rule))

    def from_pieces(found: Column) -> Column:
        pieces = F.split(text, _run(rule), -1)
        kept = F.regexp_extract_all(text, pattern, F.lit(rule.part)) if rule.part else found
        # The piece after the last match has no match beside it.
        parts = F.slice(F.arrays_zip(pieces.alias("piece"), found.alias("found"), kept.alias("kept")), F.lit(1), F.size(found))
        sized = F.transform(
            parts,
            lambda x: F.struct(
                F.length(x["piece"]).alias("gap"), F.length(x["found"]).alias("size"), (F.length(x["kept"]) >= rule.least).alias("enough")
            ),
        )

        def spans(sizes: Column) -> Column:
            ends = before(F.transform(sizes, lambda x: x["gap"] + x["size"]), F.lit(0), lambda a, b: a + b)
            begun = F.zip_with(
                sizes,
                ends,
                lambda x, at: F.when(
                    x["enough"],
                    F.struct((at + x["gap"]).alias("start"), F.lit(order).alias("order"), (at + x["gap"] + x["size"]).alias("end")),
                ),
            )
            return F.array_compact(begun)

        return let(sized, spans)

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), from_pieces)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` with the column ``into``: an array of (start, order, end), order being the rule's place in ``rules``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    own, key, bits = (unused(docs, name) for name in ("text_hash", "candidate", "rule_bits"))
    kept = [c for c in docs.columns if c != into]
    marked = docs.select(*kept, F.xxhash64(whole).alias(own))
    found = stored(candidates(docs.select(F.col(text).alias("text"), F.xxhash64(whole).alias("key")), rules, "text", "key"), "candidates")
    joined = marked.join(found.select(F.col("key").alias(key), F.col("rules").alias(bits)), F.col(own) == F.col(key), "left")
    empty = F.array().cast("array<struct<start:int,order:int,end:int>>")
    spans = []
    for i, rule in enumerate(rules):
        likely = (
            whole.rlike(_run(rule))
            if trigram_query(rule.pattern) is None
            else F.shiftright(F.coalesce(F.col(bits), F.lit(0).cast("long")), i).bitwiseAND(F.lit(1)) == 1
        )
        spans.append(F.when(likely, _matches(whole, rule, i)).otherwise(empty))
    return joined.select(*kept, F.array_sort(F.flatten(F.array(*spans))).alias(into))


def _run(rule: Rule) -> str:
    """The rule's expression; a run of one class that must be long enough is asked for at once.

    Runs are maximal, so leaving out short ones changes no other match.
    """
    single = rule.least and not rule.part and re.fullmatch(r"\[[^]]+\]\+", rule.pattern)
    return f"{rule.pattern[:-1]}{{{rule.least},}}" if single else rule.pattern


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]", text: str = "text") -> DataFrame:
    """``docs`` with every span of a secret replaced by the mask; spans that overlap are replaced together."""
    spans = unused(docs, "secrets")
    found = scan(docs, rules, text, spans)
    body = F.col(text)
    # A position in a long text is found from the beginning; in a piece of it, from the piece's.
    pieces = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def gap(parts: Column, begin: Column, end: Column) -> Column:
        first = F.call_function("div", begin, F.lit(PIECE)).cast("int")
        last = F.call_function("div", end, F.lit(PIECE)).cast("int")
        return F.substring(F.array_join(F.slice(parts, first + 1, last - first + 1), ""), begin - first * PIECE + 1, end - begin)

    def masked(all_spans: Column, parts: Column) -> Column:
        # A span that begins before those before it ended only prolongs them.
        reached = before(F.transform(all_spans, lambda x: x["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
        told = F.zip_with(all_spans, reached, lambda x, at: F.when(x["start"] >= at, F.concat(gap(parts, at, x["start"]), F.lit(mask))))
        last = F.array_max(F.transform(all_spans, lambda x: x["end"]))
        return F.concat(F.array_join(told, ""), gap(parts, last, F.length(body)))

    new = F.when(F.size(spans) > 0, let(pieces, lambda parts: let(F.col(spans), lambda x: masked(x, parts)))).otherwise(body)
    return found.select(*[new.alias(c) if c == text else F.col(c) for c in docs.columns])
