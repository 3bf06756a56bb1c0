"""How far the sources of a language differ in their use of terms.

Shares of terms are whole billionths and all sums are of whole numbers, so every
run gives the same rows. A term's counts by source form a sparse vector; terms
with the same vector are one, with a multiplicity, and every pair of sources is
evaluated once for it. A vector costs only the pairs of sources that it holds
both: with ``p`` a source's share and ``p0`` its share of a term that it lacks,
the sum over all terms of f(p, q) is the sum of f(p, q0), plus that of f(p0, q),
less f(p0, q0) for each term, plus f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0) for
terms that both hold. The first two need a histogram of counts per source alone.
For the ranks of terms, each vector keeps its first ``top`` terms: equal vectors
give equal values, of which those of the first terms alone can rank.

Counting is summed per batch in Python, then in Spark, before anything moves.
What is held at a time is a batch, or one vector, whose length is the number of
the language's sources; its square is the size of the result.

Cases: a null text, language or source is the empty string; a document without
terms makes its group occur; repeated rows are documents of their own; equal
values rank in the order of their items' bytes; a language without kept terms
gives its pairs with zero; one of a single source gives no pair; an empty table
gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.storage import stored

#: Runs of ASCII letters and all that is not ASCII, as UTF-8 with A to Z lower-cased.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Rows that leave a Python task at a time.
BATCH = 65_536


@dataclass(frozen=True)
class Audit:
    """documents: of a language that hold a term that is kept. unit: parts of a share. prior: added to each count.

    top: terms that are listed per source. salts: parts into which a language's sources are dealt where they meet.
    """

    documents: int = 10
    unit: int = 1_000_000_000
    prior: int = 2
    top: int = 10
    salts: int = 16


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: dict[tuple, Counter] = defaultdict(Counter)
            held: dict[tuple, Counter] = defaultdict(Counter)
            for *group, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                found = TERM.findall(words.as_py().lower())
                n[tuple(group)].update(found)
                held[tuple(group)].update(set(found))
            for (own_lang, own_source), counts in n.items():
                terms = list(counts)
                for at in range(0, len(terms), BATCH):
                    part = terms[at : at + BATCH]
                    here = held[own_lang, own_source]
                    columns = [
                        pa.array([own_lang] * len(part), pa.string()),
                        pa.array([own_source] * len(part), pa.string()),
                        pa.array(part, pa.binary()),
                        pa.array([counts[t] for t in part], pa.int64()),
                        pa.array([here[t] for t in part], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    read = docs.select(*_group(lang, source), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    found = read.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn("term", F.col("term").cast("string"))


def _group(lang: str, source: str) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"))]


def vectors(counts: DataFrame, config: Audit) -> DataFrame:
    """(lang, vector, m, terms): the distinct sparse vectors of kept terms, how many terms have each, and the first of them."""
    cell = F.struct("source", "n")
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(cell)).alias("vector"))
    kept = stored(terms.where(F.col("docs") >= config.documents).select("lang", "term", "vector"), "terms")
    place = F.row_number().over(Window.partitionBy("lang", "vector").orderBy("term"))
    first = kept.withColumn("place", place).where(F.col("place") <= config.top).select("lang", "vector", F.lit(0).cast("long").alias("m"), "term")
    many = kept.groupBy("lang", "vector").agg(F.count("*").alias("m")).withColumn("term", F.lit(None).cast("string"))
    once = first.union(many).groupBy("lang", "vector").agg(F.sum("m").alias("m"), F.sort_array(F.collect_list("term")).alias("terms"))
    return stored(once.withColumn("id", F.monotonically_increasing_id()), "vectors")


def _div(above: Column, below: Column) -> Column:
    """The whole quotient of numbers that aren't negative."""
    return F.call_function("div", above, below)


def _share(n: Column, total: Column, kinds: Column, config: Audit) -> Column:
    """One more than a count's rounded-down share, in units; exact for counts of any size."""
    wide = lambda c: c.cast("decimal(24,0)")
    above = wide(n + F.lit(config.prior)) * F.lit(config.unit).cast("decimal(12,0)")
    return _div(above, wide(F.greatest(total + F.lit(config.prior) * kinds, F.lit(1)))) + F.lit(1).cast("long")


def _apart(p: Column, q: Column) -> Column:
    """The rounded-down quotient of the squared difference of two shares and their sum."""
    return _div((p - q) * (p - q), p + q)


def totals(docs: DataFrame, found: DataFrame, config: Audit, lang: str, source: str) -> DataFrame:
    """(lang, source, total, kinds, p0, lang_total) per occurring group: occurrences of kept terms, kept terms of the language, the share of a term it lacks."""
    groups = docs.select(*_group(lang, source)).distinct()
    cell = found.select("lang", "m", F.explode("vector").alias("c"))
    own = cell.groupBy("lang", F.col("c.source").alias("source")).agg(F.sum(F.col("c.n") * F.col("m")).alias("total"))
    counted = groups.join(own, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    kinds = found.groupBy("lang").agg(F.sum("m").alias("kinds"))
    whole = counted.groupBy("lang").agg(F.sum("total").alias("lang_total")).join(kinds, "lang", "left").withColumn("kinds", F.coalesce("kinds", F.lit(0)))
    return counted.join(whole, "lang").withColumn("p0", _share(F.lit(0), F.col("total"), F.col("kinds"), config))


def _pairs(cells: DataFrame, groups: DataFrame, config: Audit) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, both ways."""
    # Counts of a source, 0 among them, and how many terms have each, meet the other sources' share of terms that they lack.
    held = cells.groupBy("lang", "source", "p", "p0").agg(F.sum("m").alias("m"))
    lacking = held.groupBy("lang", "source").agg(F.sum("m").alias("held"))
    rest = groups.join(lacking, ["lang", "source"], "left").withColumn("m", F.col("kinds") - F.coalesce("held", F.lit(0)))
    # A source that lacks a term takes f(p0, q0) off once for every term of its pairs with sources after it.
    one = rest.select("lang", "source", F.col("p0").alias("p"), "m", "kinds")
    every = held.select("lang", "source", "p", "m", F.lit(0).cast("long").alias("kinds")).union(one)
    dealt = every.withColumn("salt", F.pmod(F.hash("source", "p"), F.lit(config.salts)))
    others = groups.select("lang", F.col("source").alias("item"), "p0", F.explode(F.sequence(F.lit(0), F.lit(config.salts - 1))).alias("salt"))
    met = dealt.join(others, ["lang", "salt"]).where("source <> item")
    sided = F.col("m") * _apart(F.col("p"), F.col("p0")) - F.when(F.col("source") < F.col("item"), F.col("kinds") * _apart(F.col("p"), F.col("p0"))).otherwise(0)
    outer = met.select("lang", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b"), sided.alias("value"))
    # Two sources that hold the same vector.
    side = F.struct("source", "p", "p0")
    lists = cells.groupBy("id", "lang", "m").agg(F.sort_array(F.collect_list(side)).alias("sides"))
    first = lists.select("lang", "m", "sides", F.posexplode("sides").alias("at", "x"))
    both = first.select("lang", "m", "x", F.explode(F.slice("sides", F.col("at") + 2, F.size("sides"))).alias("y"))
    p, p0, q, q0 = (F.col(c) for c in ("x.p", "x.p0", "y.p", "y.p0"))
    shared = F.col("m") * (_apart(p, q) - _apart(p, q0) - _apart(p0, q) + _apart(p0, q0))
    inner = both.select("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), shared.alias("value"))
    sums = outer.union(inner).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return sums.select("lang", "value", F.explode(ways).alias("way")).select("lang", "way.source", "way.item", "value")


def divergence(docs: DataFrame, config: Audit = Audit(), text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources of each source, and the terms that it uses most beyond its language."""
    found = vectors(term_counts(docs, text, lang, source), config)
    groups = stored(totals(docs, found, config, lang, source), "groups")
    n_lang = F.aggregate("vector", F.lit(0).cast("long"), lambda t, c: t + c["n"])
    opened = found.select("id", "lang", "m", "terms", n_lang.alias("n_lang"), F.explode("vector").alias("c"))
    cells = opened.select("id", "lang", "m", "terms", "n_lang", "c.source", "c.n").join(groups, ["lang", "source"])
    cells = cells.withColumn("p", _share(F.col("n"), F.col("total"), F.col("kinds"), config))
    whole = _share(F.col("n_lang"), F.col("lang_total"), F.col("kinds"), config)
    over = cells.withColumn("q", whole).where("p > q").select("lang", "source", F.explode("terms").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    ranked = lambda part, df: df.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value",
        F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank"),
    )
    return ranked("pair", _pairs(cells, groups, config)).union(ranked("term", over).where(F.col("rank") <= config.top))
