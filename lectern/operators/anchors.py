"""Quotes in the chunks of their page: which runs of neighbouring chunks hold each, from one pass over the page.

The chunks of a page come in order, behind the quotes that are asked of it. Each
is joined to what came before, where the longest end that it begins with counts
once, and remembers where it begins and where the text ends with it. An automaton
of all the page's quotes reads only what each chunk adds, keeping its state over
the edges. A quote that lies from p to q is held by the chunks from the last that
begins by p to the first that ends by q, so the shortest runs follow from
positions; no run is ever put together to be searched.

Should a chunk begin before the one it follows (a text that holds its
predecessor's whole), a run's text depends on where it starts: then the page's
runs are joined and searched one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectern.operators.evaluation import join_sources, source_text


class Page:
    """The joined text of chunks as they come, and the places of quotes in it."""

    def __init__(self, quotes: Iterable[str]) -> None:
        self.quotes = sorted({source_text(q) for q in quotes})
        self.automaton = ahocorasick.Automaton()
        for q in filter(None, self.quotes):
            self.automaton.add_word(q, q)
        self.automaton.make_automaton()
        self.begin()

    def begin(self) -> None:
        """Nothing read yet, or not since a gap between chunks."""
        self.joined, self.texts, self.indexes, self.starts, self.ends = "", [], [], [], []
        self.found: dict[str, list[int]] = {}
        self.reader = None

    def _shared(self, text: str) -> int:
        """How much of a text's beginning is there already, up to a word's end."""
        size = min(len(text), len(self.joined))
        while size > 0:
            if (size == len(text) or text[size] == " ") and self.joined.endswith(text[:size]):
                return size
            size = text.rfind(" ", 0, size)
        return 0

    def add(self, index: int, raw: str | None) -> None:
        text = source_text(raw or "")
        shared = self._shared(text)
        new = text[shared:] if shared or not self.texts else f" {text}"
        self.starts.append(len(self.joined) - shared if shared or not self.texts else len(self.joined) + 1)
        self.joined += new
        self.ends.append(len(self.joined))
        self.indexes.append(index)
        self.texts.append(text)
        if not len(self.automaton) or not new:
            return
        if self.reader is None:
            self.reader = self.automaton.iter(new)
        else:
            self.reader.set(new)
        for last, quote in self.reader:
            self.found.setdefault(quote, []).append(last + 1 - len(quote))

    def runs(self, quote: str) -> list[tuple[int, int]]:
        """The shortest runs (first, last place) around each occurrence of a quote; none that holds another."""
        if any(b < a for a, b in zip(self.starts, self.starts[1:])):
            return self._tried(quote)
        places = [0] if not quote and self.texts else self.found.get(quote, [])
        found, first, last = set(), 0, 0
        for p in places:
            while last < len(self.ends) - 1 and self.ends[last] < p + len(quote):
                last += 1
            while first < len(self.starts) - 1 and self.starts[first + 1] <= p:
                first += 1
            if first <= last:
                found.add((first, last))
            else:
                # Chunks that overlap hold it each.
                found.update((i, i) for i in range(last, first + 1))
        if not quote:
            found = {(i, i) for i in range(len(self.texts))}
        return _least(found)

    def _tried(self, quote: str) -> list[tuple[int, int]]:
        found = set()
        for first in range(len(self.texts)):
            last = next((k for k in range(first, len(self.texts)) if quote in join_sources(self.texts[first : k + 1])), None)
            if last is not None:
                found.add((first, last))
        return _least(found)


def _least(runs: set[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs that hold no other: none that begins later ends as early."""
    out, end = [], None
    for first, last in sorted(runs, key=lambda r: (-r[0], r[1])):
        if end is None or last < end:
            out.append((first, last))
            end = last
    return out[::-1]


def shortest(page: Page, quote: str) -> list[int]:
    """The chunk indexes of the shortest run, the first of equals."""
    runs = page.runs(source_text(quote))
    if not runs:
        return []
    first, last = min(runs, key=lambda r: (r[1] - r[0], r[0]))
    return page.indexes[first : last + 1]


def _streamed(anchors: DataFrame, chunks: DataFrame, keys: list[str], whole: bool) -> DataFrame:
    """(keys, quote, chunk_indexes) per distinct quote of a page; ``whole``: its chunks follow one another whatever their indexes."""
    kinds = {k: anchors.schema[k].dataType.simpleString() for k in keys}
    asked = anchors.select(*keys, F.lit(0).alias("kind"), F.lit(0).alias("chunk_index"), F.col("quote").alias("text")).distinct()
    given = chunks.select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys], F.lit(1).alias("kind"), F.col("chunk_index").cast("int"), "text")
    # Pages without quotes are not read.
    told = given.join(asked.select(*keys).distinct(), keys, "left_semi").select(asked.columns)
    types = [to_arrow_type(anchors.schema[k].dataType) for k in keys]
    # Dealt by a hash of the keys: a union of sides that are dealt by the keys themselves would be taken to be dealt already.
    stream = asked.union(told).repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, "kind", "chunk_index", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, quotes, page, held = None, [], None, {}

        def close() -> list[tuple]:
            if here is None:
                return []
            keep()
            return [(*here, q, sorted(held.get(q, ())) if not whole else shortest(page, q or "") if page else []) for q in quotes]

        def keep() -> None:
            # What a stretch of neighbours covers.
            if page is not None and not whole:
                for q in quotes:
                    for first, last in page.runs(source_text(q or "")):
                        held.setdefault(q, set()).update(page.indexes[first : last + 1])

        for batch in batches:
            rows = []
            for *key, kind, index, text in zip(*(c.to_pylist() for c in batch.columns)):
                if tuple(key) != here:
                    rows += close()
                    here, quotes, page, held = tuple(key), [], None, {}
                if kind == 0:
                    quotes.append(text)
                    continue
                if page is None:
                    page = Page(q or "" for q in quotes)
                elif not whole and index != page.indexes[-1] + 1:
                    keep()
                    page.begin()
                page.add(index, text)
            yield _batch(rows)
        yield _batch(close())

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * (len(keys) + 2)
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        arrays += [pa.array(columns[-2], pa.string()), pa.array(columns[-1], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(arrays, names=[*keys, "quote", "chunk_indexes"])

    fields = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return stream.mapInArrow(run, f"{fields}, quote string, chunk_indexes array<int>")


def _back(anchors: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """The anchors, each with what was found for its quote."""
    named = found.select(*[F.col(c).alias(f"__{c}") for c in (*keys, "quote")], "chunk_indexes")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*keys, "quote")]
    joined = anchors.join(named, same, "left")
    none = F.array().cast("array<int>")
    return joined.select(*[F.col(c) for c in anchors.columns], F.coalesce("chunk_indexes", none).alias("chunk_indexes"))


def resolve(anchors: DataFrame, chunks: DataFrame, document: str = "document_id", page: str = "page_number") -> DataFrame:
    """``anchors`` (document, page, quote) with chunk_indexes: the shortest run that holds each, empty where none does."""
    return _back(anchors, _streamed(anchors, chunks, [document, page], True), [document, page])


def coverage(hits: DataFrame, anchors: DataFrame, keys: list[str], page: str = "page_number") -> DataFrame:
    """(keys, page, quote, covered, chunk_indexes): the retrieved chunks of its page that hold each quote, in neighbouring groups and none too many."""
    asked = anchors.select(*keys, page, "quote")
    # A chunk that was retrieved twice is one.
    once = hits.groupBy(*keys, page, "chunk_index").agg(F.min("text").alias("text"))
    found = _streamed(asked, once, [*keys, page], False)
    return _back(asked, found, [*keys, page]).withColumn("covered", F.size("chunk_indexes") > 0).select(*keys, page, "quote", "covered", "chunk_indexes")
