"""Vectors by content: a text is embedded once, whatever chunks hold it and however often they are indexed.

The store is a table (content, embedding), content being the SHA-256 of the text,
in a folder of snapshots. Texts that are asked for first meet a bitmap of hashed
places, of fixed size: a text whose place is empty is new. Only the others are
looked up in the store itself, by an anti-join on the content. New texts are
embedded, each once, and appended. The dimension is noted with the table, and a
change of it is refused before anything is embedded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources import ingest as I
from lectern.sources import snapshots as S
from lectern.storage import unused

#: Places of the bitmap, as a power of two; it has at most 2 ** (PLACES - 6) rows, whatever the store holds.
PLACES = 24
TABLE = "vectors"


def _place(content):
    place = F.pmod(F.xxhash64(content), F.lit(1 << PLACES))
    word = F.call_function("div", place, F.lit(64))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    return word, bit


def bitmap(store: DataFrame) -> DataFrame:
    """(word, bits): which hashed places some content of the store has."""
    word, bit = _place("content")
    return store.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))


def unknown(contents: DataFrame, store: DataFrame) -> DataFrame:
    """The rows of ``contents`` (content, text) that the store hasn't, by the bitmap and, where it says maybe, by the store."""
    word, bit = _place("content")
    marked = contents.withColumn("word", word).withColumn("bit", bit)
    # At most 2 ** 18 rows of two longs.
    seen = marked.join(F.broadcast(bitmap(store)), "word", "left")
    maybe = F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))
    new = seen.where(~maybe).select("content", "text")
    doubtful = seen.where(maybe).select("content", "text").join(store.select("content"), "content", "left_anti")
    return new.unionByName(doubtful)


def embed(
    chunks: DataFrame, folder: str, embedder: Callable[[list[str]], list[list[float]]], dimension: int, text: str = "text"
) -> DataFrame:
    """``chunks`` with their embedding, null for a null text; texts that the folder's store doesn't have are embedded and kept there."""
    spark = chunks.sparkSession
    before = S.current(spark, folder)
    known = before.notes.get(TABLE)
    if known is not None and int(known) != dimension:
        raise ValueError(f"the store holds vectors of {known} dimensions, not {dimension}")
    told, vector = unused(chunks, "content_key"), unused(chunks, "embedding")
    marked = chunks.withColumn(told, F.sha2(F.col(text), 256))
    contents = marked.where(F.col(told).isNotNull()).groupBy(F.col(told).alias("content")).agg(F.min(text).alias("text"))
    if TABLE in before.paths:
        contents = unknown(contents, S.read(spark, folder, TABLE, before))
    commit = S.Commit(spark, folder)
    found = I.embed(contents, "text", embedder, dimension).select("content", "embedding")
    commit.write(TABLE, found, append=True, note=str(dimension))
    commit.publish()
    store = S.read(spark, folder, TABLE).select(F.col("content").alias(unused(marked, "content")), F.col("embedding").alias(vector))
    key = store.columns[0]
    return marked.join(store, F.col(told) == F.col(key), "left").select(*[F.col(c) for c in chunks.columns], F.col(vector))
