"""Lexical top-k without scoring every match: blocks of postings, bounds and thresholds.

Chunks lie in blocks of 64, those with the most words first, as a chunk matches
no more words of a question than it has. A word's postings are one row for each
block that holds it, with a bit for each chunk: a common word is spread over as
many rows as there are blocks, and over ``SALTS`` parts where it is joined.

A question meets the postings of its words. In a block it can score no more than
the number of its words there: the block's bound. The counts of a block's chunks
are kept packed, four to a long, and sum up as the postings arrive. The blocks
with a question's best bounds are opened first; the k-th best count among their
chunks is the question's threshold, since k chunks reach it. Blocks whose bound is
below it are skipped, and of the others only chunks that reach it become rows. So
the result is that of scoring every pair of a question and a chunk that share a
word, ties included, while few such pairs are formed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import words as W
from lectern.storage import stored

#: Chunks in a block; counts in a long, and bits of one. Blocks that are opened for the threshold.
SLOTS, LANES, WIDTH = 64, 4, 16
FIRST = 2
#: Words of a question that a count can hold.
MOST = (1 << (WIDTH - 1)) - 1
#: Parts into which a word's postings are dealt.
SALTS = 16


@dataclass(frozen=True)
class Index:
    """places (place, ids, words): chunks in the order of their blocks. stored (word, block, bits): all postings, where they are kept."""

    places: DataFrame
    stored: DataFrame | None = None

    def postings(self, asked: DataFrame | None = None) -> DataFrame:
        """(word, block, bits): those that are kept, or, made for one batch of questions, those of its words."""
        if self.stored is not None:
            return self.stored
        held = self.places.select("place", F.explode("words").alias("word"))
        # Only words that some question asks for leave their place.
        return _postings(held if asked is None else held.join(asked.select("word").distinct(), "word", "left_semi"))


def index(chunks: DataFrame, ids: list[str], text: str, keep: bool = False) -> Index:
    """The blocks of some chunks, written once; the postings too where many batches of questions will ask (``keep``)."""
    # Chunks without words keep their places: a filter on the words would be pushed down and make them twice.
    words = chunks.select(F.struct(*ids).alias("ids"), W.search_words(F.col(text)).alias("words"))
    ordered = words.sortWithinPartitions(F.desc(F.size("words")), "ids")
    # Numbers of rows depend on the run, so they are written before anything refers to them.
    places = stored(ordered.select(F.monotonically_increasing_id().alias("place"), "ids", "words"), "places")
    return Index(places, stored(Index(places).postings(), "postings") if keep else None)


def _postings(held: DataFrame) -> DataFrame:
    block = F.call_function("div", F.col("place"), F.lit(SLOTS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("place"), F.lit(SLOTS)).cast("int"))
    return held.groupBy("word", block.alias("block")).agg(F.bit_or(bit).alias("bits"))


def asked_words(questions: DataFrame, qid: str, question: str, *others: str) -> DataFrame:
    """(qid, others, n_asked, word): a row for each distinct word that a question searches."""
    found = questions.select(F.col(qid).alias("qid"), *others, W.search_words(F.col(question)).alias("asked"))
    return found.select("qid", *others, F.size("asked").alias("n_asked"), F.explode("asked").alias("word"))


def _lanes(bits: Column) -> list[Column]:
    """The bits of a posting as packed ones: lane j of long i is slot 4 i + j."""
    packed = []
    for i in range(SLOTS // LANES):
        own = [F.shiftleft(F.shiftrightunsigned(bits, LANES * i + j).bitwiseAND(F.lit(1)), WIDTH * j) for j in range(LANES)]
        packed.append(own[0].bitwiseOR(own[1]).bitwiseOR(own[2]).bitwiseOR(own[3]))
    return packed


def _opened(blocks: DataFrame) -> DataFrame:
    """(qid, n_asked, block, slot, n) of the chunks of some blocks that reach ``least`` words."""
    counts = F.flatten(
        F.array(*[F.array(*[F.shiftrightunsigned(f"s{i}", WIDTH * j).bitwiseAND(F.lit((1 << WIDTH) - 1)) for j in range(LANES)]) for i in range(SLOTS // LANES)])
    )
    numbered = F.transform(counts, lambda n, i: F.struct(i.alias("slot"), n.alias("n")))
    reached = F.filter(numbered, lambda x: x["n"] >= F.col("least"))
    return blocks.select("qid", "n_asked", "block", F.explode(reached).alias("x")).select("qid", "n_asked", "block", "x.slot", "x.n")


def met_blocks(asked: DataFrame, found: Index) -> DataFrame:
    """(qid, n_asked, block, bound, packed counts) for every block that holds a word of a question."""
    salt = F.pmod(F.col("block"), F.lit(SALTS)).cast("int")
    dealt = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = found.postings(asked).withColumn("salt", salt).join(dealt, ["word", "salt"])
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(_lanes(F.col("bits")))]
    return hits.groupBy("qid", "n_asked", "block").agg(F.count("*").alias("bound"), *sums)


def thresholds(blocks: DataFrame, k: int, slack: int = 0) -> DataFrame:
    """(t_qid, least): the k-th best count in each question's most promising blocks, less ``slack``, or 1."""
    group = Window.partitionBy("qid")
    first = blocks.withColumn("turn", F.row_number().over(group.orderBy(F.desc("bound"), "block"))).where(F.col("turn") <= max(FIRST, -(-k // SLOTS) + 1))
    counts = _opened(first.withColumn("least", F.lit(1)))
    best = counts.withColumn("rank", F.row_number().over(group.orderBy(F.desc("n"), "block", "slot"))).where(F.col("rank") <= k)
    reached = F.when(F.max("rank") >= k, F.greatest(F.min("n") - F.lit(slack), F.lit(1))).otherwise(F.lit(1))
    return best.groupBy("qid").agg(reached.alias("least")).withColumnRenamed("qid", "t_qid")


def kept_blocks(blocks: DataFrame, k: int, slack: int = 0) -> DataFrame:
    """The blocks that a question opens: their bound reaches its threshold ``least``."""
    least = thresholds(blocks, k, slack)
    return blocks.join(least, F.col("qid").eqNullSafe(F.col("t_qid"))).drop("t_qid").where(F.col("bound") >= F.col("least"))


def candidates(asked: DataFrame, found: Index, k: int, slack: int = 0) -> DataFrame:
    """(qid, ids, score) of all chunks whose count reaches the question's threshold, among them its k best with their ties."""
    counts = _opened(kept_blocks(met_blocks(asked, found), k, slack))
    placed = counts.withColumn("place", F.col("block") * SLOTS + F.col("slot"))
    return placed.join(found.places.select("place", "ids"), "place").select("qid", "ids", (F.col("n") / F.col("n_asked")).alias("score"))
