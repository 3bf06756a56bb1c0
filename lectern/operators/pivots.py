"""Exact nearest vectors where both sides are large: blocks around pivots, and bounds by the triangle inequality.

Unit vectors are filed under their nearest pivot and a ring of distances around
it; a ring of many rows is dealt into blocks. A block knows the least and the
greatest distance of its rows from the pivot, so a question at distance d from
that pivot is at least max(d - greatest, least - d) from each of them. First a
question meets the blocks with the least such bound around its nearest pivot; the
k-th best score there is its own bound, with which all other blocks are ruled out
or met. A row's vector is moved once, to its block: rows of a block come first,
then one after the other the questions that the block can't rule out.

Pivots are chosen from a bounded sample, each the farthest from those before it;
they change how much is ruled out, never the result.

Cases: null vectors are left out; the zero vector is at similarity 0 from all; repeated ids are rows of their
own; equal scores are in the order of ids; with fewer rows than k all are met;
empty sides give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.storage import stored

#: Width of a ring, scores' last digit, and room for the rounding of sums.
RING, DIGIT, ROOM = 0.05, 1e-6, 1e-9
#: Numbers that a ring can have, and rings on either side of a question's own that it meets first.
RINGS, AROUND = 64, 3
#: Scores that are computed at a time, whatever the sizes of two blocks.
CELLS = 1 << 20
#: Vectors from which pivots are chosen.
SAMPLE = 4096


@dataclass(frozen=True)
class Pivots:
    """count: pivots. block: rows of a block. enough: rows that a question meets for its bound, times k."""

    count: int = 128
    block: int = 2048
    enough: int = 4


def unit(values: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(values, axis=1, keepdims=True)
    return values / np.where(norms == 0, 1, norms)


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def nearest(qs: np.ndarray, q: np.ndarray, rs: np.ndarray, r: np.ndarray, k: int, names: list[str]) -> pa.RecordBatch:
    """The best k rows of a block for each question of another, by cosine to six digits and then by id."""
    q, r, step = unit(q), unit(r).T, max(1, CELLS // max(1, len(rs)))
    ids, best = [np.zeros(0, rs.dtype)], [np.zeros(0)]
    for at in range(0, len(qs), step):
        scores = np.round(np.clip(q[at : at + step] @ r, 0, 1), 6)
        order = np.lexsort((np.broadcast_to(rs, scores.shape), -scores), axis=1)[:, :k]
        ids.append(rs[order].ravel())
        best.append(np.take_along_axis(scores, order, axis=1).ravel())
    found = np.concatenate(ids)
    own = np.repeat(qs, len(found) // max(1, len(qs)))
    return pa.RecordBatch.from_arrays([pa.array(own), pa.array(found), pa.array(np.concatenate(best))], names=names)


def choose(rows: DataFrame, rid: str, vector: str, count: int) -> np.ndarray:
    """Unit vectors of a sample, each the farthest from those chosen before it."""
    sample = rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(rid), rid).limit(SAMPLE).select(vector).toArrow()
    if not sample.num_rows:
        return np.zeros((0, 0))
    x = unit(np.array(sample[vector].to_pylist(), np.float64))
    chosen, far = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(count, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[chosen[-1]], axis=1))
    return x[chosen]


def _apart(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances from the pivots, and from no direction at all: where zero vectors are, as far as similarity 0 is."""
    from_pivots = np.sqrt(np.maximum(2 - 2 * (unit(x) @ pivots.T), 0))
    return np.concatenate([from_pivots, np.full((len(x), 1), np.sqrt(2))], axis=1)


def _vectors(df: DataFrame, ident: str, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull()).select(F.col(ident).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"))


def filed(rows: DataFrame, rid: str, vector: str, pivots: np.ndarray, config: Pivots) -> DataFrame:
    """(block, pivot, ring, part, d, i, v): every row under its pivot, ring and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), batch.num_rows)
                apart, zero = _apart(x, pivots), (x == 0).all(axis=1)
                own = np.where(zero, len(pivots), apart[:, :-1].argmin(axis=1)).astype(np.int32)
                d = np.where(zero, 0.0, apart[:, :-1].min(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(d), *batch.columns], names=["pivot", "d", "i", "v"])

    placed = _vectors(rows, rid, vector).mapInArrow(run, "pivot int, d double, i long, v array<double>").withColumn("ring", F.floor(F.col("d") / RING).cast("int"))
    # Written once: three jobs read it.
    placed = stored(placed, "filed")
    sizes = placed.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / F.lit(config.block)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("i"), F.col("parts").cast("long")).cast("int")
    dealt = placed.join(sizes, ["pivot", "ring"]).withColumn("part", part)
    block = F.shiftleft((F.col("pivot") * RINGS + F.col("ring")).cast("long"), 32) + F.col("part")
    return dealt.select(block.alias("block"), "pivot", "ring", "part", "d", "i", "v")


def _asked(questions: DataFrame, qid: str, vector: str, pivots: np.ndarray) -> DataFrame:
    """(q, qv, apart): every question with its distance from each pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = _apart(matrix(batch.column(1), batch.num_rows), pivots)
                lists = pa.ListArray.from_arrays(np.arange(0, apart.size + 1, apart.shape[1], dtype=np.int32), apart.ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["q", "qv", "apart"])

    return stored(_vectors(questions, qid, vector).mapInArrow(run, "q long, qv array<double>, apart array<double>"), "asked")


def block_sizes(placed: DataFrame) -> DataFrame:
    """(block, pivot, ring, part, least, greatest, rows) of every block."""
    return placed.groupBy("block", "pivot", "ring", "part").agg(F.min("d").alias("least"), F.max("d").alias("greatest"), F.count("*").alias("rows"))


def _bound() -> Column:
    """How near a row of a block can be to a question, whose distance from the block's pivot is ``at``."""
    return F.greatest(F.col("at") - F.col("greatest"), F.col("least") - F.col("at"), F.lit(0.0)) - ROOM


def met(placed: DataFrame, pairs: DataFrame, k: int, names: list[str]) -> DataFrame:
    """The best k rows of each block for each question (block, q, qv) that meets it."""
    own = placed.select("block", F.lit(0).alias("kind"), "i", "v")
    other = pairs.select("block", F.lit(1).alias("kind"), F.col("q").alias("i"), F.col("qv").alias("v"))
    # Blocks that no question meets stay where they are.
    asked = own.join(pairs.select("block").distinct(), "block", "left_semi")
    # Dealt by a hash of the block: a union of sides that are dealt by the block itself would be taken to be dealt already.
    stream = asked.union(other).repartition(F.xxhash64("block")).sortWithinPartitions("block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rs, r = None, [], []
        for batch in batches:
            b, kind, i = (batch.column(c).to_numpy() for c in range(3))
            if not len(b):
                continue
            v = matrix(batch.column(3), len(b))
            cuts = np.flatnonzero((np.diff(b) != 0) | (np.diff(kind) != 0)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(b)]):
                if b[low] != here:
                    here, rs, r = b[low], [], []
                if kind[low] == 0:
                    rs.append(i[low:high])
                    r.append(v[low:high])
                elif rs:
                    ids, vectors = np.concatenate(rs), np.concatenate(r)
                    rs, r = [ids], [vectors]
                    yield nearest(i[low:high], v[low:high], ids, vectors, k, names)

    return stream.mapInArrow(run, f"{names[0]} long, {names[1]} long, {names[2]} double")


def best(scored: DataFrame, k: int, qid: str, rid: str) -> DataFrame:
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("score"), rid)))
    return ranked.where(F.col("rank") <= k)


@dataclass(frozen=True)
class Search:
    """sizes: of the rows' blocks. asked: the questions. first, more: pairs (block, q, qv) of the two passes. scored: what they found."""

    sizes: DataFrame
    asked: DataFrame
    first: DataFrame
    more: DataFrame
    scored: DataFrame


def search(questions: DataFrame, rows: DataFrame, k: int, qid: str, rid: str, vector: str, config: Pivots = Pivots()) -> Search:
    """(qid, rid, score) in ``scored``: each question's k best rows and some others."""
    pivots = choose(rows, rid, vector, config.count)
    placed = stored(filed(rows, rid, vector, pivots, config), "blocks")
    sizes = stored(block_sizes(placed), "sizes")
    asked = _asked(questions, qid, vector, pivots)
    names = [qid, rid, "score"]

    # The rings around a question's own, of its two nearest pivots: a few blocks, of which those with enough rows are met.
    ordered = F.array_sort(F.transform("apart", lambda at, i: F.struct(at.alias("at"), i.alias("pivot"))))
    close = asked.select("q", "qv", F.explode(F.slice(ordered, 1, 2)).alias("x")).select("q", "qv", "x.at", "x.pivot")
    own = F.floor(F.col("at") / RING).cast("int")
    rings = close.withColumn("ring", F.explode(F.sequence(own - AROUND, own + AROUND)))
    few = sizes.where(F.col("part") < config.enough).join(rings, ["pivot", "ring"]).withColumn("bound", _bound())
    order = Window.partitionBy("q", "qv").orderBy("bound", "at", "block")
    before = F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = stored(few.withColumn("before", before).where(F.col("before") < config.enough * k).select("block", "q", "qv"), "pairs")
    begun = stored(met(placed, first, k, names), "scores")

    reached = best(begun, k, qid, rid).groupBy(F.col(qid).alias("t")).agg(F.count("*").alias("n"), F.min("score").alias("s"))
    # A row at this distance or nearer can have the k-th score; at a score of 0 every row can.
    reach = F.when((F.col("n") >= k) & (F.col("s") > 2 * DIGIT), F.sqrt(2 * (1 - F.col("s") + DIGIT)) + ROOM).otherwise(F.lit(float("inf")))
    limits = reached.select("t", reach.alias("reach"))
    near = asked.select("q", "qv", F.posexplode("apart").alias("pivot", "at")).join(limits, F.col("q") == F.col("t"), "left")
    bounded = near.drop("t").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    # Whole pivots first, a row for each of them, then their blocks.
    whole = sizes.groupBy("pivot").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    open_pivots = bounded.join(F.broadcast(whole), "pivot").where(_bound() <= F.col("reach")).drop("least", "greatest")
    pairs = open_pivots.join(sizes, "pivot").where(_bound() <= F.col("reach")).select("block", "q", "qv")
    more = stored(pairs.join(first.select("block", "q"), ["block", "q"], "left_anti"), "pairs")
    return Search(sizes, asked, first, more, begun.union(met(placed, more, k, names)))


def top(questions: DataFrame, rows: DataFrame, k: int, qid: str, rid: str, vector: str = "embedding", config: Pivots = Pivots()) -> DataFrame:
    """(qid, rid, score, rank): exact nearest rows by cosine, scores rounded to six digits, ties by id."""
    if rows.where(F.col(vector).isNotNull()).isEmpty():
        nothing = rows.sparkSession.createDataFrame([], f"{qid} long, {rid} long, score double")
        return best(nothing, k, qid, rid)
    return best(search(questions, rows, k, qid, rid, vector, config).scored, k, qid, rid)


def skipped(found: Search) -> DataFrame:
    """One row: pairs of a question and a block, and how many of them were ruled out."""
    asked, blocks = found.asked.count(), found.sizes.count()
    kept = found.first.count() + found.more.count()
    return found.asked.sparkSession.createDataFrame([(asked * blocks, asked * blocks - kept)], "pairs long, ruled_out long")
