"""Best-fit packing of tokenized documents by the sum-of-squares rule.

A document's ids and an end id make one item; only items longer than a sequence
are cut, into full pieces but for the first, which takes what is left over. Full
pieces are sequences of their own. The other pieces are packed in groups of
bounded size, longest first: each goes where, afterwards, the squared numbers
of open sequences per gap sum to the least; among equals into the smallest gap,
and into a new sequence last. The pieces of sequences that stay open are placed
anew, longest first, as long as that saves sequences.

Cases: a null or empty text is the end id alone; texts of any length are cut and
kept whole; ties in length go by key, then piece; repeated keys are packed as
documents of their own (rows of a piece are never merged); an empty table gives
an empty result; extra columns are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.storage import cut
from lectern.llm.tokens import batches_of, encoder


@dataclass(frozen=True)
class Packing:
    """group_pieces: pieces that are packed together in one task, about."""

    path: str = ""
    cut: str = "bytes"
    end_id: int = 2
    length: int = 1024
    group_pieces: int = 65_536
    with_ids: bool = False


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, taken in the order given."""
    open_at = np.zeros(capacity + 1, np.int64)  # open sequences per gap; none counts at gap 0
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    far = np.iinfo(np.int64).max
    for i, size in enumerate(lengths.tolist()):
        fits = open_at[size:capacity]
        gap, cost = 0, far
        if len(fits):
            change = 2 * (open_at[: capacity - size] - fits) + 2
            change[0] = 1 - 2 * fits[0]
            change[fits == 0] = far
            best = int(change.argmin())
            gap, cost = size + best, int(change[best])
        fresh = 2 * int(open_at[capacity - size]) + 1 if size < capacity else 0
        if cost <= fresh and cost < far:
            at = held[gap].pop()
            open_at[gap] -= 1
        else:
            at, gap, used = used, capacity, used + 1
        sequence[i], offset[i] = at, capacity - gap
        if gap > size:
            held[gap - size].append(at)
            open_at[gap - size] += 1
    return sequence, offset


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces that come longest first.

    Full sequences stay; all pieces of open ones are placed anew by the same
    rule, as long as that needs fewer sequences.
    """
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left, done, used = np.arange(len(lengths)), 0, np.iinfo(np.int64).max
    while len(left):
        own, place = sum_of_squares(lengths[left], capacity)
        n = int(own.max()) + 1
        if done + n >= used:
            break
        used = done + n
        full = np.bincount(own, weights=lengths[left], minlength=n) >= capacity
        # Full sequences get the next numbers, open ones the numbers after those.
        number = np.where(full, np.cumsum(full) - 1, full.sum() + np.cumsum(~full) - 1) + done
        sequence[left], offset[left] = number[own], place
        done += int(full.sum())
        left = left[~full[own]]
    return sequence, offset


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = "sequence_id long, offset long"


def pieces(docs: DataFrame, config: Packing, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The pieces of every document: (doc_id, piece, start, length, ids_crc32[, ids])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(config.path, config.cut) as tok:
            end = np.array([config.end_id], tok.dtype).tobytes()
            for batch in batches:
                texts, names = batch.column(1).to_pylist(), batch.column(0).to_pylist()
                for a, b in batches_of(texts):
                    rows: list[tuple] = []
                    for k, ids in zip(names[a:b], tok.encode(texts[a:b])):
                        raw = memoryview(np.frombuffer(ids + end, tok.dtype).astype("<u4")).cast("B")
                        n, at, piece = len(raw) // 4, 0, 0
                        stop = (n - 1) % config.length + 1
                        while at < n:
                            part = raw[4 * at : 4 * stop]
                            rows.append((k, piece, at, stop - at, zlib.crc32(part), bytes(part) if config.with_ids else None))
                            at, stop, piece = stop, stop + config.length, piece + 1
                    columns = list(zip(*rows))[: 6 if config.with_ids else 5]
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, kinds)],
                        names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)],
                    )

    schema = PIECES + (", ids binary" if config.with_ids else "")
    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, schema)


def pack(docs: DataFrame, config: Packing, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every piece with its sequence_id and its offset there, without gaps."""
    # Tokenized once; what follows reads the thin rows of the pieces.
    found = cut(pieces(docs, config, text, key))
    full = F.col("length") == config.length
    alone = found.where(full).select("*", (-F.monotonically_increasing_id() - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = found.where(~full)
    groups = max(1, -(-rest.count() // config.group_pieces))
    capacity = config.length

    def place(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, group = TaskContext.get().partitionId(), 0
        waiting: list[pa.RecordBatch] = []

        def packed() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(waiting).combine_chunks()
            rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
            sequence, offset = pack_lengths(rows["length"].to_numpy(), capacity)
            base = (task << 40) + (group << 28)
            rows = rows.append_column("sequence_id", pa.array(sequence + base, pa.int64()))
            yield from rows.append_column("offset", pa.array(offset, pa.int64())).combine_chunks().to_batches()

        # A task that gets far more than its share packs it in several groups.
        for table in tables:
            waiting.append(table)
            if sum(t.num_rows for t in waiting) >= 4 * config.group_pieces:
                yield from packed()
                waiting, group = [], group + 1
        if waiting:
            yield from packed()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema) + ", " + PLACED
    shared = rest.repartition(groups, F.xxhash64("doc_id", "piece", "ids_crc32"))
    return alone.unionByName(shared.mapInArrow(place, schema))
