"""Token-id files: static range asymmetric numeral systems, interleaved.

A file set is a Parquet folder whose rows are records (shard, seq, n_docs,
n_tokens, record), in ascending order of document by (shard, seq); Spark's
commit makes each appear whole or not at all. A record holds the ids of whole
documents and can be decoded alone:

    header    magic, scale bits, counts of documents, ids, symbols and blocks
    index     document keys, null marks, lengths               (deflated)
    table     symbols and their frequencies, summing to 2^18   (deflated)
    blocks    each: header, lane states, checkpoints, words, CRC-32

All blocks of a record share its frequency table and nothing else. In a block,
the ids are dealt over up to 1,024 lanes, each with a state of its own, whose
32-bit words are interleaved in the order of decoding. A checkpoint keeps the
lane states and the place among the words, so decoding can begin in mid-block.

Cases: a null or empty text is the end id alone; a document is never cut, so a
record is as long as its longest document at least; null keys come first and
stay null; repeated keys are kept in order of text; an empty table gives an
empty folder that reads back as no rows; extra columns are dropped.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.tokens import batches_of, encoder

MAGIC = b"LRN1"
SCALE = 18
LOW = np.uint64(1 << 31)
LANES = 1024
HEADER = struct.Struct("<4sBIQIII")
BLOCK = struct.Struct("<IHIHI")
SCHEMA = "shard int, seq int, n_docs int, n_tokens long, record binary"


@dataclass(frozen=True)
class TokenFiles:
    """record_tokens: ids from which on a record ends. block_tokens: ids in a block. checkpoint: steps between two."""

    path: str = ""
    cut: str = "words"
    end_id: int = 1
    record_tokens: int = 1 << 20
    block_tokens: int = 1 << 18
    checkpoint: int = 128


class Table:
    """A frequency table: symbols, their frequencies and where each one's slots begin."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray):
        self.symbols, self.freqs = symbols.astype(np.uint32), freqs.astype(np.uint64)
        self.starts = np.cumsum(self.freqs) - self.freqs

    @classmethod
    def of(cls, ids: np.ndarray) -> tuple[Table, np.ndarray]:
        """The table of some ids, and their numbers in it."""
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        number = np.zeros(len(counts), np.uint32)
        number[symbols] = np.arange(len(symbols))
        counts = counts[symbols]
        room = (1 << SCALE) - len(symbols)
        if room < 0:
            raise ValueError("more distinct ids than slots")
        freqs = 1 + counts * room // max(int(counts.sum()), 1)
        if len(freqs):
            freqs[counts.argmax()] += (1 << SCALE) - freqs.sum()
        return cls(symbols, freqs), number[ids]

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.freqs.astype(np.int64))


def encode_block(dense: np.ndarray, table: Table, checkpoint: int) -> bytes:
    """One block of dense symbol numbers."""
    n = len(dense)
    lanes = int(min(LANES, max(1, -(-n // 256))))
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks, written = [], 0
    for step in range(steps - 1, -1, -1):
        part = dense[step * lanes : (step + 1) * lanes]
        x, f = state[: len(part)], table.freqs[part]
        over = x >= f << np.uint64(63 - SCALE)
        if over.any():
            words.append(x[over].astype("<u4"))
            written += len(words[-1])
            x = np.where(over, x >> np.uint64(32), x)
        q = x // f
        state[: len(part)] = (q << np.uint64(SCALE)) + (x - q * f) + table.starts[part]
        if step and step % checkpoint == 0:
            marks.append((step, written, state.astype("<u8").tobytes()))
    stream = b"".join(w.tobytes() for w in reversed(words))
    kept = b"".join(struct.pack("<II", step, written - at) + s for step, at, s in reversed(marks))
    body = state.astype("<u8").tobytes() + kept + stream
    return BLOCK.pack(n, lanes, written, len(marks), zlib.crc32(body)) + body


def decode_block(
    data: memoryview, table: Table, slots: np.ndarray, begin: int = 0, until: int | None = None
) -> tuple[np.ndarray, int]:
    """Ids of the block at the start of data, from its checkpoint number ``begin`` up to id ``until`` at least, and the block's size."""
    n, lanes, n_words, n_marks, crc = BLOCK.unpack_from(data)
    size = 8 * lanes + n_marks * (8 + 8 * lanes) + 4 * n_words
    body = data[BLOCK.size : BLOCK.size + size]
    if len(body) != size or zlib.crc32(body) != crc:
        raise ValueError("a block's checksum does not match")
    first, at, states = 0, 0, body[: 8 * lanes]
    if begin:
        mark = 8 * lanes + (begin - 1) * (8 + 8 * lanes)
        first, at = struct.unpack_from("<II", body, mark)
        states = body[mark + 8 : mark + 8 + 8 * lanes]
    state = np.frombuffer(states, "<u8").astype(np.uint64)
    words = np.frombuffer(body[size - 4 * n_words :], "<u4").astype(np.uint64)
    last = -(-min(n, n if until is None else until) // lanes)
    out = np.empty(max(min(n, last * lanes) - first * lanes, 0), np.uint32)
    mask, scale = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    for step in range(first, last):
        k = min(lanes, n - step * lanes)
        x = state[:k]
        slot = x & mask
        symbol = slots[slot]
        x = table.freqs[symbol] * (x >> scale) + slot - table.starts[symbol]
        low = np.flatnonzero(x < LOW)
        if len(low):
            x[low] = (x[low] << np.uint64(32)) | words[at : at + len(low)]
            at += len(low)
        state[:k] = x
        out[(step - first) * lanes : (step - first) * lanes + k] = symbol
    return table.symbols[out], BLOCK.size + size


def block_span(data: memoryview) -> tuple[int, int, list[int]]:
    """A block's ids, its size, and the first id of each of its checkpoints, read from its head alone."""
    n, lanes, n_words, n_marks, _ = BLOCK.unpack_from(data)
    at = BLOCK.size + 8 * lanes
    marks = [struct.unpack_from("<I", data, at + k * (8 + 8 * lanes))[0] * lanes for k in range(n_marks)]
    return n, BLOCK.size + 8 * lanes + n_marks * (8 + 8 * lanes) + 4 * n_words, marks


def encode_record(keys: list[int | None], sizes: list[int], ids: np.ndarray, config: TokenFiles) -> bytes:
    """One record of whole documents."""
    table, dense = Table.of(ids)
    blocks = [
        encode_block(dense[a : a + config.block_tokens], table, config.checkpoint)
        for a in range(0, len(dense), config.block_tokens)
    ]
    known = np.array([k is not None for k in keys], np.uint8)
    index = np.array([k or 0 for k in keys], "<i8").tobytes() + known.tobytes() + np.array(sizes, "<u4").tobytes()
    freqs = table.symbols.astype("<u4").tobytes() + table.freqs.astype("<u4").tobytes()
    parts = [zlib.compress(x, 1) for x in (index, freqs)]
    head = HEADER.pack(MAGIC, SCALE, len(keys), len(ids), len(table.symbols), len(blocks), zlib.crc32(parts[0] + parts[1]))
    return b"".join([head, struct.pack("<II", *map(len, parts)), *parts, *blocks])


def _opened(record: bytes) -> tuple[list[int | None], np.ndarray, Table, list[memoryview], int]:
    """Keys, lengths, the frequency table and the blocks of a record, and how many ids it has."""
    data = memoryview(record)
    magic, _, n_docs, n_ids, n_symbols, n_blocks, crc = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a record of token ids")
    at = HEADER.size + 8
    a, b = struct.unpack_from("<II", data, HEADER.size)
    if zlib.crc32(data[at : at + a + b]) != crc:
        raise ValueError("a record's checksum does not match")
    index, freqs = zlib.decompress(data[at : at + a]), zlib.decompress(data[at + a : at + a + b])
    at += a + b
    keys = np.frombuffer(index, "<i8", n_docs).tolist()
    known = np.frombuffer(index, np.uint8, n_docs, 8 * n_docs)
    sizes = np.frombuffer(index, "<u4", n_docs, 9 * n_docs).astype(np.int64)
    table = Table(np.frombuffer(freqs, "<u4", n_symbols), np.frombuffer(freqs, "<u4", n_symbols, 4 * n_symbols))
    blocks = []
    for _ in range(n_blocks):
        size = block_span(data[at:])[1]
        blocks.append(data[at : at + size])
        at += size
    return [k if seen else None for k, seen in zip(keys, known)], sizes, table, blocks, n_ids


def decode_record(record: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, lengths and all ids of a record."""
    keys, sizes, table, blocks, n_ids = _opened(record)
    slots = table.slots()
    parts = [decode_block(block, table, slots)[0] for block in blocks]
    ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    if len(ids) != n_ids or sizes.sum() != n_ids:
        raise ValueError("a record's counts do not match")
    return keys, sizes, ids


def decode_documents(record: bytes, wanted: frozenset[int]) -> list[tuple[int, np.ndarray]]:
    """(key, ids) of some documents of a record: only their blocks are decoded, each from the checkpoint before them."""
    keys, sizes, table, blocks, _ = _opened(record)
    places = [i for i, k in enumerate(keys) if k in wanted]
    if not places:
        return []
    slots, starts = table.slots(), np.cumsum(sizes) - sizes
    spans = [block_span(block) for block in blocks]
    firsts = np.cumsum([0, *(n for n, _, _ in spans)])
    out = []
    for i in places:
        low, high, parts = int(starts[i]), int(starts[i] + sizes[i]), []
        for block, (n, _, marks), first in zip(blocks, spans, firsts.tolist()):
            a, b = max(low - first, 0), min(high - first, n)
            if a < b:
                begin = sum(m <= a for m in marks)
                ids, _ = decode_block(block, table, slots, begin, b)
                skipped = a - (marks[begin - 1] if begin else 0)
                parts.append(ids[skipped : skipped + b - a])
        out.append((keys[i], np.concatenate(parts) if parts else np.empty(0, np.uint32)))
    return out


def write(docs: DataFrame, path: str, config: TokenFiles, text: str = "text", key: str = "doc_id") -> None:
    """Tokenize all texts and write their ids in ascending order of key."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Whole documents go to ranges of keys; ids are made after this one exchange.
    ranged = (
        docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
        .repartitionByRange(shards, "k")
        .sortWithinPartitions("k", "t")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoder(config.path, config.cut) as tok:
            end = np.array([config.end_id], tok.dtype).tobytes()
            width, shard, seq = tok.dtype.itemsize, TaskContext.get().partitionId(), 0
            keys, sizes, held, total = [], [], [], 0

            def record() -> pa.RecordBatch:
                ids = np.frombuffer(b"".join(held), tok.dtype)
                row = {"shard": shard, "seq": seq, "n_docs": len(keys), "n_tokens": total}
                row["record"] = encode_record(keys, sizes, ids, config)
                return pa.RecordBatch.from_pylist([row], schema=_arrow())

            for batch in batches:
                texts, names = batch.column(1).to_pylist(), batch.column(0).to_pylist()
                for a, b in batches_of(texts):
                    for k, ids in zip(names[a:b], tok.encode(texts[a:b])):
                        keys.append(k)
                        held += (ids, end)
                        sizes.append(len(ids) // width + 1)
                        total += sizes[-1]
                        if total >= config.record_tokens:
                            yield record()
                            keys, sizes, held, total, seq = [], [], [], 0, seq + 1
            if keys:
                yield record()

    ranged.mapInArrow(run, SCHEMA).write.option("compression", "uncompressed").parquet(path)


def _arrow() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in SCHEMA.split(", "))])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(shard, seq, doc_id, place, n_tokens, ids): each document's ids, as little-endian 32-bit integers."""
    return _decoded(spark, path, True)


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(doc_id, ids) of the documents with some keys, a list that goes to every task."""
    wanted = frozenset(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record in batch.column(0):
                found = decode_documents(record.as_py(), wanted)
                ids = [x.astype("<u4").tobytes() for _, x in found]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return spark.read.schema(SCHEMA).parquet(path).select("record").mapInArrow(run, "doc_id long, ids binary")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read``, with ids_crc32 instead of the ids, and start: the ids of all documents before."""
    rows = _decoded(spark, path, False)
    records = spark.read.schema(SCHEMA).parquet(path).select("shard", "seq", "n_tokens")
    shards = records.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shard and per record: the ids that lie before.
    bases = shards.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    offsets = records.select("shard", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inner")).join(
        bases, "shard"
    )
    return rows.join(offsets, ["shard", "seq"]).select(
        "doc_id", (F.col("base") + F.col("inner") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )


def _decoded(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    last = "ids binary" if whole else "ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, sizes, ids = decode_record(batch.column(2)[row].as_py())
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4")).cast("B")
                spans = [raw[4 * (e - s) : 4 * e] for s, e in zip(sizes.tolist(), ends.tolist())]
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[row].as_py()] * n, pa.int32()),
                        pa.array([batch.column(1)[row].as_py()] * n, pa.int32()),
                        pa.array(keys, pa.int64()),
                        pa.array(ends - sizes, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array([bytes(s) for s in spans], pa.binary())
                        if whole
                        else pa.array([zlib.crc32(s) for s in spans], pa.int64()),
                    ],
                    names=["shard", "seq", "doc_id", "place", "n_tokens", last.split()[0]],
                )

    records = spark.read.schema(SCHEMA).parquet(path).select("shard", "seq", "record")
    return records.mapInArrow(run, f"shard int, seq int, doc_id long, place long, n_tokens long, {last}")
