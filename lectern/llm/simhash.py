"""SimHash near-duplicates, with pigeonring filtering of candidates.

A fingerprint has 64 bits, seen as a ring of eight 8-bit segments. If two
fingerprints differ in at most three bits, then some segment starts a chain
around the ring whose first l segments together differ in at most l * 3 / 8
bits, for every l. So in that chain the first two segments agree, the next
three together differ in at most one bit, six in two at most. Each fingerprint
is therefore filed under keys made of a start, the two segments there, and all
but one of the next three; fingerprints that share a key are candidates, the
chain condition prunes them, and a full Hamming check decides.

Equal fingerprints are merged before any of this, so copies cost nothing. Keys
that hold more fingerprints than ``block`` are split into blocks of that size
and every two blocks meet in a task of their own; what leaves a task is a
spanning forest of its links, never all pairs.

Cases: a null or blank text has no words, fingerprint zero, and links like any
other; so do rows without a key, whose component is named by another row's key
or, where there is none, by null; a text shorter than a shingle is one shingle; repeated rows share their
fingerprint; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import components
from lectern.llm.storage import cut, release

SEED = 42
SEGMENTS = 8
BITS = 3
#: Shingles whose bits are counted at a time.
COUNTED = 65_536
#: Members of a key that are compared by one table of all chains.
SMALL = 32


@dataclass(frozen=True)
class SimHash:
    """words: words in a shingle. block: fingerprints of one key that a task compares at a time."""

    words: int = 3
    block: int = 512


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit fingerprint of one text, of all its shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens)
    if not n:
        return 0
    if n <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(tokens), SEED)]
    else:
        joined = memoryview(b" ".join(tokens))
        sizes = np.fromiter(map(len, tokens), np.int64, n)
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: n - words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]
    return majority(np.array(hashes, dtype="<u8"))


def majority(values: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), COUNTED):
        part = values[at : at + COUNTED].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(values)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, config: SimHash = SimHash(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp): the fingerprint as a signed long holding the 64 bits."""
    words = config.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["k", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, fp long")


def _filed(distinct: DataFrame) -> DataFrame:
    """Each fingerprint under the keys of its chains: 8 starts times 3 omissions."""
    segment = lambda i: F.shiftrightunsigned(F.col("fp"), 8 * (i % SEGMENTS)).bitwiseAND(F.lit(255))
    keys = []
    for start in range(SEGMENTS):
        head, tail = (start, start + 1), (start + 2, start + 3, start + 4)
        for left_out in tail:
            used = [*head, *(i for i in tail if i != left_out)]
            key = F.lit(start * 3 + left_out - start - 2)
            for i in used:
                key = F.shiftleft(key, 8).bitwiseOR(segment(i))
            keys.append(key.cast("long"))
    return distinct.select("rep", "fp", F.explode(F.array(*keys)).alias("key"))


def chained(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whether some chain from a to b stays within the proportional budgets all around."""
    diff = (a ^ b).astype("<u8")
    per = np.bitwise_count(diff[..., None].view(np.uint8)).astype(np.int16)
    ring = np.concatenate([per, per[..., :-1]], axis=-1)
    good = np.zeros(diff.shape, bool)
    for start in range(SEGMENTS):
        total = np.cumsum(ring[..., start : start + SEGMENTS], axis=-1)
        good |= (total * SEGMENTS <= np.arange(1, SEGMENTS + 1) * bits).all(axis=-1)
    return good


def _forest(reps: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among some fingerprints, each edge towards the smaller node."""
    n = len(reps)
    order = np.argsort(reps)
    reps, fps = reps[order], fps[order]
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if n <= SMALL:
        table = chained(fps[:, None], fps[None, :]) & (np.bitwise_count(fps[:, None] ^ fps[None, :]) <= BITS)
    for i in range(1, n):
        near = np.flatnonzero(table[i, :i]) if n <= SMALL else _near(fps[i], fps[:i])
        for j in near.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(int(reps[i]), int(reps[r])) for i in range(n) if (r := root(i)) != i]


def _near(one: np.uint64, others: np.ndarray) -> np.ndarray:
    """Indexes of the others within the budget, after the prefixes of the chains have pruned them."""
    per = np.bitwise_count((others ^ one).astype("<u8")[:, None].view(np.uint8))
    two = per + np.roll(per, -1, axis=1)
    left = np.flatnonzero((two == 0).any(axis=1))
    left = left[chained(others[left], np.full(len(left), one, np.uint64))]
    return left[np.bitwise_count(others[left] ^ one) <= BITS]


def links(distinct: DataFrame, config: SimHash = SimHash()) -> DataFrame:
    """Edges (u, v) between representatives that connect all linked fingerprints.

    ``distinct`` has one row per fingerprint: rep (an integer that names it) and fp.
    """
    filed = _filed(distinct)
    crowded = filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    near = filed.join(crowded, "key")
    blocks = F.ceil(F.col("n") / F.lit(config.block)).cast("int")
    spread = near.withColumn("blocks", blocks).withColumn("own", F.pmod(F.hash("fp", F.lit(7)), F.col("blocks")))
    met = spread.select(
        "key",
        "rep",
        "fp",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("blocks") - 1),
                lambda other: F.struct(
                    F.least("own", other).alias("low"), F.greatest("own", other).alias("high")
                ),
            )
        ).alias("pair"),
    )
    groups = met.groupBy("key", "pair").agg(F.sort_array(F.collect_list(F.struct("rep", "fp"))).alias("members"))
    # The keys of one cluster hold the same members again and again: once is enough.
    once = groups.where(F.size("members") > 1).select("members").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
            flat = lists.flatten()
            reps = flat.field(0).to_numpy(zero_copy_only=False)
            fps = flat.field(1).to_numpy(zero_copy_only=False).view(np.uint64)
            edges = [e for a, b in zip(offsets, offsets[1:]) for e in _forest(reps[a:b], fps[a:b])]
            u, v = zip(*edges) if edges else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return once.mapInArrow(run, "u long, v long")


def _parts(marked: DataFrame, config: SimHash) -> DataFrame:
    """(fp, least, part) of every fingerprint of rows (k, fp): its least key, and the fingerprint that names its class."""
    # Fingerprints name themselves, so rows without a key link like any other.
    distinct = cut(marked.groupBy("fp").agg(F.min("k").alias("least")).select("fp", F.col("fp").alias("rep"), "least"))
    found = components(links(distinct.select("rep", "fp"), config))
    return cut(distinct.join(found, F.col("rep") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "rep").alias("part")))


def text_classes(docs: DataFrame, config: SimHash = SimHash(), text: str = "text") -> DataFrame:
    """(own, linked) of every text: its 64-bit hash (null: 42), and the fingerprint that names its class."""
    marked = cut(fingerprints(docs.select(F.xxhash64(text).alias("own"), F.col(text).alias("text")), config, "text", "own").distinct())
    named = cut(marked.join(_parts(marked, config), "fp").select(F.col("k").alias("own"), F.col("part").alias("linked")))
    release(docs.sparkSession)
    return named


def near_duplicates(
    docs: DataFrame, config: SimHash = SimHash(), text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(key, fingerprint, component_id) per row; the component is its smallest key."""
    marked = cut(fingerprints(docs, config, text, key))
    named = _parts(marked, config)
    first = named.groupBy("part").agg(F.min("least").alias("component_id"))
    placed = named.join(first, "part").select(F.col("fp").alias("own_fp"), "component_id")
    return marked.join(placed, F.col("fp") == F.col("own_fp"), "left").select(
        F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
