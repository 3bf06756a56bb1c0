"""Edited copies by SimHash: texts whose sets of five-word shingles have a Jaccard of 0.8 or more.

At this similarity fingerprints differ in some ten of 64 bits, and a chain of
segments within a budget that covers it may begin with three differing bits of
eight, so no key of equal segments is selective. Texts are therefore filed under
min-wise keys of their shingles: ``keys`` of them, each of ``rows`` minima, so
that two texts at 0.8 miss one another with a probability of
(1 - 0.8 ^ 4) ^ 24, three in a million. Among the members of a key, sizes, the
pigeonring chains of the fingerprints, the full Hamming check, the share of equal
minima and the parities of hashed places prune (what is odd in one set and even
in the other is a part of what they don't share), and the two sets of shingles
decide, exactly.

Texts with the same shingles are one node, and of keys with the same members one
is kept. First every member of a key meets the likeliest one before it in its
block, and the first of a block the head of the key: a pair for each, which
joins most of what belongs together. Keys that are one group then drop out. In
the others, those that are not in the head's group meet all members of other
groups, block by block, under the first key that two share. So a key of very
many copies is a few comparisons for each.

Cases: null and blank texts have no shingles and are copies of each other; a text
shorter than a shingle is one shingle; repeated rows share their set; null keys
count as rows but name no component; an empty table gives an empty result; extra
columns are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import components
from lectern.llm.simhash import chained, majority
from lectern.llm.storage import cut, release, stored

#: Jaccard similarity from which texts are copies, as a fraction.
NEAR, OF = 4, 5
#: Differing bits of 64 that fingerprints of such texts stay within, but for one pair in ten million;
#: those of fewer shingles vary more and don't prune.
BITS, FEW = 24, 32
#: Standard deviations below the mean of equal minima from which on two sets are not alike: one pair in a million.
SURE = 5.0
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Places, as a power of two, of which a set's parities are kept.
PLACES = 10
#: Shingles that are hashed for all keys at a time.
HASHED = 8192


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    each = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    size = min(words, len(each))
    if not size:
        return each
    total = np.zeros(len(each) - size + 1, np.uint64)
    for i in range(size):
        total = total * MIX + each[i : i + len(total)]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(total ^ total >> np.uint64(29))


def _factors(n: int) -> np.ndarray:
    """Odd multipliers, each an order of its own of all hashes."""
    return np.fromiter((xxhash.xxh64_intdigest(str(i)) | 1 for i in range(n)), np.uint64, n)[:, None]


def minima(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least shingle of a set in each order."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), HASHED):
        np.minimum(least, (found[at : at + HASHED][None, :] * factors).min(axis=1), out=least)
    return least


@dataclass(frozen=True)
class Copies:
    """words: words in a shingle. keys, rows: min-wise keys, and minima in one. block: members of a key that are compared at a time.

    orders: what tells some number of orders of all shingles apart. least: the least shingle of a set in each of
    them. chains: whether SimHash fingerprints prune; without, all fingerprints are one.
    """

    words: int = 5
    keys: int = 24
    rows: int = 4
    block: int = 256
    orders: Callable[[int], np.ndarray] = _factors
    least: Callable[[np.ndarray, np.ndarray], np.ndarray] = minima
    chains: bool = True


def min_keys(least: np.ndarray, config: Copies) -> np.ndarray:
    """Keys made of ``rows`` minima each."""
    parts = least.reshape(config.keys, config.rows)
    total = np.arange(1, config.keys + 1, dtype=np.uint64) * MIX
    for i in range(config.rows):
        total = (total ^ parts[:, i]) * MIX
        total ^= total >> np.uint64(29)
    return total.view(np.int64)


def parities(found: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles is hashed to each place."""
    places = (found >> np.uint64(64 - PLACES)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=1 << PLACES) & 1).astype(np.uint8))


def marks_of(found: np.ndarray, factors: np.ndarray, config: Copies) -> bytes:
    """A byte of each minimum, four bytes of each key, and the parities: how many minima are equal, which key is shared first, what differs."""
    least = config.least(found, factors)
    keys = min_keys(least, config).view(np.uint64) >> np.uint64(32)
    return (least >> np.uint64(32)).astype(np.uint8).tobytes() + keys.astype(np.uint32).tobytes() + parities(found).tobytes()


def least_equal(config: Copies) -> int:
    """Equal minima that two sets at the similarity have at least, but for one pair in a million."""
    n, share = config.keys * config.rows, NEAR / OF
    return int(n * share - SURE * (n * share * (1 - share)) ** 0.5)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have the similarity."""
    if min(len(a), len(b)) * OF < max(len(a), len(b)) * NEAR:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * (OF + NEAR) >= NEAR * (len(a) + len(b))


def _near(n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sizes, chains and Hamming distance leave a pair possible."""
    good = np.minimum(n, m) * OF >= np.maximum(n, m) * NEAR
    many = np.flatnonzero(good & (np.minimum(n, m) >= FEW))
    one, other = np.broadcast_to(a, good.shape)[many], b[many]
    good[many] = chained(one, other, BITS) & (np.bitwise_count(one ^ other) <= BITS)
    return good


def _split(marks: pa.Array, config: Copies) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of minima, parts of keys, and parities, a row for each set."""
    equal, keys = config.keys * config.rows, 4 * config.keys
    flat = np.frombuffer(b"".join(marks.to_pylist()), np.uint8).reshape(len(marks), equal + keys + (1 << PLACES) // 8)
    return flat[:, :equal], np.ascontiguousarray(flat[:, equal : equal + keys]).view(np.uint32), np.ascontiguousarray(flat[:, equal + keys :]).view(np.uint64)


@dataclass(frozen=True)
class Members:
    """Members of a key, sorted by side: their numbers, sizes, fingerprints, groups, sides and marks."""

    node: np.ndarray
    n: np.ndarray
    fp: np.ndarray
    group: np.ndarray
    side: np.ndarray
    equal: np.ndarray
    keys: np.ndarray
    odd: np.ndarray

    def likely(self, i: int, others: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of some others may be like member i, and how many minima they share."""
        at = others[_near(self.n[i], self.n[others], self.fp[i], self.fp[others])]
        apart = np.bitwise_count(self.odd[at] ^ self.odd[i]).sum(axis=1, dtype=np.int64)
        at = at[apart * (OF + NEAR) <= (OF - NEAR) * (self.n[at] + self.n[i])]
        shared = (self.equal[at] == self.equal[i]).sum(axis=1)
        return at[shared >= least], shared[shared >= least]


def _lists(batch: pa.RecordBatch, at: int, config: Copies) -> Iterator[Members]:
    """The members of each row."""
    lists = batch.column(at)
    offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    flat = lists.flatten()
    side, group, node, n, fp = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
    equal, keys, odd = _split(flat.field(5), config)
    for low, high in zip(offsets, offsets[1:]):
        yield Members(*(x[low:high] for x in (node, n, fp.view(np.uint64), group, side, equal, keys, odd)))


def _nearest(config: Copies):
    """For each row (head, members) the pairs (u, v) of each member and the likeliest before it, and of the first and the head."""
    least = least_equal(config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for head, m in zip(batch.column(0).to_pylist(), _lists(batch, 1, config)):
                if head not in m.node:
                    u.append(head)
                    v.append(int(m.node[0]))
                for i in range(1, len(m.node)):
                    at, shared = m.likely(i, np.arange(i), least)
                    if len(at):
                        u.append(int(m.node[at[shared.argmax()]]))
                        v.append(int(m.node[i]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v)], names=["u", "v"])

    return run


def _across(config: Copies):
    """For each row (key, inner, members) the pairs (u, v) from different groups that may be alike and share no earlier key.

    Members of side 0 meet those of side 1, or, in an inner row, one another.
    """
    least = least_equal(config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = (batch.column(0).to_numpy().view(np.uint64) >> np.uint64(32)).astype(np.uint32)
            u: list[np.ndarray] = []
            v: list[np.ndarray] = []
            for here, inner, m in zip(places, batch.column(1).to_pylist(), _lists(batch, 2, config)):
                first, n = int(np.searchsorted(m.side, 1)), len(m.node)
                for i in range(n if inner else first):
                    others = np.arange(i + 1 if inner else first, n)
                    at, _ = m.likely(i, others[m.group[others] != m.group[i]], least)
                    at = at[m.keys[i][(m.keys[at] == m.keys[i]).argmax(axis=1)] == here]
                    if len(at):
                        u.append(np.minimum(m.node[at], m.node[i]))
                        v.append(np.maximum(m.node[at], m.node[i]))
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (u, v)], names=["u", "v"])

    return run


def _verified(pairs: DataFrame, held: DataFrame, words: int) -> DataFrame:
    """The pairs whose texts have the similarity; ``held`` has the text of each node."""
    left = held.select(F.col("node").alias("u"), F.col("text").alias("a"))
    right = held.select(F.col("node").alias("v"), F.col("text").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, last, first = [], None, None
            for x, y in zip(batch.column(2), batch.column(3)):
                if x != last:
                    last, first = x, shingles(x.as_py(), words)
                good.append(alike(first, shingles(y.as_py(), words)))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(right, "v").join(left, "u").select("u", "v", "a", "b")
    return cut(joined.mapInArrow(run, "u long, v long"))


def edited_copies(docs: DataFrame, config: Copies = Copies(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, component_id) per row; the component is its smallest key."""
    placed = classes(docs, config, text, key)
    least = placed.groupBy("part").agg(F.min("k").alias("component_id"))
    return placed.join(least, "part").select(F.col("k").alias(key), "component_id")


def first_rows(docs: DataFrame, config: Copies = Copies(), text: str = "text", key: str = "doc_id", linked: DataFrame | None = None) -> DataFrame:
    """(key, own) of the first row of each class: the least key, a null one last, then the least ``own``, the text's hash (null: 42).

    ``linked`` has (own, linked), classes of texts by another measure: what either links is one class.
    """
    row = F.struct(F.col("k").isNull().alias("unnamed"), "k", "own")
    placed = classes(docs, config, text, key)
    if linked is not None:
        # Of each class by the other measure, its parts and the least of them: an edge only where it has several.
        met = cut(placed.select("own", "part").distinct().join(linked, "own").select("linked", "part").distinct())
        several = met.groupBy("linked").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most")
        found = components(met.join(several, "linked").select(F.col("part").alias("u"), F.col("least").alias("v")))
        placed = placed.join(found, F.col("part") == F.col("node"), "left").select("k", "own", F.coalesce("component", "part").alias("part"))
    first = placed.groupBy("part").agg(F.min(row).alias("row"))
    return first.select(F.col("row.k").alias(key), F.col("row.own").alias("own"))


def classes(docs: DataFrame, config: Copies = Copies(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """(k, own, n, part) per row: its key, the 64-bit hash of its text, the size of its set, and what names its class."""
    words, kind = config.words, docs.schema[key].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = config.orders(config.keys * config.rows)
        for batch in batches:
            same, sizes, keys = [], [], []
            for x in batch.column(2):
                found = shingles(x.as_py(), words)
                same.append(xxhash.xxh64_intdigest(found.tobytes()))
                sizes.append(len(found))
                keys.append(min_keys(config.least(found, factors), config) if len(found) else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)]).astype(np.int32), np.concatenate([np.zeros(0, np.int64), *keys]))
            told = pa.array(np.array(same, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), told, pa.array(sizes, pa.int64()), lists], names=["k", "own", "same", "n", "keys"])

    def marked_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = config.orders(config.keys * config.rows)
        for batch in batches:
            sizes, fps, told_marks = [], [], []
            # One set at a time: texts may be long.
            for x in batch.column(1):
                found = shingles(x.as_py(), words)
                sizes.append(len(found))
                fps.append(majority(found) if config.chains else 0)
                told_marks.append(marks_of(found, factors, config))
            told = [pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(told_marks, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *told], names=["node", "n", "fp", "marks"])

    named_text = F.xxhash64(F.col(text))
    rows = docs.select(F.col(key).alias("k"), named_text.alias("own"), F.col(text).alias("t"))
    marked = stored(rows.mapInArrow(sets, f"k {kind}, own long, same long, n long, keys array<long>"), "copies")
    named = cut(marked.groupBy("same").agg(F.min("own").alias("node"), F.first("keys").alias("keys")))
    filed = named.select("node", F.posexplode("keys").alias("pos", "key"))
    # Keys with the same members, told by two sums of hashes, are one: the first, so that the first key that two sets share stays.
    told = F.xxhash64("node")
    members = filed.groupBy("key", "pos").agg(F.count("*").alias("n"), F.bit_xor(told).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("s"))
    crowded = members.where("n > 1").groupBy("n", "x", "s").agg(F.min_by("key", "pos").alias("key")).select("key")
    shared = cut(filed.select("node", "key").join(crowded, "key", "left_semi"))
    nodes = shared.select("node").distinct()
    texts = docs.select(named_text.alias("node"), F.col(text).alias("text"))
    held = stored(texts.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "copies")
    marks = stored(held.mapInArrow(marked_sets, "node long, n long, fp long, marks binary"), "copies")
    release(docs.sparkSession)

    size, spark = config.block, docs.sparkSession
    # First pairs: a block of a key in a row, with the key's head.
    counted = shared.groupBy("key").agg(F.count("*").alias("members"), F.min_by("node", F.xxhash64("node")).alias("head"))
    blocked = shared.join(counted, "key").withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), F.ceil(F.col("members") / F.lit(size))))
    member = F.struct(F.lit(0).alias("side"), F.lit(0).cast("long").alias("group"), "node", "n", "fp", "marks")
    listed = blocked.join(marks, "node").groupBy("key", "own", "head").agg(F.sort_array(F.collect_list(member)).alias("members"))
    near = listed.select("head", "members").mapInArrow(_nearest(config), "u long, v long")
    tried = cut(near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    links = _verified(tried, held, words)
    groups = cut(components(links))
    release(spark)

    # Then what is still apart: members of other groups than the head's meet all.
    grouped = shared.join(groups.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    grouped = cut(grouped.select("key", "node", F.coalesce("component", "node").alias("group")))
    heads = grouped.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.min_by("group", F.xxhash64("node")).alias("main")).where("low <> high")
    apart = grouped.join(heads.select("key", "main"), "key").withColumn("side", (F.col("group") == F.col("main")).cast("int"))
    sides = apart.groupBy("key").agg(*[F.ceil(F.count_if(F.col("side") == k) / F.lit(size)).cast("int").alias(f"blocks_{k}") for k in (0, 1)])
    found = _meetings(apart.join(sides, "key").join(marks, "node"), config)
    more = cut(found.join(tried, ["u", "v"], "left_anti"))
    if not more.isEmpty():
        # The groups as stars: what the first links joined isn't joined again.
        stars = groups.select(F.col("node").alias("u"), F.col("component").alias("v"))
        groups = cut(components(stars.union(_verified(more, held, words))))
        release(spark)

    joined = groups.withColumnRenamed("node", "member")
    parts = named.select("same", "node").join(joined, F.col("node") == F.col("member"), "left").select("same", F.coalesce("component", "node").alias("part"))
    return cut(marked.select("k", "own", "n", "same").join(parts, "same").select("k", "own", "n", "part"))


def _meetings(members: DataFrame, config: Copies) -> DataFrame:
    """Candidates between those outside the head's group (side 0) and all others of a key, a block of either side in a row."""
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.greatest(F.when(F.col("side") == 0, F.col("blocks_0")).otherwise(F.col("blocks_1")), F.lit(1))).cast("int")
    placed = members.withColumn("own", own)
    up_to = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    row = lambda kind, low, high: F.struct(F.lit(kind).alias("kind"), low.alias("low"), high.alias("high"))
    among = F.transform(up_to("blocks_0"), lambda b: row(0, F.least("own", b), F.greatest("own", b)))
    outward = F.transform(up_to("blocks_1"), lambda b: row(1, F.col("own"), b))
    inward = F.transform(up_to("blocks_0"), lambda b: row(1, b, F.col("own")))
    met = placed.withColumn("row", F.explode(F.when(F.col("side") == 0, F.concat(among, outward)).otherwise(inward)))
    # In a row of two blocks of the outsiders, the later block is the other side.
    side = F.when(F.col("row.kind") == 1, F.col("side")).when(F.col("own") == F.col("row.low"), 0).otherwise(1)
    member = F.struct(side.alias("side"), "group", "node", "n", "fp", "marks")
    lists = met.groupBy("key", "row").agg(F.sort_array(F.collect_list(member)).alias("members")).where(F.size("members") > 1)
    inner = (F.col("row.kind") == 0) & (F.col("row.low") == F.col("row.high"))
    return lists.select("key", inner.alias("inner"), "members").mapInArrow(_across(config), "u long, v long").distinct()
