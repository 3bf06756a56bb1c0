"""Questions that ask nearly the same, as a self-join within their group.

Two questions are alike if their sets of words have a Jaccard of 0.82 or more, or if
the ratio of matching blocks of their letters (twice the matched ones to all) is
0.88 or more. Neither arm looks at all pairs of a group:

* words: with a share of t, two sets of n words share one of the n - ceil(t n) + 1
  rarest words of either, so those are the keys of an equi-join. For a small share
  these are nearly all words, and nearly all pairs would meet, once a word: there
  blocks of sets meet, each two of them once. A block is one row that is written once;
  tasks read two files of blocks each, so no set is shuffled for the blocks that it
  meets. Within two blocks the places that their words are dealt to bound what two sets
  share, and the words of those that can reach the share decide, so only alike sets
  become rows;
* letters: of m matched letters in b blocks, m - b pairs of neighbours are shared,
  and each block but one costs an unmatched letter, so b <= all - 2 m + 1. At a
  ratio r of m this leaves at least (3 r / 2 - 1) all - 1 shared pairs of
  neighbours: enough that some lies among the rarest of either text. Lengths, the
  letters both have, and the longest common subsequence (a row of bits at a time)
  bound the ratio from above; what is left is matched block by block.

Of alike questions the first stays: one is dropped if one before it stays that it is
like. This is settled in rounds, each of which decides all whose predecessors are
decided, the first of a group at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import words as W
from lectern.operators.study import SAME_TEXT, SAME_WORDS, SIMILAR_STOPWORDS
from lectern.storage import release, stored


#: Share of words below which blocks of sets meet; sets in a block; places for each word of an average set, and how many there are at least and most.
FEW, BLOCK, SPARE, PLACES = 0.5, 2048, 8, (256, 8192)

#: Words for each set of a block, beyond which a group has more blocks; blocks in a file; words looked up at a time.
WORDS, BLOCKS_IN_FILE, AT_ONCE = 256, 8, 1 << 20


def question_words(text: Column) -> Column:
    """Distinct words of two letters or more, without stop words."""
    stop = F.array(*[F.lit(w) for w in SIMILAR_STOPWORDS])
    return F.filter(F.array_except(W.word_set(text), stop), lambda w: F.length(w) > 1)


def _rarest(items: DataFrame, least: Column) -> DataFrame:
    """(group, id, key): of each row's keys the rarest in its group, so many that two rows which share ``least`` of theirs share one."""
    spread = items.select("group", "id", F.size("keys").alias("n"), F.explode("keys").alias("key"))
    common = spread.groupBy("group", "key").agg(F.count("*").alias("df"))
    ordered = spread.join(common, ["group", "key"]).groupBy("group", "id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("s"))
    size = (F.col("n") - F.greatest(least, F.lit(1)) + 1).cast("int")
    return ordered.select("group", "id", F.explode(F.slice("s", F.lit(1), F.greatest(size, F.lit(0)))).alias("x")).select("group", "id", F.col("x.key").alias("key"))


def _met(keys: DataFrame) -> DataFrame:
    a, b = (keys.select("group", "key", F.col("id").alias(name)) for name in ("first", "second"))
    return a.join(b, ["group", "key"]).where("first < second").select("group", "first", "second").distinct()


def _blocks(sets: DataFrame, block: int) -> DataFrame:
    """(group, block, blocks, sets): every set (group, id, keys) once, those of a block as one row in Arrow's stream format."""
    spark = sets.sparkSession
    named = sets.where("group IS NOT NULL AND id IS NOT NULL")
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(block), F.sum(F.size("keys")) / F.lit(block * WORDS))).cast("int")
    # Each of these has more sets or more words than a block, so they are few.
    large = stored(named.groupBy("group").agg(blocks.alias("blocks")).where("blocks > 1"), "large")
    # What was shuffled for the sets is not needed beside what is shuffled for the blocks.
    release(spark)
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks").cast("long")).cast("int")
    dealt = named.join(F.broadcast(large), "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", own)
    files = (large.agg(F.sum("blocks").alias("n")).first()["n"] or 0) // BLOCKS_IN_FILE
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), files)
    stream = dealt.select("group", "block", "blocks", "id", "keys").repartition(parts, "group", "block").sortWithinPartitions("group", "block")

    def row(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, keys = (pa.concat_arrays([b.column(i) for b in held]) for i in (3, 4))
        coded = pa.ListArray.from_arrays(np.append(0, np.cumsum(keys.value_lengths().to_numpy())).astype(np.int32), keys.flatten().dictionary_encode())
        table = pa.table({"id": ids, "keys": coded})
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table)
        first = held[0].slice(0, 1)
        return pa.RecordBatch.from_arrays([*first.columns[:3], pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["group", "block", "blocks", "sets"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for low, high in zip(cuts, cuts[1:]):
                if low < high:
                    if keys[low] != here and held:
                        yield row(held)
                        held = []
                    here = keys[low]
                    held.append(batch.slice(low, high - low))
        if held:
            yield row(held)

    return stored(stream.mapInArrow(packed, f"group {sets.schema['group'].dataType.simpleString()}, block int, blocks int, sets binary"), "blocks")


def _shares_in_blocks(sets: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(group, first, second, jaccard) of the sets (group, id, keys) that share ``least`` of their keys."""
    blocks = _blocks(sets, block)
    types = {n: sets.schema[n].dataType.simpleString() for n in ("group", "id")}

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pair = [pa.ipc.open_stream(c[i].as_buffer()).read_all().combine_chunks() for c in batch.columns[1:]]
                for a, b, jaccard in _shares(pair[0], pair[-1], least, len(pair) == 1):
                    group = batch.column(0).take(pa.array(np.full(len(a), i)))
                    yield pa.RecordBatch.from_arrays([group, a, b, pa.array(jaccard)], names=["group", "a", "b", "jaccard"])

    split = blocks.where("blocks > 1")
    later = split.select(F.col("group").alias("later_group"), F.col("block").alias("later"), F.col("sets").alias("other"))
    # Pairs of files are tasks that read them where they lie; an equi-join would bring a group's blocks into one task, or copy them.
    two = split.hint("shuffle_replicate_nl").join(later, (F.col("group") == F.col("later_group")) & (F.col("block") < F.col("later")))
    shape = f"group {types['group']}, a {types['id']}, b {types['id']}, jaccard double"
    found = blocks.select("group", "sets").mapInArrow(compared, shape).union(two.select("group", "sets", "other").mapInArrow(compared, shape))
    return found.where("a != b").select("group", F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second"), "jaccard")


def _met_in_blocks(sets: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(group, first, second) of the sets (group, id, keys) that share ``least`` of their keys."""
    return _shares_in_blocks(sets, least, block).select("group", "first", "second")


def _shares(one: pa.Table, other: pa.Table, least: float, inner: bool, at_once: int = 256) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Ids and shares of the pairs across two blocks (id, keys), or within one, that have the share."""
    keys = [t["keys"].combine_chunks() for t in (one, other)]
    n, m = (k.value_lengths().to_numpy().astype(np.int64) for k in keys)
    words = [k.flatten() for k in keys]
    # Numbers of the words that hold for both.
    named = pa.concat_arrays([w.dictionary for w in words]).dictionary_encode()
    codes = [c[w.indices.to_numpy()] for c, w in zip(np.split(named.indices.to_numpy(), [len(words[0].dictionary)]), words)]
    meetings = np.prod([np.bincount(c, minlength=len(named.dictionary)) for c in codes], axis=0)
    # Words that only one set has are shared by none; the others are ranked, those that meet most often first.
    shared = int(np.count_nonzero(meetings > inner))
    rank = np.empty(len(meetings), np.int64)
    rank[np.argsort(-meetings, kind="stable")] = np.arange(len(meetings))
    mean = max((n.sum() + m.sum()) / (len(n) + len(m)), 1)
    width = min(max(1 << int(np.ceil(np.log2(SPARE * mean))), PLACES[0]), PLACES[1])
    # The first words have a place each, the others share the rest.
    alone = width // 4
    (rows, ranks, places), (later_rows, later_ranks, later_places) = (
        (r[k < shared], k[k < shared], np.where(k < alone, k, alone + k % (width - alone))[k < shared])
        for r, k in ((np.repeat(np.arange(len(sizes)), sizes), rank[c]) for c, sizes in zip(codes, (n, m)))
    )
    # One set's words at each place, where the other has any: as many as they share, or more. From that goes what they must share.
    must = least / (1 + least)
    bounds = np.zeros((len(n), width + 2), np.float32)
    bounds[:, :width] = np.bincount(rows * width + places, minlength=len(n) * width).reshape(-1, width)
    bounds[:, width], bounds[:, width + 1] = -must * n, 1
    later_bounds = np.zeros((len(m), width + 2), np.float32)
    later_bounds[later_rows, later_places] = 1
    later_bounds[:, width], later_bounds[:, width + 1] = 1, -must * m
    slack = 1e-3 + 1e-5 * float(n.max() + m.max())
    begins = np.searchsorted(rows, np.arange(len(n) + 1))
    there = np.append(np.sort(later_rows * shared + later_ranks), -1)
    ids = [t["id"].combine_chunks() for t in (one, other)]
    for at in range(0, len(n), at_once):
        start = at if inner else 0
        a, b = np.divmod(np.flatnonzero((bounds[at : at + at_once] @ later_bounds[start:].T).ravel() >= -slack), len(m) - start)
        a, b = a + at, b + start
        if inner:
            a, b = a[a < b], b[a < b]
        # The words of these pairs are looked up, as many pairs at a time as have so many words.
        size = begins[a + 1] - begins[a]
        total = np.cumsum(size)
        for part in np.split(np.arange(len(a)), np.searchsorted(total, np.arange(AT_ONCE, total[-1] if len(a) else 0, AT_ONCE))):
            if len(part):
                x, y, many = a[part], b[part], size[part]
                pair = np.repeat(np.arange(len(part)), many)
                word = np.arange(len(pair)) + np.repeat(begins[x] - (np.cumsum(many) - many), many)
                has = later_bounds[y[pair], places[word]] > 0
                unsure = np.flatnonzero(has & (ranks[word] >= alone))
                asked = y[pair[unsure]] * shared + ranks[word[unsure]]
                has[unsure] = there[np.searchsorted(there[:-1], asked)] == asked
                both = np.bincount(pair, weights=has, minlength=len(part))
                jaccard = both / (n[x] + m[y] - both)
                found = jaccard >= least
                if found.any():
                    yield ids[0].take(pa.array(x[found])), ids[1].take(pa.array(y[found])), jaccard[found]


def _with_both(pairs: DataFrame, items: DataFrame, column: str) -> DataFrame:
    one, other = (items.select("group", F.col("id").alias(name), F.col(column).alias(f"{name}_{column}")) for name in ("first", "second"))
    return pairs.join(one, ["group", "first"]).join(other, ["group", "second"])


def word_pairs(items: DataFrame, least: float = SAME_WORDS) -> DataFrame:
    """(group, first, second, jaccard) for rows (group, id, text) whose words are nearly the same."""
    sets = items.select("group", "id", question_words(F.col("text")).alias("keys")).where(F.size("keys") > 0)
    if least < FEW:
        return _shares_in_blocks(stored(sets, "words"), least)
    both = _with_both(_met(_rarest(sets, F.ceil(F.col("n") * F.lit(least) - 1e-9))), sets, "keys")
    jaccard = F.size(F.array_intersect("first_keys", "second_keys")) / F.size(F.array_union("first_keys", "second_keys"))
    return both.select("group", "first", "second", jaccard.alias("jaccard")).where(F.col("jaccard") >= least)


def longest_common(a: str, b: str) -> int:
    """Letters of the longest common subsequence, a row of bits at a time."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        here = row & masks.get(c, 0)
        row = (row + here | row - here) & full
    return len(a) - row.bit_count()


def alike_letters(a: str, b: str, least: float = SAME_TEXT) -> bool:
    """Whether the ratio of matching blocks reaches ``least``; bounds first."""
    total = len(a) + len(b)
    if 2 * min(len(a), len(b)) < least * total or 2 * (Counter(a) & Counter(b)).total() < least * total:
        return False
    return 2 * longest_common(a, b) >= least * total and SequenceMatcher(None, a, b).ratio() >= least


def letter_pairs(items: DataFrame, least: float = SAME_TEXT) -> DataFrame:
    """(group, first, second) for rows (group, id, text) whose letters nearly match; texts without words match none.

    Words have two letters, so two texts have four at least and share a pair of neighbours.
    """
    low = items.where(F.size(question_words(F.col("text"))) > 0).select("group", "id", F.lower("text").alias("low"))
    letters = F.split("low", "")
    neighbours = F.zip_with(F.slice(letters, 1, F.size(letters) - 1), F.slice(letters, 2, F.size(letters)), lambda a, b: F.concat(a, b))
    # A pair of letters that is there three times is three keys.
    counted = low.select("group", "id", "low", F.posexplode(F.array_sort(neighbours)).alias("at", "pair"))
    ranked = counted.groupBy("group", "id", "pair").agg(F.count("*").alias("c")).select("group", "id", F.explode(F.transform(F.sequence(F.lit(1), F.col("c")), lambda i: F.concat(F.col("pair"), i.cast("string")))).alias("key"))
    keyed = ranked.groupBy("group", "id").agg(F.collect_list("key").alias("keys"))
    # The other text is at least this share of a text's length.
    shortest = least / 2 / (1 - least / 2)
    need = F.ceil((F.col("n") + 1) * F.lit((1 + shortest) * (1.5 * least - 1)) - 1 - 1e-9)
    met = _with_both(_met(_rarest(keyed, need)), low, "low")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Matching is not symmetric: the later text is held against the earlier.
            good = [alike_letters(later, earlier, least) for earlier, later in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield batch.select([0, 1, 2]).filter(pa.array(good, pa.bool_()))

    fields = ", ".join(f"`{n}` {items.schema[c].dataType.simpleString()}" for n, c in (("group", "group"), ("first", "id"), ("second", "id")))
    size = F.length("first_low") + F.length("second_low")
    likely = met.where(2 * F.least(F.length("first_low"), F.length("second_low")) >= F.lit(least) * size)
    return likely.select("group", "first", "second", "first_low", "second_low").mapInArrow(run, fields)


def alike(items: DataFrame) -> DataFrame:
    """(group, first, second): all pairs of a group that ask nearly the same, by either arm."""
    return word_pairs(items).select("group", "first", "second").union(letter_pairs(items)).distinct()


def firsts(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The nodes (group, id) that stay: none that stays before them is their like."""
    edges = stored(pairs.select("group", "first", "second"), "alike")
    state = stored(edges.select("group", F.col("second").alias("id")).distinct().withColumn("stays", F.lit(None).cast("boolean")), "state")
    while not state.where("stays IS NULL").isEmpty():
        told = state.select("group", F.col("id").alias("first"), F.col("stays").alias("before"))
        # Who is first of no pair's second stays from the beginning.
        seen = edges.join(told.withColumn("known", F.lit(True)), ["group", "first"], "left")
        before = F.when(F.col("known").isNull(), F.lit(True)).otherwise(F.col("before"))
        judged = seen.groupBy("group", F.col("second").alias("id")).agg(
            F.bool_or(F.coalesce(before, F.lit(False))).alias("like"), F.bool_or(before.isNull()).alias("open")
        )
        stays = F.when(F.col("like"), F.lit(False)).when(~F.col("open"), F.lit(True))
        state = stored(judged.select("group", "id", stays.alias("stays")), "state")
    gone = state.where(~F.col("stays"))
    return nodes.join(gone, ["group", "id"], "left_anti")


def distinct_questions(questions: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """Per group the questions that are like none which stays before them, by ``order``; rows that share it are told apart by their text.

    Questions without words, and null ones, are like none and all stay, as do those of a null group.
    """
    worded = F.size(question_words(F.col(text))) > 0
    same = questions.where(worded).groupBy(F.col(group).alias("group"), F.col(text).alias("text")).agg(F.min(order).alias("at"))
    items = stored(same.select("group", F.struct("at", "text").alias("id"), "text"), "questions")
    kept = firsts(items.select("group", "id"), alike(items)).select(F.col("group").alias("__group"), F.col("id.at").alias("__at"), F.col("id.text").alias("__text"))
    same_row = F.col(group).eqNullSafe(F.col("__group")) & F.col(order).eqNullSafe(F.col("__at")) & (F.col(text) == F.col("__text"))
    staying = questions.where(worded).join(kept, same_row, "left_semi").dropDuplicates([group, order, text])
    return staying.unionByName(questions.where(~worded))
