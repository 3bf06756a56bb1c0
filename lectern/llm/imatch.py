"""Document fingerprints: I-Match over several randomised lexicon subsets.

The lexicon holds the terms whose document frequency lies in a band: not the
words that all texts share, nor those that hardly any other text has. At most
(mean distinct terms per document) / ``rare`` terms can be in it, however large
the corpus, so its bitmap of hashed terms has a size of its own. A fingerprint
hashes the sorted distinct lexicon terms of a text, once all of them and once
for each random subset of the lexicon; equal components mean equal terms there.
Small subsets still agree when much of a text has changed, so the share of
equal components tells how alike two texts are.

Cases: a null text is an empty one; a text without lexicon terms is told by all
its terms, one without terms has the fingerprint of blanks; equal texts have
equal fingerprints; repeated rows and keys are fingerprinted alike and follow
one another in order of text; keys are integers, null ones come last in
descending order, by a hash of their text among themselves; an empty table gives
an empty result; extra columns are dropped.

On invented prose, 10,000 documents: a likeness of 0.05 or more finds 95 % of
the texts of which the second half was replaced, and 0.8 % of unrelated pairs;
0.1 or more 88 % and 0.04 %.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.storage import let

NONE = "--------"


@dataclass(frozen=True)
class IMatch:
    """rare, common: least and greatest share of documents that have a lexicon term.

    bits: the bitmap's size as a power of two. subsets: (share, number) of random
    subsets of the lexicon with one in so many of its terms, a power of two.
    Small subsets still agree in texts of which half is new. block_bytes: of
    texts, about, that find their successors in one task.
    """

    rare: float = 0.002
    common: float = 0.05
    bits: int = 21
    subsets: tuple[tuple[int, int], ...] = ((2, 1), (8, 2), (64, 16), (256, 48))
    block_bytes: int = 48_000_000


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-case words of letters and digits, sorted."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    return F.sort_array(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, config: IMatch, text: str = "text") -> list[int]:
    """The bitmap of the lexicon, 64 bits to a number, from counts over all documents."""
    whole = F.coalesce(F.col(text), F.lit(""))
    total = docs.count()
    counted = docs.select(F.explode(terms(whole)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = counted.where((F.col("df") >= max(2.0, config.rare * total)) & (F.col("df") <= max(2.0, config.common * total)))
    place = F.col("term").bitwiseAND(F.lit((1 << config.bits) - 1))
    words = band.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("flags")
    )
    bitmap = [0] * (1 << (config.bits - 6))
    # As many rows as the bitmap has words at most.
    for row in words.toLocalIterator():
        bitmap[row["word"]] = row["flags"]
    return bitmap


def _drawn(shift: int, mask: int, wanted: int, exactly: bool = False):
    """Whether a term, by its hash, belongs to the random subset of that number, or to one of a lower number."""

    def belongs(h: Column) -> Column:
        number = F.shiftright(h, shift).bitwiseAND(F.lit(mask))
        return number == wanted if exactly else number < wanted

    return belongs


def _each(tests: list, component):
    """What a component is of each of some subsets of terms."""
    return lambda some: F.array(*[component(F.filter(some, test)) for test in tests])


def fingerprint(text: Column, bitmap: list[int], config: IMatch) -> Column:
    """Components of eight hex digits, joined by dots: the whole lexicon, then its subsets."""
    flags = F.split(F.lit(",".join(map(str, bitmap))), ",").cast("array<bigint>")

    def known(h: Column) -> Column:
        place = h.bitwiseAND(F.lit((1 << config.bits) - 1)).cast("int")
        word = F.get(flags, F.shiftright(place, 6))
        return F.call_function("shiftright", word, place.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1

    def component(chosen: Column) -> Column:
        return F.when(F.size(chosen) == 0, F.lit(NONE)).otherwise(F.substring(F.lpad(F.hex(F.xxhash64(chosen)), 16, "0"), 9, 8))

    def parts(used: Column) -> Column:
        out = [F.array(component(used))]
        # Each size of subset reads a stretch of the terms' hashes of its own, above the bitmap's places;
        # terms in none of its subsets are left out once.
        shift = 63
        for share, number in config.subsets:
            shift -= share.bit_length() - 1
            some = F.filter(used, _drawn(shift, share - 1, number))
            tests = [_drawn(shift, share - 1, k, True) for k in range(number)]
            out.append(let(some, _each(tests, component)))
        return F.lower(F.array_join(F.concat(*out), "."))

    def chosen(all_terms: Column) -> Column:
        inside = F.filter(all_terms, known)
        return let(inside, lambda x: let(F.when(F.size(x) > 0, x).otherwise(all_terms), parts))

    return let(terms(text), chosen)


def likeness(a: Column, b: Column) -> Column:
    """Equal components among those that either fingerprint has; equal fingerprints are 1."""
    pairs = F.arrays_zip(F.split(a, r"\.").alias("a"), F.split(b, r"\.").alias("b"))
    same = lambda x: F.size(F.filter(x, lambda p: (p["a"] == p["b"]) & (p["a"] != NONE)))
    some = lambda x: F.size(F.filter(x, lambda p: (p["a"] != NONE) | (p["b"] != NONE)))
    share = let(pairs, lambda x: same(x) / F.greatest(some(x), F.lit(1)))
    return F.when(a == b, F.lit(1.0)).otherwise(share.cast("double"))


def fingerprints(docs: DataFrame, config: IMatch = IMatch(), text: str = "text") -> DataFrame:
    """``docs`` with the column fingerprint."""
    bitmap = lexicon(docs, config, text)
    return docs.withColumn("fingerprint", fingerprint(F.coalesce(F.col(text), F.lit("")), bitmap, config))


#: Ranges of keys of about as many rows, and most blocks in one: as many places as the driver holds edges of.
RANGES, BLOCKS = 256, 1024


def _blocks(docs: DataFrame, key: str, n: int) -> Column:
    """A number per row that rises with its key: about ``n`` blocks, null keys dealt over some below all others."""
    each = max(1, min(BLOCKS, -(-n // RANGES)))
    at = [i / RANGES for i in range(RANGES + 1)] if n > 1 else [0.0, 1.0]
    found = docs.select(F.percentile_approx(key, at, 10_000)).first()[0] or [0]
    edges = sorted(set(found))
    listed = F.split(F.lit(",".join(map(str, edges))), ",").cast("array<bigint>")
    # The range whose lower edge is the last one not above the key, and the key's place in it.
    place = F.greatest(F.size(F.filter(listed, lambda e: e <= F.col(key))) - 1, F.lit(0))
    low = F.get(listed, place)
    width = F.greatest(F.coalesce(F.get(listed, place + 1), low + 1) - low, F.lit(1))
    inner = F.least(F.call_function("div", F.greatest(F.col(key) - low, F.lit(0)) * each, width), F.lit(each - 1))
    nulls = F.pmod(F.col("tie"), F.lit(each)) - each
    return F.when(F.col(key).isNull(), nulls).otherwise(place.cast("long") * each + inner)


def with_next(docs: DataFrame, key: str, derive, size: int = 0, block_bytes: int = 48_000_000) -> DataFrame:
    """``derive(docs)`` with next_ columns: what the row of the next smaller key has; after the last, the first.

    Rows go once to blocks of neighbouring keys, so many that a block has about
    ``block_bytes`` of the table's ``size``; every block also gets the rows
    that the block below begins with, so its last row finds its successor there.
    """
    spark = docs.sparkSession
    given = [c for c in docs.columns if c != key]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // block_bytes))
    tied = docs.withColumn("tie", F.xxhash64(*given))
    # Several blocks to a partition, so that hashing deals them out evenly.
    keyed = tied.withColumn("block", _blocks(docs, key, 8 * parts))
    # One row per block: RANGES times BLOCKS at most.
    tops = keyed.groupBy("block").agg(F.max(key).alias("top"), F.max(F.when(F.col(key).isNull(), F.col("tie"))).alias("top_tie"))
    firsts = sorted((tuple(r) for r in tops.collect()), reverse=True, key=lambda r: r[0])
    hosts = [(block, top, tie, firsts[i - 1][0]) for i, (block, top, tie) in enumerate(firsts)]
    kind = docs.schema[key].dataType.simpleString()
    guests = F.broadcast(spark.createDataFrame(hosts, f"g_block long, g_top {kind}, g_tie long, host long"))
    begins = (F.col("block") == F.col("g_block")) & F.col(key).eqNullSafe(F.col("g_top"))
    begins = begins & (F.col(key).isNotNull() | (F.col("tie") == F.col("g_tie")))
    visiting = keyed.join(guests, begins).select(key, *given, "tie", F.col("host").alias("block"), F.lit(True).alias("guest"))
    rows = derive(keyed.withColumn("guest", F.lit(False)).unionByName(visiting).repartition(parts, "block"))
    columns = [c for c in rows.columns if c not in (key, "block", "guest", "tie")]
    # Among null keys, the hash comes first, by which they were dealt.
    by_hash = F.when(F.col(key).isNull(), F.col("tie")).desc()
    order = Window.partitionBy("block").orderBy("guest", F.col(key).desc_nulls_last(), by_hash, *columns)
    followed = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return followed.where("not guest").drop("guest", "block", "tie")


def compare(docs: DataFrame, config: IMatch = IMatch(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints of all texts and of edited ones, and how alike they are.

    In the edited text the last half of the code points, rounded down, is
    replaced by as many (or all) of the next document's first.
    """
    bitmap = lexicon(docs, config, text)
    clean = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = clean.agg(F.sum(F.length("t"))).first()[0] or 0
    pairs = with_next(clean, key, lambda rows: rows.withColumn("fp", fingerprint(F.col("t"), bitmap, config)), size, config.block_bytes)
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    edited = pairs.select(
        key,
        n.cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("t"), F.lit(1), n - half), F.substring(F.col("next_t"), F.lit(1), half)).alias("edited"),
        F.col("fp").alias("fingerprint"),
        "next_fp",
    )
    done = edited.select(
        key,
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        fingerprint(F.col("edited"), bitmap, config).alias("edited_fingerprint"),
        "next_fp",
    )
    return done.select(
        key,
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"),
    )
