"""Near-duplicates by circulant MinHash.

A set's signature needs two permutations of all 64-bit numbers, not one for each
coordinate: the first scatters the shingles, the second is shifted by one place
from coordinate to coordinate, so coordinate i is the least pi(sigma(x) - i) of
the set's shingles x, with differences around the ring of 2^64 places. Both are
invertible mixers. Coordinates are banded into keys, ``rows`` to each; sets that
share a key are candidates, sizes, equal coordinates and parities of hashed
places prune them, and the two whole sets decide.

Candidates are met as in ``copies``: equal sets are one node; every member of a
key first meets the likeliest one before it in its block; those that are still
apart from their key's largest group meet all others, block by block. So a group
of any size is joined by a few comparisons for each member, and every two sets in
different components that share a key have been compared. Two sets at 0.8 share
none of 30 keys with a probability of one in seven million.

Cases: a text of fewer words than a shingle has is one shingle; null and blank
texts have none, and each is a component of its own; a null key counts as a row
but names a component only if no other row of it has a key; repeated rows share
their set; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.copies import HASHED, Copies, classes


def _mixed(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of the 64-bit numbers: odd multipliers and shifted differences can both be undone."""
    x = x * np.uint64(first)
    x ^= x >> np.uint64(32)
    x *= np.uint64(second)
    x ^= x >> np.uint64(29)
    return x


def scattered(x: np.ndarray) -> np.ndarray:
    """The first permutation."""
    return _mixed(x, 0xA24BAED4963EE407, 0x9FB21C651E98DF25)


def permuted(x: np.ndarray) -> np.ndarray:
    """The second, of which each coordinate takes a shift."""
    return _mixed(x, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def shifts(n: int) -> np.ndarray:
    """The places by which the second permutation is shifted."""
    return np.arange(n, dtype=np.uint64)[:, None]


def signature(found: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The coordinates of a set of hashed shingles."""
    least, here = np.full(len(by), np.iinfo(np.uint64).max, np.uint64), scattered(found)
    for at in range(0, len(here), HASHED):
        np.minimum(least, permuted(here[None, at : at + HASHED] - by).min(axis=1), out=least)
    return least


#: Two-word shingles, 30 keys of four coordinates.
CIRCULANT = Copies(words=2, keys=30, rows=4, orders=shifts, least=signature, chains=False)


def near_duplicates(docs: DataFrame, config: Copies = CIRCULANT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, kept) per row; the component is its smallest key, whose row is kept."""
    placed = classes(docs, config, text, key)
    least = placed.where("n > 0").groupBy("part").agg(F.min("k").alias("least"))
    named = placed.join(least, "part", "left").withColumn("component", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("k")))
    return named.select(
        F.col("k").alias(key),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("k").eqNullSafe(F.col("component")).alias("kept"),
    )
