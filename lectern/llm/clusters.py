"""Centroid clustering by sort-means.

Vectors become integers, so distances, sums and means are exact and every run
gives the same clusters. In each round the other centroids are sorted by their
distance from each centroid. A vector begins at the centroid it had before, at
distance d, and looks at the others in that centroid's order only as far as
their gap is not strictly beyond 2 d: whatever lies farther is farther from the
vector, too. Gaps and distances are compared as squares of integers.

The vectors lie in two tables of the shared folder that are written in turn, each
row beside its centroid; a round reads one, writes the other and sums it up. A
lost executor costs tasks of the round at most. What comes to the driver and is
sent to the tasks are sums and centroids: ``clusters`` times ``size`` numbers.

Cases: vectors that are null, of another length, or with a null or non-finite
component are left out; a null key counts as the text ``null`` in the choice of
the first centroids; rows that are there twice are two vectors; with fewer vectors
than clusters each is a centroid; vectors whose components leave 26 bits are worked
on in whole numbers of any size, and a distance or sum of distances beyond a long
is null; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.storage import fresh_path, stored

#: Components below this give squared distances, four times over, that fit into 63 bits.
NARROW = 1 << 26
#: Sums travel in digits of so many bits, so that long columns hold sums of any size.
DIGIT = 48
LONG = 1 << 63


@dataclass(frozen=True)
class SortMeans:
    """size: components of a vector. scale: factor before rounding down. seed: of the choice of first centroids."""

    clusters: int = 40
    rounds: int = 5
    size: int = 64
    scale: int = 256
    seed: str = "2"


def vectors(rows: DataFrame, config: SortMeans = SortMeans(), vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x, wide): whole numbers of the usable vectors; ``wide`` has those whose components need more than 26 bits, as they came."""
    real = F.col(vector).cast("array<double>")
    finite = F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.select(F.col(key).alias("key"), real.alias("e")).where((F.size(F.col(vector)) == config.size) & finite)
    small = F.forall("e", lambda x: F.abs(x * config.scale) < NARROW - 1)
    whole = F.transform("e", lambda x: F.floor(x * config.scale).cast("int"))
    return usable.select("key", F.when(small, whole).alias("x"), F.when(~small, F.col("e")).alias("wide"))


def ordered(centroids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each centroid the others by their distance from it, and these distances squared."""
    found = []
    for a in range(len(centroids)):
        gaps = ((centroids - centroids[a]) ** 2).sum(axis=1)
        others = np.argsort(gaps, kind="stable")
        others = others[others != a]
        found.append((others, gaps[others]))
    return found


def assign(x: np.ndarray, before: np.ndarray, centroids: np.ndarray, near: list) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector, the smaller number of equally near ones, its squared distance, and how many distances were taken."""
    best, least = before.copy(), ((x - centroids[before]) ** 2).sum(axis=1)
    own, taken = least.copy(), len(x)
    for a in np.unique(before):
        rows = np.flatnonzero(before == a)
        others, gaps = near[a]
        reach = np.searchsorted(gaps, 4 * own[rows], side="right")
        far = np.argsort(-reach, kind="stable")
        rows, reach = rows[far], reach[far]
        for step in range(int(reach[0])):
            at = rows[: np.searchsorted(-reach, -step, side="left")]
            other = others[step]
            distance = ((x[at] - centroids[other]) ** 2).sum(axis=1)
            closer = (distance < least[at]) | ((distance == least[at]) & (other < best[at]))
            best[at[closer]], least[at[closer]] = other, distance[closer]
            taken += len(at)
    return best, least, taken


def whole_numbers(x: pa.Array, wide: pa.Array, config: SortMeans) -> np.ndarray:
    """The vectors of a batch as a table of integers, of any size where a row needs it."""
    out = np.zeros((len(x), config.size), np.int64)
    here = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False))
    out[here] = x.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, config.size)
    if len(here) < len(x):
        out = out.astype(object)
        for i, row in enumerate(wide):
            if row.is_valid:
                # A power of two times a double is exact, and so is the fraction's floor.
                out[i] = [_floor(v, config.scale) for v in row.as_py()]
    return out


def _floor(value: float, scale: int) -> int:
    above, below = float(value).as_integer_ratio()
    return above * scale // below


def _assigned(centroids: list[list[int]], config: SortMeans, keep: bool):
    """Batches (key, x, wide, cluster) with the nearest centroid, and the squared distance in place of the vector if it isn't kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = all(abs(v) < NARROW for c in centroids for v in c)
        fixed = np.array(centroids, dtype=np.int64 if low else object).reshape(len(centroids), config.size)
        near = ordered(fixed)
        boundless = (fixed.astype(object), [(o, g.astype(object)) for o, g in near])
        for batch in batches:
            x = whole_numbers(batch.column(1), batch.column(2), config)
            if low and x.dtype != object:
                best, least, _ = assign(x, batch.column(3).to_numpy(), fixed, near)
            else:
                # Gaps of wide centroids are whole numbers of any size already.
                best, least, _ = assign(x.astype(object), batch.column(3).to_numpy(), *boundless)
            told = pa.array(best.astype(np.int32))
            if keep:
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], told], names=["key", "x", "wide", "cluster"])
            else:
                distance = pa.array([int(d) if d < LONG else None for d in least], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), told, distance], names=["key", "cluster", "distance"])

    return run


def _sums(config: SortMeans):
    """Rows (cluster, place, digit, total) of all batches of a task; place ``size`` counts the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}
        for batch in batches:
            x, cluster = whole_numbers(batch.column(0), batch.column(1), config), batch.column(2).to_numpy()
            for a in np.unique(cluster).tolist():
                mine = x[cluster == a]
                line = totals.setdefault(a, [0] * (config.size + 1))
                for i, v in enumerate([*mine.sum(axis=0).tolist(), len(mine)]):
                    line[i] += v
        rows = []
        for a, line in totals.items():
            for place, total in enumerate(line):
                digit = 0
                while not -LONG <= total < LONG:
                    rows.append((a, place, digit, total & ((1 << DIGIT) - 1)))
                    total, digit = total >> DIGIT, digit + 1
                rows.append((a, place, digit, total))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
        if rows:
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "place", "digit", "total"])

    return run


def _means(table: DataFrame, centroids: list[list[int]], config: SortMeans) -> list[list[int]]:
    """The centroids moved to the rounded-down means of their vectors; those without vectors stay."""
    parts = table.select("x", "wide", "cluster").mapInArrow(_sums(config), "cluster int, place int, digit int, total long")
    rows = parts.groupBy("cluster", "place", "digit").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    totals: dict[int, list[int]] = {}
    for r in rows:
        totals.setdefault(r["cluster"], [0] * (config.size + 1))[r["place"]] += int(r["total"]) << (DIGIT * r["digit"])
    return [[v // t[-1] for v in t[:-1]] if (t := totals.get(a)) else c for a, c in enumerate(centroids)]


def cluster(rows: DataFrame, config: SortMeans = SortMeans(), vector: str = "embedding", key: str = "vec_id") -> tuple[DataFrame, list[list[int]]]:
    """(key, cluster, distance) per usable vector, in a table of the shared folder, and the final centroids."""
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    usable = vectors(rows, config, vector, key)
    # The hash decides; equal rows are told apart by their contents alone, so that runs agree.
    mark = F.sha2(F.concat(F.lit(f"{config.seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("null"))), 256)
    first = usable.orderBy(mark, "x", "wide").limit(config.clusters).collect()
    centroids = [list(r["x"]) if r["x"] is not None else [_floor(v, config.scale) for v in r["wide"]] for r in first]
    schema = f"key {kind}, x array<int>, wide array<double>, cluster int"
    places = [fresh_path(spark, f"vectors-{i}") for i in range(2)]
    table = usable.withColumn("cluster", F.lit(0))
    for turn in range(config.rounds if centroids else 0):
        place = places[turn % 2]
        table.mapInArrow(_assigned(centroids, config, True), schema).write.mode("overwrite").parquet(place)
        table = spark.read.schema(schema).parquet(place)
        centroids = _means(table, centroids, config)
    last = table.mapInArrow(_assigned(centroids, config, False), f"key {kind}, cluster int, distance long")
    return stored(last.withColumnRenamed("key", key), "clusters"), centroids


def clusters(rows: DataFrame, config: SortMeans = SortMeans(), vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) per usable vector."""
    spark = rows.sparkSession
    found, centroids = cluster(rows, config, vector, key)
    # One row per cluster.
    whole = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: None if r["d"] is None else int(r["d"]) for r in found.groupBy("cluster").agg(whole.alias("d")).collect()}
    total = None if None in sums.values() else sum(sums.values())
    fit = lambda v: v if v is not None and v < LONG else None
    lines = [(a, fit(d), fit(total), hashlib.sha256(",".join(map(str, centroids[a])).encode()).hexdigest()) for a, d in sums.items()]
    told = spark.createDataFrame(lines, "told int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), F.col("cluster") == F.col("told")).drop("told")
