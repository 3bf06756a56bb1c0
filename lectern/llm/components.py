"""Connected components of an edge table, by alternating star contractions.

Every round replaces edges by edges to smaller neighbours (large star, then
small star); the number of rounds grows with the logarithm of the longest
chain. Rounds are joins and partial minima, so a node with very many edges is
pre-aggregated before it is shuffled and its join is split by adaptive
execution. The graph never leaves the executors.

What a round costs on a small graph is its tasks and their files, so both stars
together deal out edges six times, the end is seen from the edges instead of
from a round that changes nothing, a checkpoint of few edges is read in few
tasks, and what a round leaves behind is dropped before the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.storage import cut, release

#: Edges of a checkpoint that a task reads before there are more tasks than cores.
READ = 100_000


def _each(df: DataFrame, *rows: Column) -> DataFrame:
    """The structs of every row that are not null, as rows: reads ``df`` once, unlike a union."""
    return df.select(F.explode(F.array(*rows)).alias("row")).where("row is not null").select("row.*")


def _row(u: str, v: str) -> Column:
    return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))


def _star(arcs: DataFrame, keep: Column) -> DataFrame:
    """Link what ``keep`` selects of each node's neighbours, and the node, to the least of node and neighbours."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = arcs.join(least, "u")
    return _each(linked, F.when(keep & (F.col("v") != F.col("m")), _row("v", "m")), F.when(F.col("u") != F.col("m"), _row("u", "m"))).distinct()


def _round(edges: DataFrame) -> DataFrame:
    """Both stars. The large star's edges already point from the larger to the smaller node."""
    large = _star(_each(edges, _row("u", "v"), _row("v", "u")), F.col("v") > F.col("u"))
    return _star(large, F.lit(True))


def _open(edges: DataFrame) -> tuple[int, int]:
    """Edges, and nodes that keep them from being stars: those with two edges down, or with edges down and up."""
    end = lambda name, down: F.struct(F.col(name).alias("node"), F.lit(down).alias("down"))
    nodes = _each(edges, end("u", True), end("v", False)).groupBy("node")
    nodes = nodes.agg(F.count_if("down").alias("down"), F.count_if(~F.col("down")).alias("up"))
    between = (F.col("down") > 1) | (F.col("down") > 0) & (F.col("up") > 0)
    row = nodes.agg(F.sum("down").alias("edges"), F.count_if(between).alias("open")).first()
    return row["edges"] or 0, row["open"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; the component is its least node.

    ``edges`` has two integer columns u and v; repeated edges, loops and both
    directions are allowed, rows with a null are ignored.
    """
    spark = edges.sparkSession
    current = cut(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    n, between = _open(current)
    while True:
        current = current.coalesce(max(spark.sparkContext.defaultParallelism, -(-n // READ)))
        release(spark)
        if not between:
            break
        current = cut(_round(current))
        n, between = _open(current)
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.union(roots)
