"""Picking rows within groups: the latest, the best with its ties, what comes near it, what stands first.

All are window or aggregate plans; top-k limits reach the window, so a group
of any size keeps k rows per task before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What an answer shows at most, and how far below the best it may reach.
MOST, WITHIN = 3, 2


def first_rows(rows: DataFrame, group: list[str], order: list[Column], most: int = 1, place: str = "place") -> DataFrame:
    """The first rows of each group in an order, numbered from 1."""
    window = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(place, F.row_number().over(window)).where(F.col(place) <= most)


def latest(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The row of each key that is last in the order; an aggregate, so no group is sorted."""
    others = [c for c in rows.columns if c not in key]
    newest = rows.groupBy(*key).agg(F.max(F.struct(*order, *[c for c in others if c not in order])).alias("newest"))
    return newest.select(*key, *[F.col(f"newest.{c}").alias(c) for c in others])


def recent(rows: DataFrame, key: list[str], value: str, *order: str, most: int = MOST) -> DataFrame:
    """(key, n, recent): how many rows a key has, and the values of the latest, newest first."""
    top = first_rows(rows.select(*dict.fromkeys([*key, value, *order])), key, [F.desc(c) for c in order], most)
    listed = top.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", value))).alias("x"))
    counts = rows.groupBy(*key).agg(F.count("*").alias("n"))
    return counts.join(listed, key).select(*key, "n", F.transform("x", lambda e: e[value]).alias("recent"))


def carried(value: Column, group: list[str], order: list[Column]) -> Column:
    """The last value that is not null up to each row, as chunks inherit a heading."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def with_best(rows: DataFrame, group: list[str], score: str) -> DataFrame:
    """Adds best, the largest score of the group."""
    return rows.join(rows.groupBy(*group).agg(F.max(score).alias("best")), group)


def ties_with_best(rows: DataFrame, group: list[str], score: str, order: list[Column], most: int = MOST) -> DataFrame:
    """The first rows that share a group's best score; where that is not positive, the first rows by score."""
    best = with_best(rows, group, score)
    tied = best.where((F.col(score) == F.col("best")) | (F.col("best") <= 0))
    return first_rows(tied.drop("best"), group, [F.desc(score), *order], most)


def near_best(rows: DataFrame, group: list[str], score: str, within: float = WITHIN) -> DataFrame:
    """Rows within that much of their group's best score, and at least 1; all, where the best is not positive."""
    best = with_best(rows, group, score)
    near = F.col(score) >= F.greatest(F.lit(1.0), F.col("best") - within)
    return best.where((F.col("best") <= 0) | near).drop("best")


def ordered_union(parts: list[DataFrame], key: list[str], order: list[str]) -> DataFrame:
    """The rows of all parts, each key once: the earliest part counts, and in it the first in order."""
    columns = parts[0].columns
    whole = None
    for rank, part in enumerate(parts):
        ranked = part.select(*columns).withColumn("part_rank", F.lit(rank))
        whole = ranked if whole is None else whole.unionByName(ranked)
    return first_rows(whole, key, [F.col("part_rank"), *map(F.col, order)], place="part_place").drop("part_rank", "part_place")


def split_cited(hits: DataFrame, cited: DataFrame, keys: list[str]) -> DataFrame:
    """Adds role: "answer" for hits that an answer cites, "related" for all others."""
    answer = hits.join(cited.select(*keys).distinct(), keys, "left_semi").withColumn("role", F.lit("answer"))
    return answer.unionByName(hits.join(cited.select(*keys), keys, "left_anti").withColumn("role", F.lit("related")))


def cited_first(hits: DataFrame, cited: DataFrame, chunks: DataFrame, group: list[str], key: str) -> DataFrame:
    """The evidence of an answer before all other hits, in the order of citation, then the hits in theirs.

    ``hits`` has group, key, text and place; ``cited`` group, key and place. What
    an answer cites and no hit has is looked up in ``chunks`` (key, text) and
    scores 1; what is in neither is left out.
    """
    shown = hits.select(*group, key, "text", "score", "place")
    named = cited.select(*group, key, F.col("place").alias("cited_place"))
    found = named.join(shown, [*group, key], "left").join(chunks.select(key, F.col("text").alias("looked_up")), key, "left")
    evidence = found.select(
        *group, key, F.coalesce("text", "looked_up").alias("text"), F.coalesce("score", F.lit(1.0)).alias("score"), F.col("cited_place").alias("place")
    ).where(F.col("text").isNotNull())
    whole = ordered_union([evidence, shown], [*group, key], ["place"])
    cited_keys = named.select(*group, key, F.lit(0).alias("later"), "cited_place").dropDuplicates([*group, key])
    marked = whole.join(cited_keys, [*group, key], "left")
    order = Window.partitionBy(*group).orderBy(F.coalesce("later", F.lit(1)), F.coalesce("cited_place", "place"), key)
    return marked.withColumn("shown_at", F.row_number().over(order)).drop("later", "cited_place", "place")
