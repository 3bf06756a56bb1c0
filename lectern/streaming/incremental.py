"""Incremental indexing and metrics: file streams that process what is new and stop."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType

from lectern.operators import chunks as C
from lectern.sources import ingest as I


def index_new_documents(
    spark: SparkSession, folder: str, schema: StructType, out: str, checkpoint: str, text: str = "text", key: str = "doc_id"
) -> StreamingQuery:
    """Chunk documents that arrive as Parquet in a folder; every call takes those that are new and ends.

    A batch is written under its own number, so one that runs again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        C.chunks(batch, text, key).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_new_files(spark: SparkSession, folder: str, out: str, checkpoint: str, max_mb: int = 20) -> StreamingQuery:
    """Accepted files that arrive in a folder, stored under their checksums; every call takes those that are new and ends.

    The stream keeps a state of the checksums it has stored, with its checkpoint: a file that comes again under any name, in
    the same batch, a later one or after a restart, is not stored again.
    """
    kind = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(kind).option("recursiveFileLookup", "true").load(folder)
    once = I.store_uploads(stream, max_mb).dropDuplicates(["sha256"])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reindexed(indexed: DataFrame, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The chunks of an index with those of some documents made anew; what hangs on their old chunks goes with them."""
    fresh = C.chunks(docs, text, key)
    return indexed.join(docs.select(key), key, "left_anti").select(*fresh.columns).unionByName(fresh)


def _settled(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What a case's latest judgement changes in the sums: its own counts in, those of the judgement before out."""
    before = state.get if state.exists else None
    last = before
    for batch in batches:
        for version, measure, numerator, denominator in batch[["version", "measure", "numerator", "denominator"]].itertuples(index=False, name=None):
            row = (int(version), measure, float(numerator), float(denominator))
            if last is None or row > tuple(last):
                last = row
    if last is not None and (before is None or tuple(last) != tuple(before)):
        state.update(tuple(last))
        old = [(before[1], -before[2], -before[3], -1)] if before is not None else []
        yield pd.DataFrame([*old, (last[1], last[2], last[3], 1)], columns=["measure", "numerator", "denominator", "cases"])


def running_measures(results: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Sums of a stream of judgements (case_id, version, measure, numerator, denominator), a later version in the place of an earlier one.

    A case's state is its latest judgement; what changes the sums is written for each batch, under its number, so a batch that
    runs again replaces itself. Judgements may come in any order: one older than what is known changes nothing.
    """
    changed = results.groupBy("case_id").applyInPandasWithState(
        _settled, "measure string, numerator double, denominator double, cases long",
        "version long, measure string, numerator double, denominator double", "append", "NoTimeout",
    )

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("measure").agg(*[F.sum(c).alias(c) for c in ("numerator", "denominator", "cases")])
        sums.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return changed.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def measures(spark: SparkSession, out: str) -> DataFrame:
    """(measure, numerator, denominator, cases, value) of all batches so far; null where the denominator is 0."""
    sums = spark.read.parquet(out).groupBy("measure").agg(*[F.sum(c).alias(c) for c in ("numerator", "denominator", "cases")])
    return sums.where("cases > 0").withColumn("value", F.col("numerator") / F.nullif("denominator", F.lit(0.0)))
