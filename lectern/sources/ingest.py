"""From uploaded files to tables: validation, page providers, and sinks in order of dependence."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import words as W
from lectern.operators import chunks as C
from lectern.operators import tables as B

# Accepted suffixes with their types.
TYPES = {".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg"}
PAGE = "path string, page_number int, text string, width double, height double, error string"
#: A provider turns a file's bytes into pages: (text, width, height).
Provider = Callable[[str, bytes], list[tuple[str, float | None, float | None]]]


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def validate(files: DataFrame, max_mb: int = 20) -> DataFrame:
    """Adds mime_type and reason: why a file (path, length) is refused, null if it isn't."""
    known = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    typed = files.withColumn("mime_type", F.try_element_at(known, suffix(F.col("path"))))
    reason = F.when(F.col("mime_type").isNull(), "unsupported type").when(F.col("length") > max_mb * 1024 * 1024, "too large")
    return typed.withColumn("reason", reason)


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files of a folder and those below it, with their bytes."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.load(folder)


def checksums(found: DataFrame) -> DataFrame:
    return found.select("path", F.sha2("content", 256).alias("sha256"))


def pages(found: DataFrame, provider: Provider) -> DataFrame:
    """Pages, numbered from 1, by a provider; a file that it cannot read gives one row with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    got = provider(path, bytes(content))
                    rows += [(path, n, t.replace("\0", " ").strip(), w, h, None) for n, (t, w, h) in enumerate(got, 1)]
                except Exception as problem:  # a file's own fault must not end the job
                    rows.append((path, None, None, None, None, str(problem)))
            frame = pd.DataFrame(rows, columns=[f.split()[0] for f in PAGE.split(", ")])
            yield frame.astype({"page_number": "Int32", "width": "float64", "height": "float64"})

    return found.select("path", "content").mapInPandas(run, PAGE)


def parse_ocr_table(table: Column) -> Column:
    """(text, confidence) of recognized words in tab-separated lines with a header; confidence is the mean of those not negative."""
    rows = F.split(table, "\n")
    cells = F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.split(r, "\t"))
    seen = F.filter(cells, lambda c: (F.size(c) >= 12) & (F.btrim(F.get(c, F.lit(11))) != ""))
    words = F.transform(seen, lambda c: F.btrim(F.get(c, F.lit(11))))
    sure = F.filter(F.transform(seen, lambda c: F.get(c, F.lit(10)).try_cast("double")), lambda x: x >= 0)
    mean = F.when(F.size(sure) > 0, F.round(F.aggregate(sure, F.lit(0.0), lambda a, x: a + x) / F.size(sure), 2))
    return F.struct(F.array_join(words, " ").alias("text"), mean.alias("confidence"))


def fake_embedding(text: str, dimension: int = 384) -> list[float]:
    """A stable unit vector of a text, for tests and for want of a model."""
    out: list[float] = []
    block = 0
    while len(out) < dimension:
        digest = hashlib.sha256(f"{block}|{text}".encode()).digest()
        out += [int.from_bytes(digest[i : i + 4], "little") / 2**31 - 1 for i in range(0, 32, 4)]
        block += 1
    out = out[:dimension]
    norm = sum(x * x for x in out) ** 0.5 or 1.0
    return [x / norm for x in out]


def embed(rows: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]], dimension: int) -> DataFrame:
    """Adds embedding, an array of ``dimension`` floats, by a provider that takes batches."""

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found = embedder(batch.fillna("").tolist())
            if any(len(v) != dimension for v in found):
                raise ValueError(f"a vector has not {dimension} dimensions")
            yield pd.Series(found)

    return rows.withColumn("embedding", run(F.col(text)))


def store_uploads(found: DataFrame, max_mb: int = 20) -> DataFrame:
    """Accepted files (path, length, content) under stored names: their checksum with their suffix, so that storing again changes nothing."""
    accepted = validate(found, max_mb).where("reason is null")
    sha = F.sha2("content", 256)
    return accepted.select("path", F.concat(sha, suffix(F.col("path"))).alias("stored_filename"), "mime_type", sha.alias("sha256"), F.col("length").alias("size_bytes"), "content")


def save_stream(stream, folder: str, filename: str, max_mb: int = 20, block: int = 1 << 20) -> str:
    """Copy a stream to the folder in blocks, under a name of its own; too large a one leaves nothing behind."""
    ending = os.path.splitext(filename)[1].lower()
    if ending not in TYPES:
        raise ValueError("unsupported type")
    os.makedirs(folder, exist_ok=True)
    path, size = os.path.join(folder, f"{uuid.uuid4().hex}{ending}"), 0
    try:
        with open(path, "wb") as out:
            while data := stream.read(block):
                size += len(data)
                if size > max_mb << 20:
                    raise ValueError("too large")
                out.write(data)
    except BaseException:
        if os.path.exists(path):
            os.remove(path)
        raise
    return path


def recognized(images: DataFrame, provider, language: str = "eng") -> DataFrame:
    """(path, page_number, text, confidence) of page images (path, page_number, content); pages without words are left out."""

    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: provider.ocr_image(bytes(c), language) if c is not None else "")

    table = images.select("path", "page_number", read("content").alias("table"))
    return table.select("path", "page_number", parse_ocr_table(F.col("table")).alias("x")).select("path", "page_number", "x.text", "x.confidence").where("text <> ''")


def with_ocr(native: DataFrame, images: Callable[[DataFrame], DataFrame], provider, most: int = 25, language: str = "eng") -> DataFrame:
    """Native pages (path, page_number, text) completed by recognition: the first sparse ones of each file, by a renderer of page images."""
    low = C.sparse_pages(native, "path", most=most)
    found = recognized(images(low.select("path", "page_number")), provider, language)
    return C.merge_ocr(native, found.withColumnRenamed("confidence", "ocr_confidence"), ["path", "page_number"])


def page_images(rendered: DataFrame, dpi: int = 150) -> DataFrame:
    """Metadata of rendered PNG pages (document_id, page_number, content): size from the header, and the checksum."""
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("int")
    return rendered.select("document_id", "page_number", F.lit(dpi).alias("render_dpi"), number(17).alias("width"), number(21).alias("height"), F.lit("image/png").alias("media_type"), F.sha2("content", 256).alias("checksum"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows with the new ones in the place of those that have their keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def first_existing(wanted: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """(key, path): for each row of (key, candidates) the first path that a listing (path) has; null where it has none."""
    each = wanted.select(key, F.posexplode("candidates").alias("place", "path")).join(listing.select("path").distinct(), "path", "left_semi")
    found = each.groupBy(key).agg(F.min_by("path", "place").alias("path"))
    return wanted.select(key).join(found, key, "left")


def public_report(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Completed runs with their reviewed results, without local ids and traces, as they are published."""
    shown = results.where(F.col("human_assessment").isNotNull()).select("run_id", F.struct("question", "status", "human_assessment", "duration_ms").alias("case"))
    listed = shown.groupBy("run_id").agg(F.array_sort(F.collect_list("case")).alias("cases"))
    return runs.where("status = 'completed'").join(listed, "run_id").select("name", "finished_at", "measurements", "cases")


def write_json(frame: DataFrame, folder: str) -> None:
    frame.write.mode("overwrite").json(folder)


def to_load(pack: DataFrame, allowed: list[str], stored: DataFrame) -> DataFrame:
    """Files of a demonstration (filename, sha256, expected_sha256) that may be loaded and are not yet there; a wrong checksum ends the job."""
    named = pack.where(F.col("filename").isin(*allowed))
    checked = named.withColumn("sha256", F.when(F.col("sha256") == F.col("expected_sha256"), F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("checksum differs: "), "filename"))))
    return checked.join(stored.select("sha256"), "sha256", "left_anti")


def missing_cases(cases: DataFrame, there: DataFrame) -> DataFrame:
    """Cases whose document has no such question yet, so that loading twice adds nothing."""
    return cases.dropDuplicates(["document_id", "question"]).join(there.select("document_id", "question"), ["document_id", "question"], "left_anti")


def write_tables(page_rows: DataFrame, folder: str, embedder=None, dimension: int = 384) -> None:
    """Pages, chunks and tables with their cells become current together, and then embeddings; a failure leaves readers what was current.

    Read with ``snapshots.read``. Texts that were embedded before are not embedded again.
    """
    from lectern.sources import snapshots, vectors

    commit = snapshots.Commit(page_rows.sparkSession, folder)
    pages = commit.write("pages", page_rows.withColumn("page_id", F.sha2(F.concat_ws("|", "path", "page_number"), 256)))
    found = C.chunks(pages, "text", "page_id").withColumn("chunk_id", F.sha2(F.concat_ws("|", "page_id", "chunk_index"), 256))
    chunks = commit.write("chunks", found)
    cells = commit.write("document_table_cells", B.table_cells(pages.select("page_id", "text"), ["page_id"]))
    shape = cells.groupBy("page_id", "table_index").agg((F.max("row_index") + 1).alias("row_count"), (F.max("column_index") + 1).alias("column_count"))
    first = chunks.groupBy("page_id").agg(F.min_by("chunk_id", "chunk_index").alias("source_chunk_id"))
    commit.write("document_tables", shape.join(first, "page_id", "left"))
    commit.publish()
    if embedder is not None:
        embedded = vectors.embed(chunks.select("chunk_id", "chunk"), f"{folder}/embedded", embedder, dimension, "chunk")
        later = snapshots.Commit(page_rows.sparkSession, folder)
        later.write("chunk_embeddings", embedded.select("chunk_id", "embedding"))
        later.publish()


def caption_chunks(captions: DataFrame, chunks: DataFrame, page: str = "page_id") -> DataFrame:
    """``captions`` (page, caption) with the first chunk of their page that holds them, blanks aside; the page's first chunk for want of a caption."""
    flat = lambda c: W.collapsed(F.col(c))
    both = captions.join(chunks.select(page, "chunk_id", "chunk_index", "chunk"), page)
    held = both.where(F.col("caption").isNull() | F.contains(flat("chunk"), flat("caption")))
    first = held.groupBy(page, F.coalesce("caption", F.lit("")).alias("said")).agg(F.min_by("chunk_id", "chunk_index").alias("chunk_id"))
    return captions.withColumn("said", F.coalesce("caption", F.lit(""))).join(first, [page, "said"], "left").drop("said")
