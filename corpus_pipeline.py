"""A corpus pipeline: documents in, packed training sequences out.

Each stage takes all that the one before kept. Between stages the documents are
written as Parquet to the shared folder and read again, so a lost executor
costs the stage it was in at most.

Cases: all stages but the last give back the columns they get, whatever they are
called; a null or letterless text goes at the first stage, texts of any length
are worked on whole; repeated rows and rows without a doc_id count as copies of
each other where their texts are alike, of which the row with the smallest
doc_id stays once, a null one only where no other has an id; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import copies, langid, packing, quality, secrets, simhash
from lectern.llm.queries import tokenizer
from lectern.llm.storage import fresh_path, unused


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known; those without letters, or in no known language, go."""
    rules = langid.LanguageRules()
    sample = langid.learn(docs, rules, F.lit(True), "text", "lang", "doc_id")
    lang, score, rate = (unused(docs, x) for x in langid.NAMES)
    found = langid.predict(docs, sample, rules, names=(lang, score, rate))
    # Text in no known language needs about as many phrases as shuffled letters do.
    most = F.lit(float("inf"))
    for known, limit in langid.limits(sample, rules).items():
        most = F.when(F.col(lang) == known, F.lit(limit)).otherwise(most)
    strange = F.coalesce(F.col(rate) > most, F.lit(False))
    return found.where((F.col(lang) != langid.UNKNOWN) & ~strange).select(*docs.columns)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the adaptive limits of their group keep."""
    return quality.filter_quality(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of copies: SimHash fingerprints of three-word shingles within three bits, and edited copies.

    The fingerprints are filed under the keys of their pigeonring chains and linked as by op3. Copies that were edited
    more, with a Jaccard of 0.8 or more of their five-word shingles, differ in some ten bits, where no chain of equal
    segments is selective: these links come from min-wise keys and are added. What either links is one group; of it the
    row with the smallest doc_id stays, a null one only where no other has an id, and of rows that share an id one text.
    """
    first_id, first_hash, text_hash = (unused(docs, name) for name in ("first_id", "first_hash", "text_hash"))
    first = copies.first_rows(docs, linked=simhash.text_classes(docs)).select(F.col("doc_id").alias(first_id), F.col("own").alias(first_hash))
    marked = docs.withColumn(text_hash, F.xxhash64("text"))
    rows = marked.join(first, F.col("doc_id").eqNullSafe(F.col(first_id)) & (F.col(text_hash) == F.col(first_hash)), "left_semi")
    # A row that is there twice stays once.
    return rows.dropDuplicates(["doc_id", text_hash]).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask where secrets were; n_chars counts the new text."""
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(chars))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences of 1,024 ids."""
    return packing.pack(docs, packing.Packing(path=tokenizer("byte_bpe_50k.json"), end_id=2, length=1024))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Language models, sketches and tokenizers are beyond SQL; tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
