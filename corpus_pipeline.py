"""A training corpus from raw documents, stage by stage.

Each stage works on all documents its predecessor kept. The first four return the columns
of ``documents``; the last one returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import decontaminate, near_dedup, packing, quality, secrets
from chronofold.llm.columns import spare_name
from chronofold.llm.scratch import Scratch

ORACLE_SQL = None
"""Tokens, trained scores and signatures have no SQL; tests/llm compares with brute force."""


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier takes; word vectors and labels are those of these documents.

    Null and empty texts are judged like a text without words, very long ones whole; repeated
    rows fare alike; an empty table stays empty; other columns, whatever their names, stay.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = spare_name(docs.columns, "score")
    scored = quality.score_texts(docs, model, score)
    return scored.where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


LATE = 1 << 62
"""Row keys from here on are those of ids that several texts share."""


def _row_keys(spark: SparkSession, docs: DataFrame, text: str, key: str) -> DataFrame:
    """``docs`` with the digest of its text and a key of its own for each id and text.

    The key is the id itself, except where several texts share an id: there it is a hash of
    both, above all ids in use. A null id has a null key.
    """
    marked = docs.withColumn(text, secrets.blob_id(F.col("text")))
    shared = marked.where("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("low"), F.max(text).alias("high"))
    shared = Scratch(spark).keep(shared.where("low <> high").select(F.col("doc_id").alias(key)), "shared")
    several = F.col(key).isNotNull()
    apart = F.shiftrightunsigned(F.xxhash64("doc_id", text), 2) + F.lit(LATE)
    own = F.when(several, apart).otherwise(F.col("doc_id").cast("bigint"))
    return marked.join(shared, F.col("doc_id") == F.col(key), "left").withColumn(key, own)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8.

    The smallest id stays; ids that several texts share come after all others, and each of
    their texts is judged by itself. Rows that repeat another's id and text go as well. Null
    and empty texts and texts without words are nobody's copy; very long ones are compared
    whole; rows of a null id stay; an empty table stays empty; other columns, whatever their
    names, stay.
    """
    text, key = spare_name(docs.columns, "_text"), spare_name(docs.columns, "_key")
    keyed = _row_keys(spark, docs, text, key)
    found = near_dedup.near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), k=5, threshold=Fraction(4, 5))
    copies = found.where("not kept").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(copies, key, "left_anti").dropDuplicates([key, text]).select(*docs.columns)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that copies a benchmark item.

    A text decides for all rows that hold it and for no other row of their ids. Null and empty
    texts hold nothing; very long ones are searched whole; an empty table of documents or items
    drops nothing; other columns, whatever their names, stay.
    """
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    text = spare_name(docs.columns, "_text")
    marked = docs.withColumn(text, secrets.blob_id(F.col("text")))
    leaks = decontaminate.find_copies(marked, tests, key=text).select(text).distinct()
    return marked.join(Scratch(spark).keep(leaks, "leaks"), text, "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets masked in their texts; n_chars follows the text.

    Null and empty texts stay; very long ones are scanned whole; repeated rows stay repeated;
    an empty table stays empty; other columns, whatever their names, stay.
    """
    masked = secrets.redact_documents(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place.

    A null or empty text is its end id alone; a very long one is cut into several pieces;
    repeated rows are packed each; an empty table gives no pieces; other columns are not read.
    """
    return packing.best_fit_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_copies),
    ("secrets", mask_secrets),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written and read again before the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
