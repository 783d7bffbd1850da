"""The stages of the corpus pipeline: (name, function of session, documents, data folder).

Every stage but the last returns the columns of ``documents``. Null and empty texts, repeated rows
and empty tables go through as the operators define.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .language import UNKNOWN, fit_languages, fold_of, identify_languages
from .lines import deduplicate_lines
from .mixing import mix_sources
from .packing import pack_documents
from .queries import RANKS, TOKENIZER
from .sketch import near_duplicates

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; a missing language is filled in."""
    model = fit_languages(docs.where(fold_of(F.col("doc_id")) != 2))
    found = identify_languages(docs, model).where(F.col("lang_pred") != UNKNOWN)
    return found.select(*[
        F.coalesce("doc.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"doc.{c}")
        for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents left without a line; ``n_chars`` follows the text."""
    return deduplicate_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(
        docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each near-duplicate group stays, and one of repeated rows."""
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    rows = docs.join(gone, "doc_id", "left_anti").select(
        F.struct(*docs.columns).alias("doc"), F.row_number().over(Window.partitionBy(
            "doc_id", F.xxhash64("text")).orderBy("source")).alias("again"))
    return rows.where(F.col("doc.doc_id").isNull() | (F.col("again") == 1)).select("doc.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    prefix = "mix_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    mixed = mix_sources(docs, prefix=prefix)
    copies = F.explode(F.array_repeat(F.lit(1), F.col(prefix + "copies").cast("int")))
    return mixed.select(*docs.columns, copies.alias(prefix + "copy")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all sequences, as the packing query gives them."""
    return pack_documents(docs, TOKENIZER, ranks=RANKS).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset", "cost")


STAGES: list[tuple[str, Stage]] = [
    ("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("mixing", mixing), ("packing", packing),
]
