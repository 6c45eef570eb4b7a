"""A corpus pipeline from the operators of turnmill.llm.

Each stage takes the documents that the stage before has kept, written as
Parquet and read again, and returns documents; the last returns the packed
pieces. All decisions are the operators'; this file only puts them in order.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm import langid, line_dedup, minhash, mixing, packing
from turnmill.llm.common import crc_fold, documents, shared_dir, small_batches


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text is null or has no letter; every other one has a language, however sure, and stays.

    Null ids and languages are no obstacle (the model learns from labelled rows only), repeated rows are judged one by
    one, ties between languages don't matter here, and an empty table stays empty. Columns of any name pass through.
    """
    small_batches(spark)
    labelled = docs.where(crc_fold(F.col("doc_id"), 4) != 2).select(F.col("doc_id").alias("id"), "lang", "text")
    found = langid.identify(docs, langid.train(labelled))
    return found.where(F.col("lang_pred") != langid.UNDETERMINED).select("row.*")


def line_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that an earlier line matches; documents that lose all their words go.

    A null text has no lines to lose and stays, as does an empty one; a null id comes first in the order. Rows that
    repeat id and text are one document and keep the same lines. An empty table stays empty; other columns are kept, but
    n_chars follows the text.
    """
    small_batches(spark)
    cut = line_dedup.without_repeated_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    Rows without words are like no other and stay. Rows that repeat an id are one document to the operator, so they stay
    or go together, and that goes for all rows with a null id too. An empty table stays empty; all columns are kept.
    """
    small_batches(spark)
    kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does, up to twice; a document may not be taken.

    Documents without a source are a source of their own, the last; a null id is placed like any other, and a null text has
    no words. Rows that repeat are taken one by one. An empty table stays empty; all columns are kept.
    """
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens; a document that the mix repeats is packed as often.

    A null or empty text is just its end. Ids may be null or repeat and are passed on with their pieces; equal lengths fill
    up in any order. An empty table gives no pieces; other columns are ignored.
    """
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_removal),
    ("near_dedup", near_duplicates),
    ("mixing", source_mix),
    ("packing", best_fit_packing),
]

#: Language models, hash sketches and tokenisation have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the `documents` of `sf_dir`; stages pass Parquet in the shared folder."""
    docs = documents(spark, sf_dir)
    folder = f"{shared_dir(spark)}/pipeline/{uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
