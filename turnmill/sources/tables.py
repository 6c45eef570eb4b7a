"""The driver's tables as turns, documents, vectors and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Turns have no time of their own: they are a minute apart from here on.
EPOCH = "2025-01-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, turn_no, speaker, content, item_id, ts."""
    t = read(spark, sf_dir, "conversations")
    return t.select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("turn_no"),
        F.col("role").alias("speaker"),
        F.col("text").alias("content"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"),
        (F.lit(EPOCH).cast("timestamp") + F.make_interval(mins=F.col("turn").cast("int"))).alias("ts"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text").alias("content"), "source", "lang")


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations: op is the event type, observed_ms the value, k from the properties."""
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id",
        "ts",
        F.col("user_id").alias("session_id"),
        F.col("event_type").alias("op"),
        F.col("value").alias("observed_ms"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
