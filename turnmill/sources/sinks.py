"""Writers: item files by day and session, results, frozen golden sets, training exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.operators import summaries


def append_items(items: DataFrame, folder: str) -> None:
    """Appends items (with timestamp and session_id) as JSON lines, partitioned by day and session.

    Spark's commit protocol makes the append atomic: readers see all of it or nothing.
    """
    keyed = items.withColumn("day", F.to_date("timestamp")).withColumn("session_id", F.coalesce("session_id", F.lit("default")))
    keyed.write.mode("append").partitionBy("day", "session_id").json(folder)


def append_vectors(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").parquet(folder)


def replace(rows: DataFrame, folder: str, form: str = "parquet") -> None:
    """Writes a table anew; used for prices and for clearing a store (with no rows)."""
    rows.write.mode("overwrite").format(form).save(folder)


def write_results(metrics: DataFrame, folder: str) -> None:
    """results as JSON, and policy, cost and recall as CSV for a Pareto plot."""
    metrics.write.mode("overwrite").json(f"{folder}/results")
    flat = [f.name for f in metrics.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))]
    metrics.select(*flat).write.mode("overwrite").option("header", "true").csv(f"{folder}/pareto")


def freeze(items: DataFrame, folder: str) -> DataFrame:
    """Writes items by stratum and returns the manifest: (stratum, sha256).

    Each item's row is hashed; rows are sorted and hashed within 256 bins (the hash's first
    two digits), and the bins' hashes once more, so that no task gathers a whole stratum.
    """
    items.write.mode("overwrite").partitionBy("stratum").json(f"{folder}/items")
    rows = items.select("stratum", F.sha2(F.to_json(F.struct("id", "content", "query")), 256).alias("h"))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    bins = rows.groupBy("stratum", F.substring("h", 1, 2).alias("b")).agg(joined("h").alias("x"))
    return bins.groupBy("stratum").agg(joined(F.concat("b", "x")).alias("sha256"))


def changed(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """Strata whose hash is missing or different now."""
    return manifest.join(now, ["stratum", "sha256"], "left_anti").select("stratum")


def export_training(rows: DataFrame, folder: str) -> None:
    """JSON, and CSV with nested columns as JSON text."""
    rows.write.mode("overwrite").json(f"{folder}/json")
    nested = (T.MapType, T.ArrayType, T.StructType)
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in rows.schema.fields]
    rows.select(*flat).write.mode("overwrite").option("header", "true").csv(f"{folder}/csv")


def executed(routed: DataFrame, folder: str) -> None:
    """Writes routed turns, one folder for each action and backend: what is dropped is only recorded, and what is
    summarized gets its summary as the new item's text, if the turns have their content."""
    summary = F.when(F.col("action") == "summarize", summaries.extractive(F.col("content"), least_tokens=100)) if "content" in routed.columns else F.lit(None).cast("string")
    routed = routed.withColumn("summary", summary)
    routed.withColumn("backend", F.coalesce("backend", F.lit("none"))).write.mode("append").partitionBy("action", "backend").parquet(folder)


def read_executed(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def append_events(events: DataFrame, folder: str) -> None:
    """Appends telemetry or trace events as JSON lines."""
    events.write.mode("append").json(folder)


def stream_events(events: DataFrame, folder: str):
    """The same for a stream: starts the query that appends its events, each exactly once, and returns it."""
    return events.writeStream.format("json").option("checkpointLocation", f"{folder}/_checkpoint").start(f"{folder}/events")


def write_labelled(samples: DataFrame, folder: str) -> None:
    """Appends labelled samples, those that failed in a folder of their own (success=false)."""
    samples.write.mode("append").partitionBy("success").json(folder)


def save_model(model, folder: str) -> None:
    """Writes a fitted Spark pipeline, in place of an older one."""
    model.write().overwrite().save(folder)


def load_model(folder: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(folder)
