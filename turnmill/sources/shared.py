"""The folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below `spark.checkpoint.dir`; a local session without the setting gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="turnmill-")
    return f"{root}/{name}/{uuid4()}"


def small_batches(spark: SparkSession) -> None:
    """Bounds this session's Arrow batches to 1,000 rows and 4 MB, however long texts or blocks are. Spark reads the setting
    when a query runs, so it stays set."""
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 4 << 20)):
        name = f"spark.sql.execution.arrow.{name}"
        held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
        spark.conf.set(name, str(min(held, most) if held > 0 else most))


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as Parquet in the shared folder: worked out once, of known size, and safe from lost executors."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(f"{folder}/rows")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")
