"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the bytes 0x20 and 0x09-0x0D. Everything else is part of a word.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def small_batches(spark: SparkSession) -> None:
    """Bounds this session's Arrow batches to 1,000 rows and 4 MB: whole texts are long rows, and a batch is held in
    memory several times (outside the heap, in transit, and in the Python worker). Spark reads the setting when a
    query runs, so it stays set."""
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 4 << 20)):
        name = f"spark.sql.execution.arrow.{name}"
        held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
        spark.conf.set(name, str(min(held, most) if held > 0 else most))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `documents` table below a data folder (any path that Spark reads)."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for data that outlives an executor: `spark.checkpoint.dir`.

    Only a local session may go without the setting; it then gets a temporary
    folder. On a cluster a machine-local folder would be wrong, so that raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="turnmill-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df`, written to the shared folder: later reads survive a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def saved(df: DataFrame) -> DataFrame:
    """Like `cut_lineage`, as compressed Parquet: for large tables, and where columns are read apart."""
    return Shelf(df.sparkSession).put(df)


class Shelf:
    """Tables in the shared folder that an operator needs for a while, and lets go together. `options` are Parquet's."""

    def __init__(self, spark: SparkSession, **options: str):
        self.spark, self.options = spark, options
        self.folder = f"{shared_dir(spark)}/tables/{uuid.uuid4()}"
        self.tables = 0
        self.broadcasts: list[Broadcast] = []

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.tables}"
        self.tables += 1
        df.write.options(**{"compression": "zstd"} | self.options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def broadcast(self, value) -> Broadcast:
        self.broadcasts.append(self.spark.sparkContext.broadcast(value))
        return self.broadcasts[-1]

    def clear(self) -> None:
        """Deletes the tables and broadcasts. Nothing that is still to be worked out may read them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        for value in self.broadcasts:
            value.destroy()
        self.tables, self.broadcasts = 0, []


def sized(table: DataFrame, most: int = 1 << 20) -> DataFrame:
    """A saved table of a few numbers a row, for a join: broadcast if it has at most `most` rows, which Parquet's footers
    tell, else left to a shuffle."""
    return F.broadcast(table) if table.count() <= most else table


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else.

    `lower` takes a fast path for pure ASCII, where it means the same.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def word_count(text: Column) -> Column:
    """Number of words (see WORD_PATTERN); 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))), F.lit(0)).cast("long")


def crc_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(0))


def row_struct(df: DataFrame) -> Column:
    """All columns of `df` as one struct, so that working columns can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unpack(df: DataFrame, struct: str, columns: list[str]) -> list[Column]:
    return [F.col(struct).getField(c).alias(c) for c in columns]
