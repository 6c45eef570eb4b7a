"""Session state and telemetry as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnmill.functions import constants as C
from turnmill.sources.shared import shared_folder


def windowed_telemetry(events: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts and sums per operation and window of `ts`; rows later than `late` are left out."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = events.withWatermark("ts", late).groupBy("op", w.alias("w"))
    found = grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("observed_ms").alias("total"), F.max("observed_ms").alias("slowest"))
    return found.select("op", F.col("w.start").alias("window_start"), "n", "total", "slowest")


def activity_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Each user's runs of events without a pause of `gap`."""
    grouped = events.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(session_id, window_start): one row for each session and window of `ts` in which it is active, as soon as it is.

    A pair is remembered until the stream's time, `late` behind its newest row, has passed the window by `late`; rows behind
    the stream's time are left out. Counting the rows of a window gives its active sessions.
    """
    start = F.window("ts", width)["start"]
    seen = events.select("session_id", start.alias("window_start")).withWatermark("window_start", late)
    return seen.dropDuplicatesWithinWatermark(["session_id", "window_start"])


def budget_ledger(
    turns: DataFrame, cost: Column, *, operation: float = C.OPERATION_LIMIT, session: float = C.SESSION_LIMIT,
    burst: float = C.BURST_LIMIT, hours: float = C.LEAST_HOURS,
) -> DataFrame:
    """(session_id, turn_no, cost, accepted, spent, turn_count) for a stream of turns: what a session spent is its state.

    A micro-batch's rows of a session are taken in turn order; only two numbers are kept.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, count = state.get if state.exists else (0.0, 0)
        rows = pd.concat(batches).sort_values("turn_no", kind="stable")  # one session's turns of one micro-batch
        accepted, totals, counts = [], [], []
        for value in rows["cost"]:
            fits = not pd.isna(value) and value <= operation and spent + value <= session and (spent + value) / hours <= burst
            spent += value if fits else 0.0
            accepted.append(fits)
            totals.append(spent)
            counts.append(count)
            count += 1
        state.update((spent, count))
        yield rows.assign(accepted=accepted, spent=totals, turn_count=counts)

    rows = turns.select("session_id", "turn_no", cost.cast("double").alias("cost"))
    out = "session_id long, turn_no long, cost double, accepted boolean, spent double, turn_count long"
    return rows.groupBy("session_id").applyInPandasWithState(
        run, out, "spent double, count long", "append", GroupStateTimeout.NoTimeout
    )


def run_to_table(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Runs a stream over what is there, to Parquet in the shared folder, and reads the result."""
    folder = shared_folder(spark, name)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_updates(stream: DataFrame, spark: SparkSession, name: str, keys: list[str]) -> DataFrame:
    """As run_to_table for an aggregate with a watermark: each batch appends the rows that it changed, and the newest of each
    key counts. Late rows and closed windows leave the state, which complete output would keep for ever."""
    folder = shared_folder(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(f"{folder}/rows")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
    writer.foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    found = spark.read.schema(schema).parquet(f"{folder}/rows")
    rest = [c for c in stream.columns if c not in keys]
    newest = found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("x"))
    return newest.select(*[F.col(c) if c in keys else F.col("x").getField(c).alias(c) for c in stream.columns])
