"""Streams with state by key: prices refitted from samples, and the context of sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from turnmill.functions import constants as C
from turnmill.sources.shared import shared_folder

#: Newest samples that a key keeps, how many make it refit, and the turns of a session that its context holds.
KEEP, REFIT, RECENT = 10_000, 200, 10
#: Samples in one element of a key's list.
CHUNK = 1000
#: How long a session's context is kept after its last turn.
DAY_MS = 24 * 3600 * 1000


def needs_state_store(spark: SparkSession) -> None:
    """State of several kinds by key is kept in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def replay(rows: DataFrame, at: Column, slices: int, run: Callable[[DataFrame, str], StreamingQuery], name: str) -> str:
    """Feeds `rows` to a stream in about `slices` micro-batches, in the order of the number `at` (nulls first); rows of
    equal `at` go together. `run` gets the stream and a folder, and starts it on what is there. Returns the folder."""
    spark = rows.sparkSession
    folder = shared_folder(spark, name)
    numbered = rows.withColumn("_at", at.cast("double"))
    shares = [k / slices for k in range(1, slices)]
    cuts = sorted(set(numbered.approxQuantile("_at", shares, 0.01))) if shares else []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = numbered.where(F.col("_at") >= low) if low is not None else numbered
        if high is not None:
            below = F.col("_at") < high
            part = part.where(below | F.col("_at").isNull() if low is None else below)
        part.drop("_at").write.mode("append").parquet(f"{folder}/input")
        run(spark.readStream.schema(rows.schema).parquet(f"{folder}/input"), folder).awaitTermination()
    return folder


# --- prices -------------------------------------------------------------------------------------------------------

COEFFICIENTS = ["write", "read", "index_maint", "gc_maint", "storage_month", "base_cents", "per_token_micros", "per_k_cents", "p50_ms", "p95_ms"]
_SAMPLE = ["op", "observed_cents", "observed_ms", "n_tokens", "k"]


def fit(samples: pd.DataFrame) -> dict[str, float]:
    """The coefficients of `metrics.fitted_coefficients` for one key's samples, which a buffer bounds."""
    priced = samples[samples["observed_cents"].notna()]
    cost = priced["observed_cents"].to_numpy(float)
    middle = float(np.median(cost)) if len(cost) else 0.0
    base = float(np.rint(middle))
    tokens = priced["n_tokens"].to_numpy(float)
    some = tokens > 0
    extra = np.maximum(0.0, cost[some] - base) / (tokens[some] + 1e-6)
    per_k = cost / (np.fmax(1.0, priced["k"].to_numpy(float)) + 1e-6)

    def of(op: str, other: float) -> float:
        own = cost[(priced["op"] == op).to_numpy()]
        return float(np.median(own)) if len(own) else other if len(cost) else 0.0

    ms = np.sort(samples["observed_ms"].dropna().to_numpy(float))
    n = len(ms)
    p50, p95 = (float(np.median(ms)), float(ms[-1])) if n else (C.P50_MS, C.P95_MS)
    if n == 1:
        p95 = 1.5 * p50
    elif n >= 20:
        j = min(max(19 * (n + 1) // 20, 1), n - 1)
        over = 19 * (n + 1) - 20 * j
        p95 = (ms[j - 1] * (20 - over) + ms[j] * over) / 20
    return {
        "write": of("store", C.WRITE),
        "read": of("retrieve", C.READ),
        "index_maint": min(0.02, middle * 0.1),
        "gc_maint": min(0.01, middle * 0.05),
        "storage_month": min(0.005, middle * 0.02),
        "base_cents": base,
        "per_token_micros": float(np.rint(np.median(extra) * 1e6)) if len(extra) else 0.0,
        "per_k_cents": float(np.median(per_k)) if len(per_k) else 0.0,
        "p50_ms": p50,
        "p95_ms": float(p95),
    }


class _Refit(StatefulProcessor):
    """Keeps a key's newest samples as a list; as soon as there are enough, fits them and starts again."""

    def __init__(self, order: list[str], keep: int, enough: int):
        self.order, self.keep, self.enough = order, keep, enough

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Chunks of samples, a column an array: a list of single ones would cross to this worker one by one.
        chunk = "op array<string>, " + ", ".join(f"{c} array<double>" for c in _SAMPLE[1:])
        self.samples = handle.getListState("samples", chunk)
        self.version = handle.getValueState("version", "version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version = self.version.get()[0] if self.version.exists() else 0
        chunks = [pd.DataFrame(dict(zip(_SAMPLE, chunk, strict=True))) for chunk in self.samples.get()] if self.samples.exists() else []
        held = pd.concat(chunks) if chunks else pd.DataFrame(columns=_SAMPLE)
        # One key's rows of one micro-batch, whose size the trigger bounds.
        came = pd.concat(rows).sort_values(self.order, kind="stable")[_SAMPLE]
        fitted = []
        while len(came):
            room = self.enough - len(held)
            held = (pd.concat([held, came[:room]]) if len(held) else came[:room])[-self.keep :]
            came = came[room:]
            if len(held) < self.enough:
                break
            version += 1
            fitted.append({"key": key[0], "version": version, "samples": len(held)} | fit(held))
            held = held[:0]
        self.version.update((version,))
        self.samples.clear()
        clean = held.astype(object).where(held.notna(), None)
        for low in range(0, len(clean), CHUNK):
            self.samples.appendValue(tuple(clean[c][low : low + CHUNK].tolist() for c in _SAMPLE))
        if fitted:
            yield pd.DataFrame(fitted)

    def close(self) -> None:
        pass


def refits(samples: DataFrame, key: str, order: list[str], *, keep: int = KEEP, enough: int = REFIT) -> DataFrame:
    """(key, version, samples, coefficients): a row each time that a key of the stream `samples` has `enough` new samples.

    `samples` has op, observed_cents, observed_ms, n_tokens and k. A key keeps its newest `keep` samples and forgets them
    when they have been fitted; its versions count from 1. A micro-batch's rows of a key are taken by `order`.
    """
    if keep < enough:
        raise ValueError("a buffer smaller than the threshold never refits")
    needs_state_store(samples.sparkSession)
    rows = samples.select(F.col(key).cast("string").alias("key"), *order, "op", *[F.col(c).cast("double").alias(c) for c in _SAMPLE[1:]])
    out = "key string, version long, samples long, " + ", ".join(f"{c} double" for c in COEFFICIENTS)
    return rows.groupBy("key").transformWithStateInPandas(_Refit(order, keep, enough), out, "append", "none")


class PriceTables:
    """Prices by key in versions that are written whole and then swapped in, so that a reader sees one version or the next.

    `current` names the version that counts. It is a file that a rename replaces in one step.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._jvm = spark._jvm

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("current").getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def version(self) -> int | None:
        if not self._files().exists(self._path("current")):
            return None
        return int(self.spark.read.text(f"{self.folder}/current").first()[0])

    def read(self, version: int | None = None) -> DataFrame | None:
        """The prices of a version, or of the one that counts now; None before there is one."""
        version = self.version() if version is None else version
        return None if version is None else self.spark.read.parquet(f"{self.folder}/version={version}")

    def swap(self, refitted: DataFrame, number: int) -> None:
        """Version `number`: the prices that count, with those of `refitted` keys in place of the old ones. Doing it again
        gives the same, as it must after a lost batch."""
        newest = refitted.groupBy("key").agg(F.max_by(F.struct("version", *COEFFICIENTS), "version").alias("x")).select("key", "x.*")
        before = self.version()
        if before == number:
            return
        if before is not None:
            old = self.read(before)
            newest = newest.unionByName(old.join(newest.select("key"), "key", "left_anti"))
        newest.write.mode("overwrite").parquet(f"{self.folder}/version={number}")
        files = self._files()
        fresh = self._path(f"current-{number}")
        stream = files.create(fresh, True)
        stream.write(bytearray(f"{number}\n".encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), files.getConf())
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(fresh, self._path("current"), options)


def refit_stream(stream: DataFrame, folder: str, key: str, order: list[str], *, enough: int = REFIT) -> StreamingQuery:
    """Starts refitting on what is there: refits go to `folder`/refits, prices to versions in `folder`/prices."""
    prices = PriceTables(stream.sparkSession, f"{folder}/prices")

    def write(batch: DataFrame, number: int) -> None:
        path = f"{folder}/refits/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        done = batch.sparkSession.read.schema(batch.schema).parquet(path)
        if not done.isEmpty():
            prices.swap(done, number)

    writer = refits(stream, key, order, enough=enough).writeStream.foreachBatch(write)
    return writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


# --- sessions -----------------------------------------------------------------------------------------------------


class _Context(StatefulProcessor):
    """A session's turn count, start and end as a value, its newest turns as a list, and a timer that ends both."""

    def __init__(self, recent: int, keep_ms: int):
        self.recent_turns, self.keep_ms = recent, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "turns long, began double, expires long")
        self.recent = handle.getListState("recent", "item_id long, speaker string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns, began, expires = self.session.get() if self.session.exists() else (0, None, None)
        newest = list(self.recent.get()) if expires else []
        # One session's turns of one micro-batch, whose size the trigger bounds.
        came = pd.concat(rows).sort_values(["turn_no", "item_id"], kind="stable", na_position="first")
        counts, minutes, before = [], [], []
        for item, speaker, seconds in zip(came["item_id"], came["speaker"], came["seconds"], strict=True):
            began = seconds if began is None else min(began, seconds)
            counts.append(turns)
            minutes.append((seconds - began) / 60.0)
            before.append([i for i, _ in newest])
            newest = [*newest, (None if pd.isna(item) else int(item), speaker)][-self.recent_turns :]
            turns += 1
        later = max(expires or 0, int(came["seconds"].max() * 1000) + self.keep_ms)
        if later != expires:
            if expires:
                self.handle.deleteTimer(expires)
            self.handle.registerTimer(later)
        self.session.update((turns, float(began), later))
        self.recent.put(newest)
        yield came.drop(columns="seconds").assign(turn_count=counts, minutes=minutes, recent=before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.session.clear()
        self.recent.clear()
        yield from ()

    def close(self) -> None:
        pass


def session_context(turns: DataFrame, *, recent: int = RECENT, keep_ms: int = DAY_MS, late: str = "1 hour") -> DataFrame:
    """The stream `turns` (session_id, turn_no, speaker, content, item_id, ts) with turn_count (earlier turns of the session),
    minutes (since its first) and recent (the items of the newest `recent` turns before).

    A session's state is a count, two times and that list. It goes when the stream's time, which is `late` behind its
    newest turn, is `keep_ms` past the session's last turn; a turn after that begins anew, and a turn behind the stream's
    time is left out. Sessions are worked on apart, a micro-batch's turns of a session by number.
    """
    needs_state_store(turns.sparkSession)
    ts = F.col("ts").cast("timestamp")
    rows = turns.select("session_id", "turn_no", "speaker", "content", "item_id", ts.alias("ts"), ts.cast("double").alias("seconds"))
    rows = rows.withWatermark("ts", late)
    out = "session_id long, turn_no long, speaker string, content string, item_id long, ts timestamp, turn_count long, minutes double, recent array<long>"
    return rows.groupBy("session_id").transformWithStateInPandas(_Context(recent, keep_ms), out, "append", "EventTime")
