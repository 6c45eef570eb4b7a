"""Records of what operations and streams did: rows, sums, time taken, errors."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from turnmill.sources.shared import shared_folder

SCHEMA = (
    "kind string, op string, adapter string, at double, predicted_cents double, predicted_ms double, observed_ms double, "
    "observed_cents double, batch long, rows long, metrics map<string,double>, meta string, success boolean, error string"
)
#: Characters of an error's text that are recorded.
ERROR = 500


@dataclass
class Operation:
    """A running operation: what it writes goes through `watch`, its costs into `observed_cents`, all else into `meta`."""

    op: str
    adapter: str
    observed_cents: float | None = None
    meta: dict = field(default_factory=dict)
    observation: Observation | None = None

    def watch(self, rows: DataFrame, **metrics: Column) -> DataFrame:
        """`rows`, counted as an action of the operation reads them; further `metrics` are aggregates."""
        self.observation = Observation()
        return rows.observe(self.observation, F.count(F.lit(1)).alias("rows"), *[v.alias(k) for k, v in metrics.items()])


class Probe:
    """Keeps records and appends them to a table in the shared folder."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or shared_folder(spark, "probe")
        self._held: list[dict] = []
        self._lock = threading.Lock()

    def add(self, **record) -> None:
        with self._lock:
            self._held.append({"at": time.time()} | record)

    @contextmanager
    def operation(self, op: str, adapter: str, *, predicted_cents: float = 0.0, predicted_ms: float = 0.0, **meta) -> Iterator[Operation]:
        """Times what is done inside; an error is recorded and goes on."""
        own, start, error = Operation(op, adapter, meta=dict(meta)), time.perf_counter(), None
        try:
            yield own
        except Exception as e:
            error = e
            raise
        finally:
            seen = dict(own.observation.get) if own.observation is not None and error is None else {}
            self.add(
                kind="operation", op=op, adapter=adapter, predicted_cents=float(predicted_cents), predicted_ms=float(predicted_ms),
                observed_ms=(time.perf_counter() - start) * 1000, observed_cents=None if own.observed_cents is None else float(own.observed_cents), rows=seen.pop("rows", None),
                metrics={k: float(v) for k, v in seen.items() if v is not None}, meta=json.dumps(own.meta), success=error is None,
                error=None if error is None else f"{type(error).__name__}: {error}"[:ERROR],
            )

    def listen(self) -> "StreamProbe":
        return StreamProbe(self)

    def flush(self) -> None:
        """Appends what is held to the table."""
        with self._lock:
            held, self._held = self._held, []
        if held:
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            self.spark.createDataFrame([tuple(r.get(c) for c in names) for r in held], SCHEMA).write.mode("append").parquet(f"{self.folder}/records")

    def records(self) -> DataFrame:
        self.flush()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/records")


class StreamProbe(StreamingQueryListener):
    """Records each micro-batch of every stream while it is used as a context, with the metrics that the stream observes
    (rows.observe(name, ...)), and how the stream ended."""

    def __init__(self, probe: Probe):
        self.probe = probe
        self._names: dict[str, str] = {}
        self._ended: dict[str, threading.Event] = {}

    def __enter__(self) -> "StreamProbe":
        self.probe.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self.probe.spark.streams.removeListener(self)

    def _end(self, run: str) -> threading.Event:
        return self._ended.setdefault(run, threading.Event())

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Until the stream has ended and all of its records are here; the stream's own error is recorded, not raised."""
        try:
            query.awaitTermination()
        except Exception:  # noqa: BLE001  (onQueryTerminated records it)
            pass
        if not self._end(str(query.runId)).wait(seconds):
            raise TimeoutError("no word of the stream's end")

    def onQueryStarted(self, event) -> None:
        self._names[str(event.runId)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        for name, row in p.observedMetrics.items() or [("", None)]:
            seen = {k: float(v) for k, v in (row.asDict() if row is not None else {}).items() if v is not None}
            self.probe.add(
                kind="batch", op=p.name or str(p.id), adapter=name, batch=p.batchId, rows=p.numInputRows,
                observed_ms=float(p.durationMs.get("triggerExecution", 0)), metrics=seen, success=True,
            )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = str(event.runId)
        error = event.exception
        self.probe.add(kind="stream", op=self._names.get(run, run), success=error is None, error=error and error[:ERROR])
        self._end(run).set()
