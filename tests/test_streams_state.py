"""Streams with state by key, versions of prices, and the probe."""

import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from turnmill.operators import metrics
from turnmill.sources.shared import shared_folder
from turnmill.streaming import probe, state

SAMPLES = "n long, backend string, op string, observed_cents double, observed_ms double, n_tokens long, k int"


def sample_rows(n, backend="b"):
    return [(i, backend, "store" if i % 2 else "retrieve", None if i % 5 == 0 else float(i % 13), float(i % 97) if i % 11 else None, i % 50, i % 7 or None) for i in range(n)]


def test_fit_equals_the_batch_coefficients(spark):
    for n in (1, 2, 19, 20, 57, 200):
        rows = sample_rows(n + 3)[3:]
        df = spark.createDataFrame(rows, SAMPLES)
        want = metrics.fitted_coefficients(df, "backend").first()
        got = state.fit(pd.DataFrame(rows, columns=df.columns))
        for name in state.COEFFICIENTS:
            assert got[name] == pytest.approx(want[name], abs=1e-9), (n, name)


def test_refits_do_not_depend_on_how_rows_arrive(spark):
    rows = sample_rows(95, "b") + [(i, "few", "store", 1.0, 1.0, 1, 1) for i in range(29)]
    df = spark.createDataFrame(rows, SAMPLES)
    found = []
    for slices in (1, 5):
        folder = state.replay(df, F.col("n"), slices, lambda s, f: state.refit_stream(s, f, "backend", ["n"], enough=30), "refits")
        got = spark.read.parquet(f"{folder}/refits").drop("batch").orderBy("key", "version").collect()
        prices = state.PriceTables(spark, f"{folder}/prices")
        current = prices.read().collect()
        assert [(r["key"], r["version"]) for r in current] == [("b", 3)]
        found.append(got)
    assert found[0] == found[1] and [r["version"] for r in found[0]] == [1, 2, 3]
    third = pd.DataFrame(sample_rows(90)[60:], columns=df.columns)
    assert found[0][2]["p50_ms"] == state.fit(third)["p50_ms"]
    with pytest.raises(ValueError, match="never refits"):
        state.refits(df, "backend", ["n"], keep=10, enough=30)


def test_readers_see_one_version_of_prices(spark):
    tables = state.PriceTables(spark, shared_folder(spark, "prices"))
    assert tables.version() is None and tables.read() is None
    schema = "key string, version long, " + ", ".join(f"{c} double" for c in state.COEFFICIENTS)

    def refit(version, *keys):
        return spark.createDataFrame([(k, version, *[float(version)] * len(state.COEFFICIENTS)) for k in keys], schema)

    tables.swap(refit(1, "a", "b"), 0)
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append(sorted((r["key"], r["version"]) for r in tables.read().collect()))

    reader = threading.Thread(target=read)
    reader.start()
    for number in range(1, 5):
        tables.swap(refit(number + 1, "a").unionAll(refit(number, "a")), number)  # the newest of several counts
        tables.swap(refit(99, "a"), number)  # a batch that comes again changes nothing
    stop.set()
    reader.join()
    assert tables.version() == 4 and sorted((r["key"], r["version"]) for r in tables.read().collect()) == [("a", 5), ("b", 1)]
    assert seen and all(rows in [[("a", v), ("b", 1)] for v in range(1, 6)] for rows in seen)


def test_sessions_keep_their_newest_turns_and_expire(spark):
    turns = [(s, n, "user", f"t{n}", 100 * s + n, 60.0 * n) for s in (1, 2) for n in range(14)]
    turns += [(1, 14, "user", "a day later", 114, 200_000.0), (2, 15, "user", "much later", 215, 400_000.0)]
    rows = spark.createDataFrame(turns, "session_id long, turn_no long, speaker string, content string, item_id long, s double")
    rows = rows.withColumn("ts", F.timestamp_seconds(F.col("s") + 1e6)).drop("s")

    def run(stream, folder):
        out = state.session_context(stream, keep_ms=3_600_000).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
        return out.trigger(availableNow=True).start(f"{folder}/rows")

    folder = shared_folder(spark, "context")
    for part in ("turn_no < 7", "turn_no BETWEEN 7 AND 13", "turn_no = 14", "turn_no = 15"):
        rows.where(part).write.mode("append").parquet(f"{folder}/input")
        run(spark.readStream.schema(rows.schema).parquet(f"{folder}/input"), folder).awaitTermination()
    got = {(r["session_id"], r["turn_no"]): r for r in spark.read.parquet(f"{folder}/rows").collect()}
    assert len(got) == 30
    assert [got[1, n]["turn_count"] for n in range(14)] == list(range(14))
    assert got[2, 13]["recent"] == [200 + n for n in range(3, 13)] and got[2, 13]["minutes"] == 13.0
    last = got[2, 15]
    assert (last["turn_count"], last["recent"], last["minutes"]) == (0, [], 0.0)  # its state had gone


def test_probe_records_operations_and_failures(spark):
    recorder = probe.Probe(spark)
    rows = spark.range(10).withColumn("v", F.col("id") * 2.0)
    with recorder.operation("store", "memory", predicted_cents=2, k=3) as own:
        own.observed_cents = 1.5
        own.watch(rows, total=F.sum("v")).write.format("noop").mode("overwrite").save()
    with pytest.raises(ZeroDivisionError), recorder.operation("retrieve", "files"):
        1 / 0
    got = {r["op"]: r for r in recorder.records().collect()}
    store, failed = got["store"], got["retrieve"]
    assert (store["rows"], store["metrics"], store["success"], store["error"], store["observed_cents"]) == (10, {"total": 90.0}, True, None, 1.5)
    assert store["observed_ms"] > 0 and store["predicted_cents"] == 2 and store["meta"] == '{"k": 3}'
    assert not failed["success"] and failed["error"].startswith("ZeroDivisionError") and failed["rows"] is None
    assert recorder.records().count() == 2  # what is flushed stays


def test_stream_probe_records_batches_and_the_batch_that_fails(spark):
    recorder = probe.Probe(spark)
    folder = shared_folder(spark, "probed")
    rows = spark.range(6).withColumn("bad", F.lit(False))

    def start():
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in").observe("seen", F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
        value = F.when(F.col("bad"), F.raise_error(F.lit("bad row"))).otherwise(F.col("id"))
        out = stream.withColumn("id", value).writeStream.format("parquet").queryName("probed").option("checkpointLocation", f"{folder}/c")
        return out.trigger(availableNow=True).start(f"{folder}/out")

    with recorder.listen() as listener:
        for bad in (False, True):
            rows.withColumn("bad", F.lit(bad)).write.mode("append").parquet(f"{folder}/in")
            listener.wait(start())
    records = recorder.records().where("op = 'probed'").orderBy("at").collect()
    batches = [r for r in records if r["kind"] == "batch" and r["rows"]]
    ends = [r for r in records if r["kind"] == "stream"]
    assert [(r["batch"], r["rows"], r["metrics"]) for r in batches] == [(0, 6, {"n": 6.0, "ids": 15.0})]
    assert [r["success"] for r in ends] == [True, False] and "bad row" in ends[1]["error"]
