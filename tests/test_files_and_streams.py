"""File formats, sinks, configuration and streams."""

import json

import pytest
from pyspark.sql import functions as F

from turnmill.operators import models, policies, sessions
from turnmill.sources import files, generators, sinks
from turnmill.sources.tables import turns
from turnmill.streaming import sessions as streams


def test_item_files_skip_bad_lines(spark, tmp_path):
    for day, name in (("2025/08/01", "s1"), ("2025/08/20", "s2")):
        folder = tmp_path / day
        folder.mkdir(parents=True)
        item = {"id": name, "content": f"text of {name}", "metadata": {"a": "b"}, "timestamp": "2025-08-01T10:00:00", "speaker": "user"}
        (folder / f"{name}.jsonl").write_text(json.dumps(item) + "\n\nnot json\n")
    items = files.read_items(spark, str(tmp_path))
    assert {(r["id"], str(r["day"]), r["session_id"]) for r in items.collect()} == {("s1", "2025-08-01", "s1"), ("s2", "2025-08-20", "s2")}
    recent = files.recent_items(items, "2025-08-21", 7).collect()
    assert [(r["id"], r["days_back"]) for r in recent] == [("s2", 1)]
    stats = files.file_statistics(spark, str(tmp_path)).first()
    assert (stats["n_files"], stats["n_lines"]) == (2, 6)


def test_append_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("1", "hello", "2025-08-01 10:00:00", None)], "id string, content string, t string, session_id string")
    items = rows.select("id", "content", F.col("t").cast("timestamp").alias("timestamp"), "session_id")
    for _ in range(2):
        sinks.append_items(items, str(tmp_path / "items"))
    back = spark.read.json(str(tmp_path / "items"))
    assert back.count() == 2 and {r["session_id"] for r in back.collect()} == {"default"}


def test_traces_and_prices(spark, tmp_path):
    good = {"event_type": "store", "adapter_name": "memory_store", "success": True, "latency_ms": 0.5}
    (tmp_path / "trace.jsonl").write_text(json.dumps(good) + "\nbroken\n")
    assert [r["latency_ms"] for r in files.read_traces(spark, str(tmp_path / "trace.jsonl")).collect()] == [0.5]
    book = {"entries": {"a|store": {"write": 1.0, "p50_ms": 2.0}, "b|summarize|model=x": {"base_cents": 3}}}
    (tmp_path / "book.json").write_text(json.dumps(book, indent=1))
    got = {(r["backend"], r["op"]): r for r in files.read_pricebook(spark, str(tmp_path / "book.json")).collect()}
    assert got["a", "store"]["write"] == 1.0 and got["a", "store"]["model"] is None
    assert got["b", "summarize"]["model"] == "x" and got["b", "summarize"]["base_cents"] == 3


def test_research_formats(spark, tmp_path):
    chapters = {"chapters": [{"chapter_id": "c1", "events": [{"content": "x", "entities": ["A"]}, {"content": "y"}]}], "qa_pairs": [{"question": "q", "answer": ["A"]}]}
    (tmp_path / "e.json").write_text(json.dumps(chapters))
    events, pairs = files.read_chapters(spark, str(tmp_path / "e.json"))
    assert [(r["position"], r["content"]) for r in events.orderBy("position").collect()] == [(0, "x"), (1, "y")]
    assert pairs.first()["answer"] == ["A"]
    hay = [{"question_id": "q1", "haystack_sessions": [[{"role": "user", "content": "a"}], [{"role": "user", "content": "b"}]], "haystack_dates": ["d1"]}]
    (tmp_path / "h.json").write_text(json.dumps(hay))
    got = {(r["session"], r["content"], r["date"]) for r in files.read_haystacks(spark, str(tmp_path / "h.json")).collect()}
    assert got == {(0, "a", "d1"), (1, "b", None)}
    labeled = [{"success": True, "turn_id": "t", "turn_data": {"content": "x"}, "label": {"routing_class": 1}}, {"success": False, "turn_id": "u"}]
    (tmp_path / "l.json").write_text(json.dumps(labeled))
    assert [r["turn_id"] for r in files.read_labeled(spark, str(tmp_path / "l.json")).collect()] == ["t"]


def test_configuration(spark):
    env = {"HOME_DIR": "/x"}
    assert files.expand({"a": ["${HOME_DIR}/y", "${NONE:z}"], "n": 3}, env) == {"a": ["/x/y", "z"], "n": 3}
    assert files.overridden({"port": 1, "host": "h"}, "APP_", {"APP_PORT": "2"}) == {"port": "2", "host": "h"}
    config = {"adapters": [{"name": "m", "type": "memory"}, {"name": "off", "enabled": False}]}
    assert [r["name"] for r in files.backends(spark, config).collect()] == ["m"]
    with pytest.raises(ValueError):
        files.backends(spark, {"adapters": [{"type": "memory"}]})


def test_golden_sets_freeze(spark, tmp_path):
    golden = generators.golden(spark.range(64))
    assert golden.count() == 256 and golden.select("id").distinct().count() == 256
    manifest = sinks.freeze(golden, str(tmp_path / "golden")).collect()
    frame = spark.createDataFrame(manifest, "stratum string, sha256 string")
    assert sinks.changed(frame, sinks.freeze(golden, str(tmp_path / "again"))).count() == 0
    other = golden.withColumn("content", F.when(F.col("id") == "F3", "changed").otherwise(F.col("content")))
    assert [r["stratum"] for r in sinks.changed(frame, sinks.freeze(other, str(tmp_path / "other"))).collect()] == ["factual_lookup"]


def test_results_and_exports(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1.0, {"store": 3})], "policy string, cost double, routes map<string,int>")
    sinks.write_results(rows, str(tmp_path))
    assert spark.read.option("header", "true").csv(str(tmp_path / "pareto")).columns == ["policy", "cost"]
    sinks.export_training(rows, str(tmp_path / "export"))
    assert json.loads(spark.read.option("header", "true").csv(str(tmp_path / "export/csv")).first()["routes"]) == {"store": 3}
    sinks.replace(rows.limit(0), str(tmp_path / "cleared"))
    assert spark.read.parquet(str(tmp_path / "cleared")).count() == 0


def test_executed_decisions(spark, tmp_path):
    routed = policies.routed(turns(spark, "/root/testdata/sf0.001"))
    sinks.executed(routed, str(tmp_path / "done"))
    assert sinks.read_executed(spark, str(tmp_path / "done")).count() == routed.count()


def test_streamed_ledger_over_several_batches_equals_batch(spark, tmp_path):
    source = turns(spark, "/root/testdata/sf0.001").select("session_id", "turn_no", (F.length("content") / 5000).alias("c"))
    batch = {tuple(r) for r in sessions.budget_ledger(source, F.col("c")).collect()}
    for low, high in ((0, 2), (2, 4), (4, 100)):  # later turns arrive later
        source.where((F.col("turn_no") >= low) & (F.col("turn_no") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
        writer = streams.budget_ledger(stream, F.col("c")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check"))
        writer.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("session_id", "turn_no", "cost", "accepted", "spent")
    assert {tuple(r) for r in got.collect()} == batch


def test_activity_sessions(spark, tmp_path):
    rows = [(1, "2025-01-01 10:00:00"), (1, "2025-01-01 10:10:00"), (1, "2025-01-01 12:00:00"), (2, "2025-01-01 10:00:00")]
    frame = spark.createDataFrame(rows, "session_id int, t string").select("session_id", F.col("t").cast("timestamp").alias("ts"))
    got = sorted((r["session_id"], r["n"]) for r in streams.activity_sessions(frame).collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_tfidf_pipeline(spark):
    frame = spark.createDataFrame([("red fish swims",), ("red fish sleeps",), ("old dog",)], "content string")
    model = models.tfidf_pipeline().fit(frame)
    assert "tfidf" in model.transform(frame).columns
