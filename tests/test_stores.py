"""Round trips of files, backends and their registry, ranks and totals in bins, recency stores."""

import json
import random

import pytest
from pyspark.sql import functions as F

from turnmill.functions import text as T
from turnmill.operators import backends, labelling, metrics, models, policies, retrieval, sessions
from turnmill.operators.prefix import group_ranks, running_total
from turnmill.sources import files, generators, sinks
from turnmill.sources.tables import turns
from turnmill.streaming import sessions as streams

SF = "/root/testdata/sf0.001"


def test_appended_items_read_back_and_are_pruned(spark, tmp_path):
    rows = [(str(i), f"text {i}", f"2025-08-{i + 1:02d} 10:00:00", "s" if i % 2 else None) for i in range(20)]
    frame = spark.createDataFrame(rows, "id string, content string, t string, session_id string")
    items = frame.select("id", "content", F.col("t").cast("timestamp").alias("timestamp"), "session_id")
    sinks.append_items(items, str(tmp_path))
    back = files.read_appended(spark, str(tmp_path))
    assert {(r["id"], r["content"], str(r["day"]), r["session_id"]) for r in back.collect()} == {
        (i, c, t[:10], s or "default") for i, c, t, s in rows
    }
    recent = files.recent_items(back, "2025-08-20", 3)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    assert {r["id"] for r in recent.collect()} == {"17", "18", "19"}


def test_only_recent_day_folders_are_read(spark, tmp_path):
    for day in ("2025/08/01", "2025/08/19", "2025/08/20"):
        folder = tmp_path / day
        folder.mkdir(parents=True)
        (folder / "s.jsonl").write_text(json.dumps({"id": day, "content": "x"}) + "\n")
    (tmp_path / "2025/08/20/empty.jsonl").write_text("")
    items = files.read_items(spark, str(tmp_path), "2025-08-20", 5)
    assert {r["id"] for r in items.collect()} == {"2025/08/19", "2025/08/20"}
    assert not [f for f in items.inputFiles() if "2025/08/01" in f]
    assert files.read_items(spark, str(tmp_path), "2024-01-01").count() == 0
    stats = files.file_statistics(spark, str(tmp_path)).first()
    assert (stats["n_files"], stats["n_lines"]) == (4, 3)


def test_events_models_and_labelled_samples_are_written(spark, tmp_path):
    events = spark.createDataFrame([(1.0, "store", "a")], "ts double, op string, adapter string")
    for _ in range(2):
        sinks.append_events(events, str(tmp_path / "telemetry"))
    assert files.read_telemetry(spark, str(tmp_path / "telemetry")).count() == 2
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    running = sinks.stream_events(stream, str(tmp_path / "stream"))
    running.processAllAvailable()
    running.stop()
    assert files.read_telemetry(spark, str(tmp_path / "stream/events")).count() == 1
    sinks.write_labelled(spark.createDataFrame([("t", True), ("u", False)], "turn_id string, success boolean"), str(tmp_path / "labelled"))
    assert [r["turn_id"] for r in spark.read.json(str(tmp_path / "labelled")).where("success = 'true'").collect()] == ["t"]
    frame = spark.createDataFrame([("red fish swims",), ("red fish sleeps",), ("old dog",)], "content string")
    fitted = models.tfidf_pipeline().fit(frame)
    sinks.save_model(fitted, str(tmp_path / "model"))
    again = sinks.load_model(str(tmp_path / "model"))
    assert [r["tfidf"] for r in again.transform(frame).collect()] == [r["tfidf"] for r in fitted.transform(frame).collect()]


def test_golden_training_and_csv_sets_read_back(spark, tmp_path):
    sinks.freeze(generators.golden(spark.range(8)), str(tmp_path / "golden"))
    assert files.read_golden(spark, str(tmp_path / "golden")).count() == 32
    one = files.read_golden(spark, str(tmp_path / "golden"), "semantic_search").collect()
    assert len(one) == 8 and all(r["id"].startswith("S") for r in one)
    rows = spark.createDataFrame([("t", 1, "store", [0.5])], "text string, label int, action string, context_features array<double>")
    sinks.export_training(rows, str(tmp_path / "training"))
    assert [tuple(r) for r in files.read_training(spark, str(tmp_path / "training")).collect()] == [("t", 1, "store", [0.5])]
    (tmp_path / "p.csv").write_text("persona,age\nann,3\nbob,x\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "p.csv"), "persona string, age int").collect()] == [("ann", 3)]


def test_cost_configuration(spark):
    assert files.read_cost_config(None) == {} and files.read_cost_config("") == {}
    text = "storage: {a: {write: '${PRICE:0.5}'}}\nretrieval: {a: {read: 0.1}, b: {}}\nprocessing: {maintenance: {gc: 0.3}}"
    got = {(r["backend"], r["op"]): r for r in files.cost_coefficients(spark, files.read_cost_config(text)).collect()}
    assert set(got) == {(b, o) for b in "ab" for o in ("store", "retrieve")}
    assert got["a", "store"]["write"] == 0.5 and got["a", "store"]["gc_maint"] == 0.3 and got["b", "store"]["write"] == 0.05
    config = {"aliases": {"mem": "memory_store"}, "adapters": [{"name": "x", "type": "mem"}]}
    assert files.backends(spark, config).first()["kind"] == "memory_store"


def test_backends_and_registry(spark, tmp_path):
    registry = backends.default_registry()
    assert registry.names() == ["file_store", "memory_store"]
    with pytest.raises(ValueError):
        registry.register("file_store", None, [])
    with pytest.raises(KeyError):
        registry.create(spark, "none", "x")
    with pytest.raises(KeyError):
        registry.get("memory_store")
    rows = [(1, "red fish", "user", {"city": "Rome"}, 0), (2, "blue fish", "user", None, 3), (3, "old dog", "assistant", None, 1)]
    items = spark.createDataFrame(rows, backends.STORED)
    asked = spark.createDataFrame([(1, "red fish"), (2, "")], "query_id int, query string")
    for name in registry.names():
        store = registry.create(spark, name, str(tmp_path / name))
        assert registry.get(name) is store and store.count() == 0
        store.store(items.where("item_id < 3"))
        store.store(items.where("item_id = 3"))
        assert store.count() == 3 and store.statistics().first()["total_items"] == 3
        found = store.retrieve(asked, 3).orderBy("rank").collect()
        assert found[0]["item_id"] == 1 and {r["query_id"] for r in found} == {1}
        # The one keeps items that score 0, the other doesn't; a key that is missing fails strict filters only.
        assert len(found) == (3 if name == "memory_store" else 2)
        near = store.retrieve(asked, 3, {"city": "Rome"}).collect()
        assert {r["item_id"] for r in near} == ({1} if name == "memory_store" else {1, 2})
        store.clear()
        assert store.count() == 0
    assert {r["backend"] for r in registry.table(spark).collect()} == set(registry.names())
    registry.clear()
    assert registry.names() == []


def test_unmatched_items_fill_up_to_k(spark):
    items = spark.createDataFrame([(3, "red fish"), (1, "old dog"), (2, None), (4, ""), (5, "red cat")], "doc_id int, content string")
    asked = spark.createDataFrame([(1, "red"), (2, "unknown"), (3, ""), (4, None)], "query_id int, query string")
    got = {}
    for r in retrieval.tfidf_top_k(items, asked, 4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["doc_id"], r["score"] > 0)
    assert got == {1: {1: (3, True), 2: (5, True), 3: (1, False), 4: (2, False)}, 2: {i: (i, False) for i in range(1, 5)}}
    assert retrieval.tfidf_top_k(items.limit(0), asked, 4).count() == 0


def test_totals_and_ranks_in_bins_equal_plain_ones(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.randint(0, 9), rng.choice([-3.5, 0.0, 1e-3, 2.0, 1e9, rng.gauss(0, 5)])) for i in range(500)]
    frame = spark.createDataFrame(rows, "i long, g string, n int, v double")
    got = {r["i"]: r["t"] for r in running_total(frame, "i", F.col("n"), "t", width=7).collect()}
    assert all(got[i] == sum(r[2] for r in rows[:i]) for i in range(500))
    ranked = group_ranks(frame, "g", F.md5(F.col("i").cast("string").cast("binary")), "i", "r", "size").collect()
    for g in ("a", "b", None):
        own = [r for r in ranked if r["g"] == g]
        assert sorted(r["r"] for r in own) == list(range(1, len(own) + 1)) and {r["size"] for r in own} == {len(own)}
    by = {}
    for r in metrics.ranked_values(frame, "g", "v").collect():
        by.setdefault(r["g"], []).append(r)
    for g, own in by.items():
        values = sorted(r[3] for r in rows if r[1] == g)
        assert {(r["v"], r["c"], r["before"], r["n"]) for r in own} == {(v, values.count(v), values.index(v), len(values)) for v in values}


def test_recently_used_items_survive(spark):
    def left(ops, capacity=3):
        rows = [(1, i, op, item, None if op == "store" else item_list) for i, (op, item, item_list) in enumerate(ops)]
        frame = spark.createDataFrame(rows, "session_id int, seq int, op string, item_id long, passes array<long>")
        return {r["item_id"] for r in sessions.lru_trace(frame, capacity).collect()}

    stores = [("store", i, None) for i in range(5)]
    assert left(stores) == {2, 3, 4}
    assert left([*stores[:3], ("retrieve", None, [0]), *stores[3:]]) == {0, 3, 4}
    assert left([*stores[:3], ("retrieve", None, [1, 0]), *stores[3:]]) == {1, 3, 4}  # touched in the order they came
    assert left([]) == set()


def test_labelling_rules(spark):
    texts = ["Thanks!", "My {name} goes with me here", "What do you prefer on a normal Monday", "a node that connects to every other node", "x y z w " * 40, "five words on other matters"]
    expected = ["discard", "keyvalue", "vector", "graph", "summary", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["c"] for r in frame.select("i", labelling.template_class(F.col("t")).alias("c")).collect()}
    assert [got[i] for i in range(6)] == [f"{x}_candidate" if x else "unknown" for x in expected]
    more = labelling.augmented(frame, "t", "i", share=1.0)
    assert more.count() == 12 and more.where("augmented").count() == 6


def test_summarized_turns_get_a_summary(spark, tmp_path):
    rows = turns(spark, SF).withColumn("action", F.when(F.col("turn_no") == 0, "summarize").otherwise("store")).withColumn("backend", F.lit("b"))
    rows = rows.withColumn("content", F.when(F.col("turn_no") == 0, F.repeat(F.lit("One sentence here. "), 60)).otherwise(F.col("content")))
    sinks.executed(rows, str(tmp_path / "done"))
    back = sinks.read_executed(spark, str(tmp_path / "done"))
    assert back.where("action = 'summarize' and (summary is null or length(summary) >= length(content))").count() == 0
    assert back.where("action = 'store' and summary is not null").count() == 0


def test_windows_close_and_late_rows_go(spark, tmp_path):
    rows = [("op", "2025-01-01 10:05:00", 1.0), ("op", "2025-01-01 10:25:00", 2.0), ("op", "2025-01-01 15:00:00", 3.0)]
    late = [("op", "2025-01-01 10:30:00", 9.0), ("op", "2025-01-01 20:00:00", 4.0)]
    kind = "op string, t string, observed_ms double"
    for i, part in enumerate((rows, late)):
        spark.createDataFrame(part, kind).select("op", F.col("t").cast("timestamp").alias("ts"), "observed_ms").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("op string, ts timestamp, observed_ms double").parquet(str(tmp_path / "in"))
        writer = streams.windowed_telemetry(stream).writeStream.outputMode("append").format("parquet")
        writer.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {(str(r["window_start"])[11:13], r["n"], r["total"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("10", 2, 3.0), ("15", 1, 3.0)}


def test_date_path(spark):
    assert spark.range(1).select(T.date_path(F.lit("2025-08-06").cast("date"))).first()[0] == "2025/08/06"
    assert policies.CLASS_NAMES[2] == "Vector"
