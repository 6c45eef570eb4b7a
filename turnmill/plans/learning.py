"""Streams and learned policies as queries; streams over what is there must agree with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.functions import constants as C
from turnmill.functions import text as T
from turnmill.functions.features import basic_text_features
from turnmill.operators import labelling, models, policies
from turnmill.plans.analysis import samples
from turnmill.plans import registry as R
from turnmill.plans.registry import DOCS, query
from turnmill.plans.registry import SQL as _SQL
from turnmill.sources.shared import shared_folder, written
from turnmill.sources.tables import documents, read, turns
from turnmill.streaming import sessions as streams
from turnmill.streaming import probe, state


def _stream(spark, sf_dir, name):
    """The table as a stream of files; the pattern lets one file stand for a folder."""
    schema = read(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


@query("SELECT event_type AS op, time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_hourly(spark, sf_dir):
    ts = F.col("ts").cast("timestamp").alias("ts")  # watermarks need a time zone
    events = _stream(spark, sf_dir, "events").select(ts, F.col("event_type").alias("op"), F.col("value").alias("observed_ms"))
    done = streams.run_updates(streams.windowed_telemetry(events), spark, "stream_hourly", ["op", "window_start"])
    return done.select("op", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", F.round("total", 6).alias("total"))


@query(_SQL["budget_ledger"])
def stream_ledger(spark, sf_dir):
    t = _stream(spark, sf_dir, "conversations")
    turns = t.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_no"), F.col("text").alias("content"))
    cost = F.lit(C.WRITE) + T.token_estimate(F.col("content")) * F.lit(C.PER_TOKEN) + F.lit(C.INDEX) / F.lit(30.0)
    return streams.run_to_table(streams.budget_ledger(turns, cost, session=0.25), spark, "stream_ledger").drop("turn_count")


_REFITS = """s AS (SELECT event_type AS key, ts, event_id, CASE WHEN event_id % 2 = 0 THEN 'store' ELSE 'retrieve' END AS op,
      CASE WHEN event_id % 3 <> 0 THEN round(value) / 10.0::DOUBLE END AS cents, value AS ms, user_id AS n_tokens, json_extract_string(props, '$.k')::INT AS k FROM events),
    g AS (SELECT *, (row_number() OVER (PARTITION BY key ORDER BY ts, event_id) - 1) // 200 + 1 AS version FROM s),
    m AS (SELECT key, version, count(*) AS samples, median(cents) FILTER (op = 'store') AS st, median(cents) FILTER (op = 'retrieve') AS re, median(cents) AS m,
      median(cents / (greatest(1, k) + 1e-6::DOUBLE)) AS per_k, median(ms) AS p50, list_sort(list(ms)) AS x FROM g GROUP BY key, version),
    e AS (SELECT g.key, g.version, median(greatest(0.0, cents - round_even(m, 0)) / (n_tokens + 1e-6::DOUBLE)) FILTER (n_tokens > 0 AND cents IS NOT NULL) AS extra
      FROM g JOIN m ON m.key = g.key AND m.version = g.version GROUP BY g.key, g.version),
    r AS (SELECT m.key, m.version, samples, coalesce(st, 0.05) AS write, coalesce(re, 0.02) AS read, least(0.02, m * 0.1) AS index_maint, least(0.01, m * 0.05) AS gc_maint,
      least(0.005, m * 0.02) AS storage_month, round_even(m, 0) AS base_cents, round_even(extra * 1e6, 0) AS per_token_micros, per_k AS per_k_cents, p50 AS p50_ms,
      (x[190] * 1 + x[191] * 19) / 20.0::DOUBLE AS p95_ms FROM m JOIN e ON e.key = m.key AND e.version = m.version WHERE samples = 200)"""


def _refitted(spark, sf_dir, name):
    """Events as samples through the refitting stream, in four micro-batches."""
    rows = samples(spark, sf_dir)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return state.replay(rows, at, 4, lambda s, folder: state.refit_stream(s, folder, "backend", ["ts", "event_id"]), name)


def _rounded(rows):
    return rows.select("key", "version", *[F.round(c, 6).alias(c) for c in state.COEFFICIENTS])


@query(f"WITH {_REFITS} SELECT key, version, samples, {', '.join(f'round({c}, 6) AS {c}' for c in state.COEFFICIENTS)} FROM r")
def stream_refits(spark, sf_dir):
    """Every refit of a stream of samples: 200 samples of a backend make a version of its prices."""
    schema = "key string, version long, samples long, " + ", ".join(f"{c} double" for c in state.COEFFICIENTS)
    found = spark.read.schema(schema).parquet(f"{_refitted(spark, sf_dir, 'stream_refits')}/refits")
    return found.select("key", "version", "samples", *[F.round(c, 6).alias(c) for c in state.COEFFICIENTS])


@query(f"WITH {_REFITS} SELECT key, version, {', '.join(f'round({c}, 6) AS {c}' for c in state.COEFFICIENTS)} FROM r WHERE version = (SELECT max(version) FROM r o WHERE o.key = r.key)")
def stream_prices(spark, sf_dir):
    """The prices that count when the stream has run: the newest version of each backend's."""
    found = state.PriceTables(spark, f"{_refitted(spark, sf_dir, 'stream_prices')}/prices").read()
    return _rounded(found) if found is not None else _rounded(spark.createDataFrame([], "key string, version long, " + ", ".join(f"{c} double" for c in state.COEFFICIENTS)))


@query(_SQL["route_flagship"])
def stream_routes(spark, sf_dir):
    """The flagship's routes, of turns that come in three micro-batches, with each session's context kept as state."""

    def run(stream, folder):
        routed = policies.routed(state.session_context(stream))
        return routed.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows")

    folder = state.replay(turns(spark, sf_dir), F.col("turn_no"), 3, run, "stream_routes")
    return spark.read.parquet(f"{folder}/rows").withColumn("turn_count", F.col("turn_count").cast("int"))


def _activity(spark, sf_dir):
    """Events with their sessions, and a place in the order of arrival: every seventh is an hour late."""
    ts = F.col("ts").cast("timestamp")
    rows = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session_id"), F.col("event_type").alias("op"), ts.alias("ts"), F.col("value").alias("observed_ms"))
    return rows, F.unix_seconds("ts") + F.when(F.col("event_id") % 7 == 0, 3600).otherwise(0)


def _appended(spark, sf_dir, name, build):
    """What a stream of the activity appends, in four micro-batches."""
    rows, at = _activity(spark, sf_dir)

    def run(stream, folder):
        writer = build(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
        return writer.trigger(availableNow=True).start(f"{folder}/rows")

    return spark.read.parquet(f"{state.replay(rows, at, 4, run, name)}/rows")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, count(DISTINCT user_id) AS active FROM events GROUP BY ALL")
def stream_active_sessions(spark, sf_dir):
    """Sessions that are active in each hour, of a stream with late rows."""
    seen = _appended(spark, sf_dir, "stream_active_sessions", streams.first_seen)
    return seen.groupBy(F.col("window_start").cast("timestamp_ntz").alias("window_start")).agg(F.count("session_id").alias("active"))


@query(
    """WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL '30 minutes' AS fresh FROM events),
    s AS (SELECT user_id, ts, sum(coalesce(fresh, true)::INT) OVER (PARTITION BY user_id ORDER BY ts, fresh ROWS UNBOUNDED PRECEDING) AS s FROM e),
    g AS (SELECT user_id AS session_id, min(ts) AS "start", max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, s)
    SELECT session_id, "start", "end", n FROM g WHERE "end" <= (SELECT max(ts) - INTERVAL '2 hours' FROM events)"""
)
def stream_sessions(spark, sf_dir):
    """Runs of activity that the stream's time has closed."""
    found = _appended(spark, sf_dir, "stream_sessions", streams.activity_sessions)
    return found.select("session_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n")


@query(
    """SELECT op, n AS batch_rows, batch_ms, CASE WHEN op <> 'error' THEN n END AS written, op <> 'error' AS success, op = 'error' AS failed
    FROM (SELECT event_type AS op, count(*) AS n, round(sum(value), 4) AS batch_ms FROM events GROUP BY event_type)"""
)
def probe_report(spark, sf_dir):
    """What the probe has recorded of a stream over all events and of a write for each operation, of which one fails."""
    rows, at = _activity(spark, sf_dir)
    ops = [r["op"] for r in rows.select("op").distinct().orderBy("op").collect()]
    recorder = probe.Probe(spark)

    def run(stream, folder):
        own = [x for op in ops for x in (F.count_if(F.col("op") == op).alias(f"rows {op}"), F.sum(F.when(F.col("op") == op, F.col("observed_ms"))).alias(f"ms {op}"))]
        writer = stream.observe("operations", *own).writeStream.format("noop").option("checkpointLocation", f"{folder}/checkpoint")
        return Watched(writer.queryName("activity").trigger(availableNow=True).start())

    with recorder.listen() as listener:

        class Watched:
            def __init__(self, started):
                self.started = started

            def awaitTermination(self):
                listener.wait(self.started)

        state.replay(rows, at, 3, run, "probe_report")
    for op in ops:
        try:
            with recorder.operation(op, "noop") as own:
                value = F.when(F.col("op") == "error", F.raise_error(F.lit("not to be stored"))).otherwise(F.col("observed_ms"))
                own.watch(rows.where(F.col("op") == op).withColumn("observed_ms", value)).write.format("noop").mode("overwrite").save()
        except Exception as error:  # noqa: BLE001
            if "not to be stored" not in str(error):
                raise
    records = recorder.records()
    seen = records.where("kind = 'batch'").select(F.explode("metrics").alias("name", "x"))
    seen = seen.select(F.split("name", " ", 2)[1].alias("op"), F.split("name", " ", 2)[0].alias("what"), "x").groupBy("op").agg(
        F.sum(F.when(F.col("what") == "rows", F.col("x"))).cast("long").alias("batch_rows"), F.round(F.sum(F.when(F.col("what") == "ms", F.col("x"))), 4).alias("batch_ms")
    )
    done = records.where("kind = 'operation'").select("op", F.col("rows").alias("written"), "success", F.col("error").contains("not to be stored").alias("failed"))
    return seen.join(done, "op").withColumn("failed", F.coalesce("failed", F.lit(False)))


def _labelled(spark, sf_dir):
    """Documents with counts as features, and the three-class rules' class as target."""
    c = F.col("content")
    found = {k: v.cast("double") for k, v in basic_text_features(c).items()}
    rows = documents(spark, sf_dir).select("doc_id", "content", *[v.alias(k) for k, v in found.items()])
    ids = F.create_map(*[F.lit(x) for pair in policies.CLASS_IDS.items() for x in pair])
    return rows.withColumn("target", ids[policies.three_class(c)].cast("double")), list(found)


_TARGETS = f"""WITH {DOCS}, t AS (SELECT doc_id, CASE {R.three_class('content')} WHEN 'discard' THEN 0 WHEN 'store' THEN 1 ELSE 2 END AS target FROM d)"""


def _against_majority(scored, by):
    """For each value of `by`: rows, how many the largest class has, and whether the model is right more often, or all the time."""
    right = F.sum((F.col("class_id") == F.col("target")).cast("int"))
    classes = [F.count_if(F.col("target") == k) for k in range(len(policies.CLASS_IDS))]
    found = scored.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.greatest(*classes).alias("majority"), right.alias("right"))
    return found.select(by, "n", "majority", ((F.col("right") > F.col("majority")) | (F.col("right") == F.col("n"))).alias("better"))


_MAJORITY = "count(*) AS n, greatest(count(*) FILTER (target = 0), count(*) FILTER (target = 1), count(*) FILTER (target = 2)) AS majority, true AS better"


@query(f"{_TARGETS} SELECT (doc_id % 5)::INT AS fold, {_MAJORITY} FROM t GROUP BY fold")
def cross_validation(spark, sf_dir):
    """Five folds of documents, each judged by a forest that has learnt from the other four."""
    rows, features = _labelled(spark, sf_dir)
    rows = rows.drop("content").withColumn("fold", (F.col("doc_id") % 5).cast("int"))
    scored = models.cross_validated(rows, "fold", 5, lambda part: models.train_router(part, features, "target", trees=10))
    return _against_majority(scored, "fold")


@query(f"{_TARGETS} SELECT model, {_MAJORITY} FROM t, (SELECT unnest(['forest', 'boosted']) AS model) WHERE doc_id % 4 = 3 GROUP BY model")
def model_comparison(spark, sf_dir):
    """A forest and boosted trees (saved, loaded, calibrated) on documents that neither has seen."""
    rows, features = _labelled(spark, sf_dir)
    rows = written(rows.drop("content"), "labelled")  # fits, calibration and predictions read numbers, not texts
    part = F.col("doc_id") % 4
    train, curve, test = rows.where(part < 2), rows.where(part == 2), rows.where(part == 3)
    forest = models.train_router(train, features, "target")
    folder = shared_folder(spark, "boosted")
    models.BoostedRouter.fit(train, features, "target", len(policies.CLASS_IDS)).save(folder)
    boosted = models.BoostedRouter.load(folder)
    out = None
    for name, model in (("forest", forest), ("boosted", boosted)):
        scored = models.predict(model, test, models.calibrate(model, curve, "target", len(policies.CLASS_IDS)))
        scored = scored.select("target", "class_id").withColumn("model", F.lit(name))
        out = scored if out is None else out.unionByName(scored)
    return _against_majority(out, "model")


@query("SELECT count(*) AS documents, true AS bounded, true AS unit_vectors FROM documents")
def tfidf_features(spark, sf_dir):
    """The learned policies' text features over all documents: how many there are, at most 1,000 of words and 1,000 of pairs,
    and unit vectors but for texts without any."""
    terms, vectors = models.tfidf_vectors(documents(spark, sf_dir), "doc_id")
    norm = F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x)
    return vectors.select("doc_id", norm.alias("norm")).agg(
        F.count(F.lit(1)).alias("documents"),
        F.lit(len(terms) <= 2000).alias("bounded"),
        F.coalesce(F.every((F.abs(F.col("norm") - 1) < 1e-9) | (F.col("norm") == 0)), F.lit(True)).alias("unit_vectors"),
    )


@query(
    """WITH o AS (SELECT doc_id, quality, row_number() OVER (ORDER BY md5('draw|' || doc_id), doc_id) AS n FROM labels),
    t AS (SELECT *, CASE WHEN n <= 60 THEN 1 WHEN n <= 150 THEN 2 ELSE 3 END AS draw, row_number() OVER (PARTITION BY quality ORDER BY n) AS k FROM o WHERE n <= 285),
    e AS (SELECT max(enough) AS needed FROM (SELECT coalesce(min(CASE WHEN k = 50 THEN draw END), 3) AS enough FROM t GROUP BY quality))
    SELECT doc_id, quality, draw::INT AS draw FROM t, e WHERE draw <= needed"""
)
def collected_labels(spark, sf_dir):
    """Labels drawn until each class has 50."""
    return labelling.collected(read(spark, sf_dir, "labels"), "doc_id", "quality", 60, 50)


@query("SELECT event_type AS op, count(*) AS n, sum(k)::BIGINT AS total, min(k) AS least, max(k) AS most FROM (SELECT event_type, json_extract_string(props, '$.k')::INT AS k FROM events) WHERE k >= 50 GROUP BY event_type")
def event_properties(spark, sf_dir):
    """Events' properties as variants, with the numbers that queries filter on as columns of their own beside them."""
    events = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("op"), F.try_parse_json("props").alias("props"))
    folder = shared_folder(spark, "event_properties")
    events.withColumn("k", F.try_variant_get("props", "$.k", "int")).write.parquet(f"{folder}/rows")
    kept = spark.read.parquet(f"{folder}/rows").where("k >= 50")  # reaches the scan, and the variants aren't read
    return kept.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"), F.min("k").alias("least"), F.max("k").alias("most"))


@query()
def model_routes(spark, sf_dir):
    """A forest that learns the three-class rules from counts, calibrated, with the heuristic where it is unsure."""
    rows, found = _labelled(spark, sf_dir)
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    numbers = written(rows.drop("content").where(learn < 3), "labelled")  # each pass of a fit would work out all texts anew
    model = models.train_router(numbers.where(learn < 2), found, "target")
    curves = models.calibrate(model, numbers.where(learn == 2), "target", len(policies.CLASS_IDS))
    scored = models.predict(model, rows, curves)
    out = models.routed_by_model(scored, list(policies.CLASS_IDS), policies.heuristic_action(F.col("content"), F.lit("user")))
    return out.select("doc_id", "route", "confidence", "abstained", "action", F.col("target").cast("int").alias("target"))


