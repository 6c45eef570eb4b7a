"""Queries on stores, evaluation rollups, labelling and generated data."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnmill.functions import constants as C
from turnmill.functions import features, pricing
from turnmill.functions import text as T
from turnmill.operators import filters, labelling, metrics, policies, sessions
from turnmill.plans import registry as R
from turnmill.plans.registry import DOCS, TURNS, query
from turnmill.sources import generators
from turnmill.sources.tables import documents, query_texts, read, telemetry, turns

KEY = ["session_id", "turn_no"]

# --- stores -------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {DOCS}, v AS (SELECT source, unnest({R.tokens('content')}) AS term FROM d), n AS (SELECT source, count(DISTINCT term) AS vocabulary_size FROM v GROUP BY source)
    SELECT source, count(*) AS total_items, coalesce(any_value(vocabulary_size), 0) AS vocabulary_size, count(*) / 10000.0::DOUBLE AS utilization, count(DISTINCT lang) AS total_files,
    round(count(*)::DOUBLE / greatest(1, count(DISTINCT lang)), 2) AS avg_items_per_file, round(count(DISTINCT lang) FILTER (doc_id % 2 = 0)::DOUBLE / greatest(1, count(DISTINCT lang)), 3) AS cache_hit_ratio
    FROM d LEFT JOIN n USING (source) GROUP BY source"""
)
def storage_stats(spark, sf_dir):
    docs = documents(spark, sf_dir)
    terms = docs.select("source", F.explode(T.token_set(F.col("content"))).alias("term")).distinct()
    vocabulary = terms.groupBy("source").agg(F.count(F.lit(1)).alias("vocabulary_size"))
    files, cached = F.count_distinct("lang"), F.count_distinct(F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    found = docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("total_items"),
        (F.count(F.lit(1)) / 10000.0).alias("utilization"),
        files.alias("total_files"),
        F.round(F.count(F.lit(1)) / F.greatest(F.lit(1), files), 2).alias("avg_items_per_file"),
        F.round(cached / F.greatest(F.lit(1), files), 3).alias("cache_hit_ratio"),
    )
    return found.join(vocabulary, "source", "left").withColumn("vocabulary_size", F.coalesce("vocabulary_size", F.lit(0)))


_ROUTE = f"r AS (SELECT *, {R.three_class('content')} AS route FROM t)"


@query(
    f"""WITH {TURNS}, {_ROUTE}, b AS (SELECT CASE route WHEN 'discard' THEN 'none' WHEN 'compress' THEN 'file_store' ELSE CASE WHEN item_id % 2 = 0 THEN 'faiss_store' ELSE 'memory_store' END END AS backend FROM r)
    SELECT coalesce(backend, 'total') AS backend, count(*) AS items FROM b WHERE backend <> 'none' GROUP BY GROUPING SETS ((backend), ())"""
)
def backend_counts(spark, sf_dir):
    route = policies.three_class(F.col("content"))
    placed = F.when(route == "discard", "none").when(route == "compress", "file_store").when(F.col("item_id") % 2 == 0, "faiss_store").otherwise("memory_store")
    rows = turns(spark, sf_dir).select(placed.alias("backend")).where("backend <> 'none'")
    return rows.rollup("backend").agg(F.count(F.lit(1)).alias("items")).select(F.coalesce("backend", F.lit("total")).alias("backend"), "items")


@query(
    f"""WITH RECURSIVE {TURNS}, e AS (SELECT session_id, turn_no * 2 + 1 AS seq, 'store' AS op, item_id FROM t UNION ALL SELECT session_id, turn_no * 2 + 2, 'retrieve', item_id FROM t WHERE turn_no % 3 = 2),
    o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS k FROM e),
    s AS (SELECT session_id, k, [item_id] AS held FROM o WHERE k = 1
      UNION ALL SELECT o.session_id, o.k, CASE WHEN o.op = 'store' THEN (CASE WHEN len(s.held) >= 3 THEN s.held[2:] ELSE s.held END) || [o.item_id]
        ELSE list_filter(s.held, lambda x: x % 2 <> 0) || list_sort(list_filter(s.held, lambda x: x % 2 = 0)) END FROM s JOIN o ON o.session_id = s.session_id AND o.k = s.k + 1)
    SELECT session_id, unnest(held) AS item_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY k DESC) AS last FROM s) WHERE last = 1"""
)
def lru_trace(spark, sf_dir):
    rows = turns(spark, sf_dir)
    even = F.collect_list(F.when(F.col("item_id") % 2 == 0, F.col("item_id"))).over(W.partitionBy("session_id").orderBy("turn_no").rowsBetween(-10, 0))
    stored = rows.select("session_id", (F.col("turn_no") * 2 + 1).alias("seq"), F.lit("store").alias("op"), "item_id", F.lit(None).cast("array<long>").alias("passes"))
    asked = rows.select("session_id", (F.col("turn_no") * 2 + 2).alias("seq"), F.lit("retrieve").alias("op"), "item_id", even.alias("passes"), "turn_no")
    return sessions.lru_trace(stored.union(asked.where("turn_no % 3 = 2").drop("turn_no")), 3)


@query(f"WITH {TURNS} SELECT session_id, turn_no, content, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_no DESC) AS r FROM t) WHERE r <= 5")
def recent_memories(spark, sf_dir):
    w = W.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("turn_no"))
    return turns(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 5").select(*KEY, "content", "rank")


# --- sessions and budgets -----------------------------------------------------------------------------------------

_COST = f"0.05::DOUBLE + {R.token_estimate('content')} * 0.0001::DOUBLE + 0.01::DOUBLE / 30.0::DOUBLE"


@query(
    f"""WITH {TURNS}, {_ROUTE}, c AS (SELECT *, greatest(0, round_even(20 * ({_COST}), 0)::INT) AS cents FROM r)
    SELECT session_id, count(*) AS turns, count(*) FILTER (route <> 'discard') AS storage_operations, coalesce(sum(cents) FILTER (route <> 'discard'), 0)::BIGINT AS total_cents,
    array_to_string(list(route ORDER BY turn_no), ',') AS routes, coalesce(sum(cents) FILTER (route <> 'discard'), 0)::DOUBLE / greatest(1, count(*) FILTER (route <> 'discard')) AS efficiency
    FROM c GROUP BY session_id"""
)
def session_efficiency(spark, sf_dir):
    return _session_results(spark, sf_dir)


def _session_results(spark, sf_dir):
    """Per session: what routing stores, its whole cents (twenty times the unit price, so that they aren't all 0), and cents per store."""
    c = F.col("content")
    rows = turns(spark, sf_dir).select(*KEY, policies.three_class(c).alias("route"), pricing.whole_cents(20 * pricing.write_cost(T.token_estimate(c))).alias("cents"))
    stored = F.col("route") != "discard"
    cents = F.coalesce(F.sum(F.when(stored, F.col("cents"))), F.lit(0)).cast("long")
    return rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turns"),
        F.count_if(stored).alias("storage_operations"),
        cents.alias("total_cents"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", "route"))), lambda x: x["route"]), ",").alias("routes"),
        (cents / F.greatest(F.lit(1), F.count_if(stored))).alias("efficiency"),
    )


_RECALL = f"""x AS (SELECT session_id, turn_no, list_distinct({R.words('lower(content)')}) AS r,
    list_distinct({R.words("lower(lag(content) OVER (PARTITION BY session_id ORDER BY turn_no))")}) AS e, length(content) / 10.0::DOUBLE AS ms FROM t),
    y AS (SELECT *, len(list_intersect(e, r)) AS tp FROM x WHERE e IS NOT NULL),
    q AS (SELECT *, CASE WHEN len(e) = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE tp::DOUBLE / len(r) END AS p, CASE WHEN len(e) = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE tp::DOUBLE / len(e) END AS c,
          CASE WHEN len(e) = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (len(e) + len(r)) END AS f FROM y)"""


@query(
    f"""WITH {TURNS}, {_ROUTE}, k AS (SELECT *, greatest(0, round_even(20 * ({_COST}), 0)::INT) AS cents FROM r), {_RECALL},
    s AS (SELECT count(DISTINCT session_id) AS sessions, count(*) AS turns, coalesce(sum(cents) FILTER (route <> 'discard'), 0)::BIGINT AS cents FROM k),
    z AS (SELECT count(*) AS queries_tested, avg(c) AS recall, avg(p) AS precision, avg(f) AS f1, count(*) FILTER (c > 0.5) AS successful, avg(ms) AS mean_ms FROM q)
    SELECT sessions, turns, cents, queries_tested, recall, precision, f1, successful, mean_ms, cents::DOUBLE / greatest(1, turns) AS cost_per_turn, cents::DOUBLE / greatest(1, sessions) AS cost_per_session FROM s, z"""
)
def evaluation_rollup(spark, sf_dir):
    stored = _session_results(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("turns").alias("turns"), F.sum("total_cents").alias("cents")
    )
    bag = lambda c: F.array_distinct(T.words(F.lower(c)))
    rows = turns(spark, sf_dir).withColumn("before", F.lag("content").over(W.partitionBy("session_id").orderBy("turn_no", "item_id"))).where("before is not null")
    scores = metrics.set_scores(bag(F.col("before")), bag(F.col("content")))
    recalled = rows.select((F.length("content") / 10.0).alias("ms"), *[v.alias(k) for k, v in scores.items()]).agg(
        F.count(F.lit(1)).alias("queries_tested"),
        F.avg("recall").alias("recall"),
        F.avg("precision").alias("precision"),
        F.avg("f1").alias("f1"),
        F.count_if(F.col("recall") > 0.5).alias("successful"),
        F.avg("ms").alias("mean_ms"),
    )
    per = lambda c: F.col("cents") / F.greatest(F.lit(1), F.col(c))
    joined = stored.crossJoin(recalled)  # one row with one row
    return joined.withColumns({"cost_per_turn": per("turns"), "cost_per_session": per("sessions")})


@query(
    """WITH e AS (SELECT user_id AS session_id, value, ts FROM events), g AS (SELECT session_id, sum(value) AS total, count(*) AS n, epoch(max(ts)) - epoch(min(ts)) AS s FROM e GROUP BY session_id)
    SELECT session_id, round(total, 4) AS total_cents, round(total / 100, 6) AS total_usd, n AS operation_count, round(total / greatest(1, n), 4) AS avg_cost, round(s / 3600.0::DOUBLE, 2) AS hours FROM g"""
)
def cost_summary(spark, sf_dir):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = (F.max(micros) - F.min(micros)) / 1e6
    rows = telemetry(spark, sf_dir).groupBy("session_id").agg(F.sum("observed_ms").alias("t"), F.count(F.lit(1)).alias("operation_count"), seconds.alias("s"))
    return rows.select(
        "session_id",
        F.round("t", 4).alias("total_cents"),
        F.round(F.col("t") / 100, 6).alias("total_usd"),
        "operation_count",
        F.round(F.col("t") / F.greatest(F.lit(1), F.col("operation_count")), 4).alias("avg_cost"),
        F.round(F.col("s") / 3600.0, 2).alias("hours"),
    )


_VALID = "length(content) BETWEEN 1 AND 10000 AND speaker IN ('user', 'assistant')"


@query(
    f"""WITH {TURNS}, x AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_no DESC) AS r, {_VALID} AS fine FROM t)
    SELECT session_id, count(*) AS turns_processed, count(*) FILTER (fine) AS stored, (max(turn_no) - min(turn_no))::DOUBLE AS minutes,
    array_to_string(list(CASE WHEN length(content) > 100 THEN substr(content, 1, 100) || '...' ELSE content END ORDER BY turn_no) FILTER (r <= 5), ' | ') AS recent,
    coalesce(array_to_string(list('Failed to store turn ' || turn_no ORDER BY turn_no) FILTER (NOT fine), '; '), '') AS errors FROM x GROUP BY session_id"""
)
def session_report(spark, sf_dir):
    w = W.partitionBy("session_id").orderBy(F.desc("turn_no"))
    fine = filters.valid_request(F.col("content"), F.col("speaker"), F.lit("s"))
    rows = turns(spark, sf_dir).withColumn("r", F.row_number().over(w)).withColumn("fine", fine)
    in_order = lambda keep, text: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("turn_no", text.alias("x"))))), lambda s: s["x"])
    failed = F.concat(F.lit("Failed to store turn "), F.col("turn_no").cast("string"))
    return rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turns_processed"),
        F.count_if("fine").alias("stored"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 6e7).alias("minutes"),
        F.array_join(in_order(F.col("r") <= 5, T.preview(F.col("content"))), " | ").alias("recent"),
        F.array_join(in_order(~F.col("fine"), failed), "; ").alias("errors"),
    )


_TYPES = ["minimal", "standard", "premium", "unlimited", "unknown"]


@query(
    f"""WITH {TURNS}, s AS (SELECT DISTINCT session_id, {R.names(_TYPES)}[session_id % 5 + 1] AS budget FROM t),
    b AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {x}::DOUBLE)" for n, x, _ in C.BUDGETS)}) v(budget, conversation_limit))
    SELECT session_id, budget, coalesce(conversation_limit, 5.0) AS conversation_limit, 0.1::DOUBLE AS operation_limit, 10.0::DOUBLE AS session_limit, 50.0::DOUBLE AS daily_limit, 2.0::DOUBLE AS burst_limit
    FROM s LEFT JOIN b USING (budget)"""
)
def budget_constraints(spark, sf_dir):
    kinds = F.array(*map(F.lit, _TYPES))
    rows = turns(spark, sf_dir).select("session_id", F.element_at(kinds, (F.col("session_id") % 5 + 1).cast("int")).alias("budget")).distinct()
    return pricing.with_budget_limits(rows, pricing.budgets(spark))


# --- answers ------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {TURNS}, {_ROUTE}, x AS (SELECT session_id, route, list_distinct({R.words('lower(content)')}[1:6]) AS e,
      list_distinct({R.words("lower(lag(content) OVER (PARTITION BY session_id ORDER BY turn_no))")}[1:12]) AS p FROM r),
    f AS (SELECT *, CASE WHEN len(e) + len(p) = 0 THEN 1.0 ELSE 2.0::DOUBLE * len(list_intersect(e, p)) / (len(e) + len(p)) END AS f1 FROM x WHERE p IS NOT NULL),
    c AS (SELECT count(*) * 12 AS naive, sum(CASE route WHEN 'discard' THEN 1 WHEN 'store' THEN 8 ELSE 15 END)::BIGINT AS cents FROM r)
    SELECT (SELECT count(*) FROM f) AS questions, (SELECT avg(f1) FROM f) AS f1_score, (SELECT count(*) FILTER (f1 > 0.8)::DOUBLE / count(*) FROM f) AS accuracy,
    cents::DOUBLE / greatest(1, (SELECT count(*) FILTER (f1 > 0.8) FROM f)) AS cost_per_correct, (naive - cents)::DOUBLE / naive AS cost_savings FROM c"""
)
def episodic_f1(spark, sf_dir):
    rows = turns(spark, sf_dir)
    cents, _ = policies.route_cost(policies.three_class(F.col("content")))
    bag = lambda c, n: F.array_distinct(F.slice(T.words(F.lower(c)), 1, n))
    pairs = rows.withColumn("before", F.lag("content").over(W.partitionBy("session_id").orderBy("turn_no"))).where("before is not null")
    found = pairs.select(metrics.set_f1(bag(F.col("content"), 6), bag(F.col("before"), 12)).alias("f1")).agg(
        F.count(F.lit(1)).alias("questions"), F.avg("f1").alias("f1_score"), F.count_if(F.col("f1") > 0.8).alias("correct")
    )
    costs = rows.agg(F.sum(cents).alias("cents"), (F.count(F.lit(1)) * C.NAIVE_CENTS).alias("naive"))
    return found.crossJoin(costs).select(  # one row with one row
        "questions",
        "f1_score",
        (F.col("correct") / F.col("questions")).alias("accuracy"),
        (F.col("cents") / F.greatest(F.lit(1), F.col("correct"))).alias("cost_per_correct"),
        ((F.col("naive") - F.col("cents")) / F.col("naive")).alias("cost_savings"),
    )


@query(
    f"""WITH {TURNS}, x AS (SELECT CASE WHEN item_id % 4 = 0 THEN 'abstention' ELSE 'recall' END AS question_type, CASE WHEN item_id % 7 = 0 THEN 'q_abs' ELSE 'q' END AS question, content AS answer,
      content || CASE WHEN item_id % 8 = 0 THEN ' Not enough' ELSE '' END AS predicted FROM t),
    y AS (SELECT question_type, CASE WHEN question_type = 'abstention' OR contains(question, '_abs') THEN {R.has_part('predicted', C.REFUSALS)}
      ELSE len(list_intersect(list_distinct({R.words('lower(answer)')}), list_distinct({R.words('lower(predicted)')}))) >= least(3.0, len(list_distinct({R.words('lower(answer)')})) * 0.5) END AS correct FROM x)
    SELECT question_type, count(*) AS n, count(*) FILTER (correct) AS correct, avg(correct::INT) AS accuracy FROM y GROUP BY question_type"""
)
def long_chat_accuracy(spark, sf_dir):
    i, c = F.col("item_id"), F.col("content")
    rows = turns(spark, sf_dir).select(
        F.when(i % 4 == 0, "abstention").otherwise("recall").alias("question_type"),
        F.when(i % 7 == 0, "q_abs").otherwise("q").alias("question"),
        c.alias("answer"),
        F.concat(c, F.when(i % 8 == 0, " Not enough").otherwise("")).alias("predicted"),
    )
    correct = metrics.answer_correct(F.col("question_type"), F.col("question"), F.col("answer"), F.col("predicted"))
    return rows.withColumn("correct", correct).groupBy("question_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("correct"), F.avg(F.col("correct").cast("int")).alias("accuracy")
    )


@query(
    """WITH p AS (SELECT quality, (length(text) > 1000)::INT AS predicted, (length(text) % 100) / 100.0::DOUBLE AS confidence FROM labels JOIN documents USING (doc_id))
    SELECT avg((quality = predicted)::INT) AS accuracy, 1 - avg((confidence >= 0.7::DOUBLE)::INT) AS abstention_rate, coalesce(avg((quality = predicted)::INT) FILTER (confidence >= 0.7::DOUBLE), 0.0) AS high_conf_accuracy FROM p"""
)
def confidence_analysis(spark, sf_dir):
    docs = documents(spark, sf_dir).select(
        "doc_id", (F.length("content") > 1000).cast("int").alias("predicted"), (F.length("content") % 100 / 100.0).alias("confidence")
    )
    return metrics.confidence_analysis(read(spark, sf_dir, "labels").join(docs, "doc_id"), "quality", "predicted", "confidence")


# --- labelling ----------------------------------------------------------------------------------------------------

_MICROS = "len({0}) * 150 // 1000 + 90"


@query(
    f"""WITH {DOCS}, c AS (SELECT doc_id, {_MICROS.format(R.words('content'))} AS micros FROM d), s AS (SELECT *, coalesce(sum(micros) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent FROM c)
    SELECT doc_id, micros, spent, spent + 10000 <= 100000 AS labelled FROM s"""
)
def labelling_budget(spark, sf_dir):
    micros = F.floor(T.word_count(F.col("content")) * 150 / 1000).cast("long") + 90
    rows = documents(spark, sf_dir).select("doc_id", micros.alias("micros"))
    return labelling.within_budget(rows, "doc_id", "micros", budget=100_000, call=10_000)


@query(
    f"""WITH {DOCS}, x AS (SELECT doc_id % 17 <> 0 AS success, {R.three_class('content')} AS route, (length(content) % 50 + 50) / 100.0::DOUBLE AS confidence FROM d)
    SELECT count(*) FILTER (success) AS total_samples, count(*) FILTER (NOT success) AS api_failures, count(*) FILTER (success AND confidence < 0.7::DOUBLE) AS low_confidence_count,
    avg(confidence) FILTER (success) AS avg_confidence, count(*) FILTER (success AND route = 'discard') AS discard, count(*) FILTER (success AND route = 'store') AS store,
    count(*) FILTER (success AND route = 'compress') AS compress FROM x"""
)
def labelling_quality(spark, sf_dir):
    rows = documents(spark, sf_dir).select(
        (F.col("doc_id") % 17 != 0).alias("success"),
        policies.three_class(F.col("content")).alias("route"),
        ((F.length("content") % 50 + 50) / 100.0).alias("confidence"),
    )
    return labelling.quality(rows, ["discard", "store", "compress"])


@query(
    f"""WITH {TURNS} SELECT session_id, turn_no, CASE WHEN len({R.words('content')}) <= 4 OR content IN ({', '.join(map(R.q, C.TEMPLATE_EXACT))}) THEN 'discard_candidate'
    WHEN {' OR '.join(f'contains(content, {R.q(x)})' for x in [*C.TEMPLATE_FIELDS, 'is'])} THEN 'keyvalue_candidate'
    WHEN starts_with(content, 'What') OR starts_with(content, 'How') OR contains(content, 'prefer') THEN 'vector_candidate'
    WHEN {' OR '.join(f'contains(content, {R.q(x)})' for x in C.TEMPLATE_LINKS)} THEN 'graph_candidate'
    WHEN length(content) > 200 THEN 'summary_candidate' ELSE 'unknown' END AS candidate FROM t"""
)
def template_classes(spark, sf_dir):
    return turns(spark, sf_dir).select(*KEY, labelling.template_class(F.col("content")).alias("candidate"))


_ENTITIES = "list_filter({0}, lambda x: regexp_full_match(x, '[A-Z][A-Za-z]{{2,}}'))[1:5]"


@query(
    f"""WITH {TURNS}, x AS (SELECT *, {R.names([v for _, v in C.PATTERNS])}[session_id % 6 + 1] AS pattern, len({_ENTITIES.format(R.words('content'))}) AS n FROM t)
    SELECT session_id, turn_no, (length(content) % 50 + 50) / 100.0::DOUBLE AS confidence, {', '.join(f"coalesce(pattern = '{v}', false)::INT AS pattern_{k}" for k, v in C.PATTERNS)},
    n::INT AS detected_entities_count, (n > 0)::INT AS has_detected_entities, (n > 1)::INT AS content_has_entities, contains(content, ' of ')::INT AS content_has_relationships, contains(content, '?')::INT AS content_is_question FROM x"""
)
def pattern_features(spark, sf_dir):
    c = F.col("content")
    names = F.array(*[F.lit(v) for _, v in C.PATTERNS])
    found = T.entities(c)
    samples = turns(spark, sf_dir).select(
        *KEY,
        F.get(names, (F.col("session_id") % 6).cast("int")).alias("pattern"),
        ((F.length(c) % 50 + 50) / 100.0).alias("confidence"),
        found.alias("entities"),
        F.struct((F.size(found) > 1).alias("has_entities"), c.contains(" of ").alias("has_relationships"), c.contains("?").alias("is_question")).alias("flags"),
    )
    made = features.pattern_features(F.col("pattern"), F.col("confidence"), F.col("entities"), F.col("flags"))
    return samples.select(*KEY, *[v.alias(k) for k, v in made.items()])


@query(
    f"""WITH {TURNS}, e AS (SELECT session_id, turn_no, content, false AS augmented FROM t UNION ALL
    SELECT session_id, turn_no, CASE ('0x' || substr(md5('5|' || item_id), 1, 6))::BIGINT % 5 WHEN 0 THEN replace(content, '?', '??') WHEN 1 THEN replace(content, '.', '...')
      WHEN 2 THEN replace(replace(content, ' I ', ' i '), 'I''m', 'i''m') WHEN 3 THEN content || ' (repeated)' ELSE replace(replace(content, 'user', 'person'), 'assistant', 'AI') END, true
    FROM t WHERE ('0x' || substr(md5('9|' || item_id), 1, 6))::BIGINT % 100 < 50) SELECT * FROM e"""
)
def augmented_turns(spark, sf_dir):
    rows = turns(spark, sf_dir).select(*KEY, "content", "item_id")
    return labelling.augmented(rows, "content", "item_id", share=0.5).select(*KEY, "content", "augmented")


# --- comparisons --------------------------------------------------------------------------------------------------

_FRAMEWORKS = f"""f AS (SELECT source AS framework, {R.three_class('content')} AS route, doc_id % 3 <> 0 AS good FROM d),
    a AS (SELECT framework, count(*) AS n, 12 * count(*) AS base_cents, avg(good::INT) AS base_accuracy, sum(CASE route WHEN 'discard' THEN 1 WHEN 'store' THEN 8 ELSE 15 END)::BIGINT AS cents,
      avg(CASE WHEN route <> 'discard' THEN good::INT::DOUBLE WHEN good THEN 0.0 ELSE 0.5 END) AS accuracy, count(*) FILTER (route = 'discard') AS discarded FROM f GROUP BY framework),
    c AS (SELECT framework, (base_cents - cents)::DOUBLE / base_cents * 100 AS cost_reduction, accuracy - base_accuracy AS accuracy_delta, base_cents - cents AS savings,
      (base_cents - cents)::DOUBLE / n AS savings_per_item, accuracy >= base_accuracy - 0.05 AS maintained, discarded::DOUBLE / n AS discard_rate FROM a)"""


@query(f"WITH {DOCS}, {_FRAMEWORKS} SELECT * FROM c")
def framework_comparison(spark, sf_dir):
    return labelling.compared(*_evaluated(spark, sf_dir))


def _evaluated(spark, sf_dir):
    route, good = policies.three_class(F.col("content")), F.col("doc_id") % 3 != 0
    rows = documents(spark, sf_dir).select(F.col("source").alias("framework"), route.alias("route"), good.alias("good"))
    cents, _ = policies.route_cost(F.col("route"))
    credit = F.when(F.col("route") != "discard", F.col("good").cast("int").cast("double")).otherwise(F.when(F.col("good"), 0.0).otherwise(0.5))
    by = rows.groupBy("framework")
    size = F.count(F.lit(1)).alias("n")
    baseline = by.agg(size, (C.NAIVE_CENTS * F.count(F.lit(1))).alias("cents"), F.avg(F.col("good").cast("int")).alias("accuracy"))
    return baseline, by.agg(size, F.sum(cents).alias("cents"), F.avg(credit).alias("accuracy"), F.count_if(F.col("route") == "discard").alias("discarded"))


@query(
    f"""WITH {DOCS}, {_FRAMEWORKS} SELECT count(*) AS frameworks, avg(cost_reduction) AS cost_reduction, avg(accuracy_delta) AS accuracy_delta, avg(maintained::INT) AS maintained_rate,
    CASE WHEN avg(cost_reduction) > 15 AND avg(accuracy_delta) >= -0.05 THEN 'PASSED' ELSE 'NEEDS_IMPROVEMENT' END AS status FROM c"""
)
def overall_comparison(spark, sf_dir):
    return labelling.overall(labelling.compared(*_evaluated(spark, sf_dir)))


_ACTION = f"f AS (SELECT *, {R.stripped('content')} AS s FROM m), g AS (SELECT *, {R.columns(R.flags('s'))} FROM f), h AS (SELECT *, {R.HEURISTIC} AS action FROM g)"


@query(
    f"""WITH {TURNS}, m AS (SELECT speaker, content, CASE WHEN speaker = 'user' THEN 'cost' ELSE 'routing' END AS part,
    CASE WHEN speaker = 'user' THEN NULL WHEN ({R.three_class('content')}) = 'discard' THEN 'discard' ELSE 'store' END AS expected FROM t WHERE content IS NOT NULL AND speaker IS NOT NULL), {_ACTION},
    c AS (SELECT *, CASE WHEN action = 'drop' THEN 0.0 ELSE ({_COST}) / 100 END AS usd FROM h)
    SELECT part, count(*) AS n, count(*) FILTER (action <> 'drop') AS stored, round(sum(usd), 9) AS usd, round((count(*) * 0.001::DOUBLE - sum(usd)) / (count(*) * 0.001::DOUBLE) * 100, 6) AS reduction_percent,
    count(*) FILTER (expected = CASE WHEN action = 'drop' THEN 'discard' ELSE 'store' END) AS correct FROM c GROUP BY part"""
)
def simple_benchmark(spark, sf_dir):
    """What the users' turns cost, and how often the heuristic agrees on the others with the three-class router."""
    rows = turns(spark, sf_dir).where("content is not null and speaker is not null")
    routed = F.when(policies.three_class(F.col("content")) == "discard", "discard").otherwise("store")
    user = F.col("speaker") == "user"
    return benchmark(rows.select("speaker", "content", F.when(user, "cost").otherwise("routing").alias("part"), F.when(~user, routed).alias("expected")))


def benchmark(rows):
    """Per part of `rows` (part, speaker, content, expected): what is stored, its price against the naive one, and agreement."""
    c = F.col("content")
    rows = rows.withColumn("action", policies.heuristic_action(c, F.col("speaker")))
    usd = F.when(F.col("action") == "drop", 0.0).otherwise(pricing.write_cost(T.token_estimate(c)) / 100)
    naive = F.count(F.lit(1)) * C.NAIVE_USD
    actual = F.when(F.col("action") == "drop", "discard").otherwise("store")
    return rows.withColumn("usd", usd).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("action") != "drop").alias("stored"),
        F.round(F.sum("usd"), 9).alias("usd"),
        F.round((naive - F.sum("usd")) / naive * 100, 6).alias("reduction_percent"),
        F.count_if(F.col("expected") == actual).alias("correct"),
    )


@query(
    """WITH l AS (SELECT event_type AS op, list_sort(list(value)) AS x, avg(value) AS mean_ms FROM events WHERE value IS NOT NULL GROUP BY event_type)
    SELECT op, len(x) AS n, round(mean_ms, 6) AS mean_ms, x[floor(len(x) * 0.95)::INT + 1] AS p95_ms, round(CASE WHEN mean_ms > 0 THEN 1000 / mean_ms ELSE 0 END, 6) AS throughput FROM l"""
)
def throughput(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    mean = F.avg("observed_ms")
    rates = rows.where("observed_ms is not null").groupBy("op").agg(
        F.round(mean, 6).alias("mean_ms"), F.round(F.when(mean > 0, 1000 / mean).otherwise(0.0), 6).alias("throughput")
    )
    return metrics.p95_by_definition(rows, "op", "observed_ms").select("op", "n", F.col("by_index").alias("p95_ms")).join(rates, "op")


@query(
    f"""WITH {TURNS}, x AS (SELECT session_id, turn_no, CASE WHEN turn_no % 4 = 3 THEN NULL ELSE (length(content) % 5)::INT END AS predicted FROM t),
    y AS (SELECT session_id, turn_no, coalesce(predicted, 2) AS class_id, CASE WHEN predicted IS NULL THEN 0.5 ELSE 0.9 END AS confidence FROM x)
    SELECT session_id, turn_no, class_id, confidence, array_to_string(list_filter({R.names(policies.CLASS_NAMES)}, lambda n, i: i <> class_id + 1)[1:3], ',') AS alternatives FROM y"""
)
def default_predictions(spark, sf_dir):
    predicted = F.when(F.col("turn_no") % 4 != 3, (F.length("content") % 5).cast("int"))
    rows = turns(spark, sf_dir).select(*KEY, predicted.alias("predicted"), F.when(predicted.isNotNull(), 0.9).alias("sure"))
    class_id, confidence = policies.with_default(F.col("predicted"), F.col("sure"))
    rows = rows.select(*KEY, class_id.alias("class_id"), confidence.alias("confidence"))
    others = F.transform(policies.alternatives(F.col("class_id")), lambda x: x["name"])
    return rows.withColumn("alternatives", F.array_join(others, ","))


# --- data that is generated from the ids of a table -----------------------------------------------------------------------------------------------


def _sessions(spark, sf_dir):
    return turns(spark, sf_dir).select(F.col("session_id").alias("id")).distinct()


def _at(values: list[str], i: str) -> str:
    return f"{R.names(values)}[{i} % {len(values)} + 1]"


@query(
    f"""WITH x AS (SELECT item_id AS i FROM benchmark) SELECT 'S' || i AS id, 'Our updated ' || {_at(generators.TOPICS, 'i')} || {R.q(generators.CREDIT)} AS content,
    'Can you summarize the new ' || {_at(generators.TOPICS, 'i')} || ' policy about billing credits?' AS query FROM x"""
)
def golden_semantic(spark, sf_dir):
    return generators.golden(query_texts(spark, sf_dir).select(F.col("query_id").alias("id"))).where("stratum = 'semantic_search'").select("id", "content", "query")


@query(
    f"""WITH x AS (SELECT item_id AS i FROM benchmark) SELECT 'R' || i AS id, {_at(generators.PEOPLE, 'i')} || ' joined ' || {_at(generators.COMPANIES, 'i')} || ' as a ' || {_at(generators.ROLES, 'i')}
    || ' on 2025-03-' || (10 + i % 10) || '.' AS content, 'Which company did ' || {_at(generators.PEOPLE, 'i')} || ' join?' AS query FROM x"""
)
def golden_relationship(spark, sf_dir):
    return generators.golden(query_texts(spark, sf_dir).select(F.col("query_id").alias("id"))).where("stratum = 'relationship_memory'").select("id", "content", "query")


@query(
    f"""WITH x AS (SELECT item_id AS i FROM benchmark) SELECT 'C' || i AS id, CASE WHEN i % 2 = 0 THEN {_at(generators.ACTIONABLE, 'i')} ELSE {_at(generators.POLITE, 'i')} END AS content,
    CASE WHEN i % 2 = 0 THEN 'What actionable item should I schedule?' ELSE 'Is there anything to store here?' END AS query FROM x"""
)
def golden_flow(spark, sf_dir):
    return generators.golden(query_texts(spark, sf_dir).select(F.col("query_id").alias("id"))).where("stratum = 'conversation_flow'").select("id", "content", "query")


_GENERATED = "[" + ", ".join(R.names(t) for _, t in generators.TURN_PATTERNS) + "]"


@query(
    f"""WITH x AS (SELECT conv_id * 1000 + turn AS i FROM conversations) SELECT i AS turn_id, {_at([n for n, _ in generators.TURN_PATTERNS], 'i')} AS pattern,
    replace({_GENERATED}[i % 5 + 1][(i // 5) % 3 + 1], '{{n}}', i::VARCHAR) AS content, CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END AS speaker FROM x"""
)
def generated_turns(spark, sf_dir):
    return generators.pattern_turns(turns(spark, sf_dir).select(F.col("item_id").alias("id")))


@query(
    f"""WITH x AS (SELECT doc_id AS i, (SELECT count(*) FROM documents) AS n FROM documents), c AS (SELECT i, least(i // greatest(n // 3, 1), 2) AS label FROM x)
    SELECT i AS id, label::INT AS label, replace([{', '.join(R.names(t) for t in generators.CLASS_TEXTS)}][label + 1][i % 3 + 1], '{{n}}', i::VARCHAR) AS content FROM c"""
)
def generated_classes(spark, sf_dir):
    ids = documents(spark, sf_dir).select(F.col("doc_id").alias("id"))
    return generators.class_examples(ids, ids.count())


@query(
    f"""WITH x AS (SELECT DISTINCT conv_id AS i FROM conversations), t AS (SELECT i, i % 6 AS k, unnest(range(4)) AS turn FROM x)
    SELECT i AS conversation_id, {_at([n for n, _ in generators.CONVERSATIONS], 'i')} AS template, turn::INT AS turn, CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END AS speaker,
    replace([{', '.join(R.names(t) for _, t in generators.CONVERSATIONS)}][k + 1][turn + 1], '{{n}}', i::VARCHAR) AS content FROM t"""
)
def generated_conversations(spark, sf_dir):
    return generators.conversations(_sessions(spark, sf_dir))


@query(
    f"""WITH t AS (SELECT conv_id AS i, turn FROM conversations),
    g AS (SELECT i AS session, turn, replace({_at([m for _, m in generators.SCENARIOS], 'i')}, '{{n}}', turn::VARCHAR) AS content FROM t)
    SELECT *, {R.three_class('content')} AS action FROM g"""
)
def simulated_scenarios(spark, sf_dir):
    rows = generators.scenarios(turns(spark, sf_dir).select(F.col("session_id").alias("id"), F.col("turn_no").alias("turn")))
    return rows.withColumn("action", policies.three_class(F.col("content")))


@query(
    f"""WITH x AS (SELECT DISTINCT conv_id AS session FROM conversations),
    s AS (SELECT * FROM (VALUES {', '.join(f'({i}, {R.q(s)}, {R.q(c)})' for i, (s, c) in enumerate(generators.SAMPLE_TURNS))}) v(turn, speaker, content)) SELECT * FROM x, s"""
)
def sample_session(spark, sf_dir):
    return generators.sample_session(_sessions(spark, sf_dir))
