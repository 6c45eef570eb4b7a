"""Queries on content: primitives, features, policies and prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.functions import constants as C
from turnmill.functions import features, pricing
from turnmill.functions import text as T
from turnmill.operators import policies, sessions
from turnmill.plans import registry as R
from turnmill.plans.registry import DOCS, TURNS, query
from turnmill.sources.tables import documents, turns

KEY = ["session_id", "turn_no"]


def named(items):
    return [v.alias(k) for k, v in items.items()]


@query(
    rf"""WITH {DOCS} SELECT doc_id, len({R.tokens('content')}) AS n_tokens, len(list_distinct({R.tokens('content')})) AS n_distinct,
    len({R.words('content')}) AS n_words, {R.sentences('content')} AS n_sentences, {R.token_estimate('content')} AS token_estimate,
    greatest(1, length(content) // 4)::INT AS rough_tokens,
    CASE WHEN length(content) > 100 THEN substr(content, 1, 100) || '...' ELSE content END AS preview,
    {R.size_class(R.token_estimate('content'))} AS size_class,
    array_to_string(list_slice(list_filter({R.words('content')}, lambda x: regexp_matches(x, '^[A-Z][A-Za-z]{{2,}}$')), 1, 5), ' ') AS entities,
    sha256(content) AS sha256 FROM d"""
)
def text_primitives(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id",
        F.size(T.tokens(F.col("content"))).alias("n_tokens"),
        F.size(T.token_set(F.col("content"))).alias("n_distinct"),
        T.word_count(F.col("content")).alias("n_words"),
        T.sentence_count(F.col("content")).alias("n_sentences"),
        T.token_estimate(F.col("content")).alias("token_estimate"),
        T.rough_tokens(F.col("content")).alias("rough_tokens"),
        T.preview(F.col("content")).alias("preview"),
        T.size_class(T.token_estimate(F.col("content"))).alias("size_class"),
        F.array_join(T.entities(F.col("content")), " ").alias("entities"),
        F.sha2(F.col("content"), 256).alias("sha256"),
    )


@query(f"WITH {DOCS} SELECT doc_id, {R.columns(R.flags('content'))} FROM d")
def content_flags(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", *named(features.content_flags(F.col("content"))))


@query(
    f"""WITH {TURNS}, f AS (SELECT *, {R.columns(R.flags('content'))} FROM t)
    SELECT session_id, turn_no, {R.PRIORITY} AS priority, {R.CONTENT_TYPE} AS content_type, length(content) AS length,
    len({R.words('content')}) AS word_count, {R.sentences('content')} AS sentence_count,
    {R.average_length(R.words('content'))} AS avg_word_length FROM f"""
)
def content_priority_type(spark, sf_dir):
    flags = features.content_flags(F.col("content"))
    return turns(spark, sf_dir).select(
        *KEY,
        features.priority(flags, F.col("speaker")).alias("priority"),
        features.content_type(flags).alias("content_type"),
        F.length(F.col("content")).alias("length"),
        T.word_count(F.col("content")).alias("word_count"),
        T.sentence_count(F.col("content")).alias("sentence_count"),
        T.average_length(T.words(F.col("content"))).alias("avg_word_length"),
    )


@query(
    rf"""WITH {TURNS} SELECT session_id, turn_no, length(content) AS length, len({R.words('content')}) AS word_count,
    regexp_matches(content, '[0-9]') AS has_numbers, contains(content, '?') AS has_questions,
    len(list_filter({R.words('content')}, lambda w: regexp_matches(w, '^\p{{Lu}}[^\p{{Lu}}]*$'))) > 0 AS has_names,
    length(content) < 20 AS is_short, coalesce(speaker, 'unknown') AS speaker FROM t"""
)
def content_analysis_basic(spark, sf_dir):
    title = F.size(F.filter(T.words(F.col("content")), lambda w: w.rlike(r"^\p{Lu}[^\p{Lu}]*$"))) > 0
    return turns(spark, sf_dir).select(
        *KEY,
        F.length(F.col("content")).alias("length"),
        T.word_count(F.col("content")).alias("word_count"),
        F.col("content").rlike("[0-9]").alias("has_numbers"),
        F.col("content").contains("?").alias("has_questions"),
        title.alias("has_names"),
        (F.length(F.col("content")) < 20).alias("is_short"),
        F.coalesce(F.col("speaker"), F.lit("unknown")).alias("speaker"),
    )


_FEATURES = {
    "char_count": "length(content)",
    "word_count": f"len({R.words('content')})",
    "token_count": "length(content) / 4.2::DOUBLE",
    "sentence_count": R.sentences("content"),
    "avg_word_length": R.average_length(R.words("content")),
    "is_very_short": "length(content) < 4",
    "is_short": f"len({R.words('content')}) < 4",
    "discard_pattern_count": R.occurrences(R.plain("lower(content)"), C.ROUTER_DISCARD),
    "is_acknowledgment": R.has_part("content", C.ROUTER_ACKS),
    "is_greeting": R.has_part("content", C.ROUTER_GREETINGS),
    "has_proper_names": R.matches("content", [r"\b[A-Z][a-z]+\b"]),
    "has_numbers": R.matches("content", [r"\b\d+\b"]),
    "has_dates": R.matches("content", [r"\b\d{1,2}[/-]\d{1,2}\b"]),
    "factual_pattern_count": R.occurrences(R.plain("content"), C.ROUTER_FACTUAL),
    "has_email": "contains(content, '@') AND contains(content, '.')",
    "has_phone": r"regexp_matches(content, '\d{3}[-.]?\d{3}[-.]?\d{4}')",
    "has_question_mark": "contains(content, '?')",
    "question_pattern_count": R.occurrences(R.plain("lower(content)"), C.ROUTER_QUESTION),
    "starts_with_question_word": R.starts("content", C.QUESTION_WORDS),
    "is_long": "length(content) > 500",
    "is_very_long": "length(content) > 1000",
    "paragraph_count": r"len(list_filter(string_split(content, chr(10)), lambda s: regexp_matches(s, '\S')))",
    "has_multiple_sentences": f"{R.count_char('content', '.')} > 2",
    "complexity_ratio": f"len(list_distinct({R.words('content')}))::DOUBLE / greatest(1, len({R.words('content')}))",
    "exclamation_count": R.count_char("content", "!"),
    "comma_count": R.count_char("content", ","),
    "semicolon_count": R.count_char("content", ";"),
    "punctuation_ratio": R.count_matching("content", r"[^\p{L}\p{N}]") + "::DOUBLE / greatest(1, length(content))",
    "speaker_is_user": "speaker = 'user'",
    "turn_number": "turn_count",
    "session_length": "count(*) OVER (PARTITION BY session_id)",
    "time_since_last": "CASE WHEN turn_count = 0 THEN 0 ELSE 60 * (turn_no - lag(turn_no) OVER (PARTITION BY session_id ORDER BY turn_no)) END",
}


def router_input(spark, sf_dir):
    from pyspark.sql import Window as W

    order = W.partitionBy("session_id").orderBy("turn_no", "item_id")
    since = F.coalesce(F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(order)), F.lit(0))
    rows = turns(spark, sf_dir).withColumns(
        {
            "turn_number": F.row_number().over(order) - 1,
            "session_length": F.count(F.lit(1)).over(W.partitionBy("session_id")),
            "since": since,
        }
    )
    found = features.router_features(F.col("content"), F.col("speaker"), F.col("turn_number"), F.col("session_length"), F.col("since"))
    return rows, found


@query(f"WITH {TURNS} SELECT session_id, turn_no, {R.columns({k: f'({v})::DOUBLE' for k, v in _FEATURES.items()})} FROM t")
def router_features(spark, sf_dir):
    rows, found = router_input(spark, sf_dir)
    return rows.select(*KEY, *named(found))


_BASIC = {
    "word_count": f"len({R.words('content')})",
    "char_count": "length(content)",
    "sentence_count": R.sentences("content"),
    "avg_word_length": R.average_length(R.words("content")),
    "question_mark_count": R.count_char("content", "?"),
    "exclamation_count": R.count_char("content", "!"),
    "uppercase_ratio": R.count_matching("content", r"\p{Lu}") + "::DOUBLE / greatest(length(content), 1)",
    "digit_count": R.count_matching("content", r"\p{Nd}"),
    "punctuation_count": R.count_matching("content", r"[^\p{L}\p{N}\s]"),
    "is_very_short": f"(len({R.words('content')}) <= 4)::INT",
    "is_short": f"(len({R.words('content')}) <= 10)::INT",
    "is_medium": f"(len({R.words('content')}) BETWEEN 11 AND 50)::INT",
    "is_long": f"(len({R.words('content')}) > 50)::INT",
    **{f"starts_with_{w}": f"starts_with(lower(content), '{w}')::INT" for w in ("what", "how", "when", "where", "why")},
    "ends_with_question": f"ends_with({R.stripped('content')}, '?')::INT",
}


@query(f"WITH {DOCS} SELECT doc_id, {R.columns(_BASIC)} FROM d")
def basic_text_features(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", *named(features.basic_text_features(F.col("content"))))


@query(
    f"""WITH {TURNS} SELECT session_id, turn_no, length(content) AS context_length, {R.has_part('content', C.PERSONAL_CONTEXT)}::INT AS context_has_personal,
    {R.has_part('content', C.TECHNICAL_CONTEXT)}::INT AS context_has_technical, {R.has_part('content', C.CASUAL_CONTEXT)}::INT AS context_has_casual,
    {R.has_part('content', C.TASK_CONTEXT)}::INT AS context_has_task, (speaker = 'user')::INT AS is_user, (speaker = 'assistant')::INT AS is_assistant FROM t"""
)
def context_cue_features(spark, sf_dir):
    return turns(spark, sf_dir).select(*KEY, *named(features.context_cues(F.col("content"), F.col("speaker"))))


@query(
    f"""WITH {TURNS} SELECT session_id, turn_no, array_to_string(list_transform([turn_count, length(content), len({R.words('content')}), turn_count,
    turn_no - min(turn_no) OVER (PARTITION BY session_id), (speaker = 'user')::INT, contains(content, '?')::INT, 0, 0, 0], lambda x: x::BIGINT::VARCHAR), ',') AS features FROM t"""
)
def context_features_policy(spark, sf_dir):
    rows = policies.with_session_context(turns(spark, sf_dir))
    made = features.policy_context_features(F.col("content"), F.col("speaker"), F.col("turn_count"), F.col("turn_count"), F.col("minutes"))
    return rows.select(*KEY, F.array_join(F.transform(made, lambda x: x.cast("long").cast("string")), ",").alias("features"))


@query(
    f"""WITH {TURNS} SELECT session_id, turn_no, length(content)::DOUBLE AS length, (speaker = 'assistant')::INT::DOUBLE AS is_assistant,
    turn_count::DOUBLE / greatest(1, turn_count + 1) AS turn_ratio, 0.5::DOUBLE AS budget, {R.has_part('content', C.PERSONAL_INFO)}::INT::DOUBLE AS personal,
    (len({R.words('content')}) < 5)::INT::DOUBLE AS short FROM t"""
)
def context_features_training(spark, sf_dir):
    rows = policies.with_session_context(turns(spark, sf_dir))
    f = features.training_context_features(F.col("content"), F.col("speaker"), F.col("turn_count"))
    parts = {"length": 1, "is_assistant": 3, "turn_ratio": 4, "budget": 5, "personal": 8, "short": 9}
    return rows.select(*KEY, *[F.get(f, i).alias(n) for n, i in parts.items()])


_WHO = "'[' || coalesce(speaker, 'unknown') || ']: '"


@query(
    f"""WITH {TURNS}, p AS (SELECT *, {_WHO} || substr(content, 1, 100) AS said FROM t),
    l AS (SELECT *, lag(said, 1) OVER w AS one, lag(said, 2) OVER w AS two FROM p WINDOW w AS (PARTITION BY session_id ORDER BY turn_no)),
    x AS (SELECT *, CASE WHEN one IS NULL THEN '' ELSE 'Context: ' || coalesce(two || ' | ', '') || one || ' | ' END
          || 'Turn ' || turn_count || ', Budget: standard | Current: ' || {_WHO} AS prefix FROM l),
    a AS (SELECT *, greatest(100, (512 - length(prefix)) * 4) AS room FROM x)
    SELECT session_id, turn_no, prefix || CASE WHEN length(content) > room THEN substr(content, 1, (room * 2 // 3)::INT) || '...'
    || right(content, (room - room * 2 // 3 - 3)::INT) ELSE content END AS model_input,
    'Context: ' || coalesce(coalesce(two || ' | ', '') || one, 'Start of conversation') || ' | Turn ' || turn_count
    || ', Budget: standard | Current: [' || speaker || ']: ' || content AS training_input FROM a"""
)
def model_input_text(spark, sf_dir):
    rows = sessions.with_recent_turns(turns(spark, sf_dir), 2)
    args = (F.col("content"), F.col("speaker"), F.col("recent"), F.col("turn_count"))
    return rows.select(*KEY, features.model_input(*args).alias("model_input"), features.training_input(*args).alias("training_input"))


@query(
    f"""WITH {DOCS} SELECT doc_id, length(content) AS content_length, len({R.words('content')}) AS word_count, contains(content, '?') AS has_question,
    {R.has_part('content', C.STRUCTURED_PARTS)} AS has_structured_data,
    CASE WHEN {R.has_part('content', C.STRUCTURED_PARTS)} OR contains(content, '?') THEN 'high' WHEN length(content) > 500 THEN 'medium' ELSE 'low' END AS priority FROM d"""
)
def policy_analysis(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", *named(features.policy_analysis(F.col("content"))))


# --- policies -----------------------------------------------------------------------------------------------------


@query(f"WITH {DOCS} SELECT doc_id, {R.three_class('content')} AS route FROM d")
def route_3class(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", policies.three_class(F.col("content")).alias("route"))


_STRIPPED = f"s AS (SELECT *, {R.stripped('content')} AS s FROM t), f AS (SELECT *, {R.columns(R.flags('s'))} FROM s)"


@query(f"WITH {TURNS}, {_STRIPPED} SELECT session_id, turn_no, {R.HEURISTIC} AS action FROM f")
def route_heuristic(spark, sf_dir):
    return turns(spark, sf_dir).select(*KEY, policies.heuristic_action(F.col("content"), F.col("speaker")).alias("action"))


_PLACED = (
    f"g AS (SELECT *, {R.columns(R.flags('content'))} FROM t), p AS (SELECT *, {R.PRIORITY} AS priority, {R.CONTENT_TYPE} AS content_type FROM g)"
)


@query(f"WITH {TURNS}, {_PLACED} SELECT session_id, turn_no, {R.BACKEND} AS backend FROM p")
def choose_backend(spark, sf_dir):
    rows = policies.with_session_context(turns(spark, sf_dir))
    return rows.select(*KEY, policies.choose_backend(F.col("content"), F.col("speaker"), F.col("turn_count"), F.col("minutes")).alias("backend"))


_FALLBACK = (
    f"r AS (SELECT *, CASE WHEN length(content) < 4 OR {R.has_part('content', C.ROUTER_ACKS)} OR {R.has_part('content', C.ROUTER_GREETINGS)} THEN 'discard'"
    f" WHEN length(content) > 1000 OR {R.count_char('content', '.')} > 2 THEN 'compress' ELSE 'store' END AS route FROM t)"
)
_SURE = "CASE route WHEN 'discard' THEN 0.9 WHEN 'compress' THEN 0.8 ELSE 0.7 END::DOUBLE"


@query(f"WITH {TURNS}, {_FALLBACK} SELECT session_id, turn_no, route, {_SURE} AS confidence FROM r")
def route_router_fallback(spark, sf_dir):
    rows, found = router_input(spark, sf_dir)
    name, sure = policies.router_fallback(found)
    return rows.select(*KEY, name.alias("route"), sure.alias("confidence"))


@query(
    f"""WITH {TURNS}, {_FALLBACK}, s AS (SELECT *, {R.stripped('content')} AS s FROM r), f AS (SELECT *, {R.columns(R.flags('s'))} FROM s)
    SELECT session_id, turn_no, CASE route WHEN 'discard' THEN 'drop' WHEN 'compress' THEN 'summarize' ELSE {R.HEURISTIC} END AS action FROM f"""
)
def route_gated(spark, sf_dir):
    rows, found = router_input(spark, sf_dir)
    name, sure = policies.router_fallback(found)
    return rows.select(*KEY, policies.gated(name, sure, policies.heuristic_action(F.col("content"), F.col("speaker"))).alias("action"))


@query(
    f"""WITH {DOCS} SELECT doc_id, CASE WHEN length(content) < 10 OR len({R.words('content')}) < 3 OR {R.has_part('content', C.CHITCHAT_PARTS)} THEN 'drop'
    WHEN length(content) > 500 OR len({R.words('content')}) > 80 THEN 'summarize' ELSE 'store' END AS action FROM d"""
)
def route_simple_policy(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", policies.simple_action(F.col("content")).alias("action"))


@query(
    f"""WITH {DOCS} SELECT doc_id, CASE WHEN {R.has_part('content', C.PLACEMENT_PARTS)} OR contains(content, '?') THEN 'faiss_store'
    WHEN length(content) < 200 THEN 'memory_store' WHEN length(content) > 1000 THEN 'file_store' ELSE 'memory_store' END AS backend FROM d"""
)
def preferred_backend(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", policies.preferred_backend(F.col("content")).alias("backend"))


_N = f"len({R.words('content')})"
_FIVE = f"""CASE WHEN {_N} <= 4 OR lower(content) IN ({', '.join(map(R.q, C.SOCIAL_EXACT))}) THEN 0
    WHEN {R.has_part('content', C.KEY_VALUE_PARTS)} AND {_N} < 25 THEN 1
    WHEN starts_with(lower(content), 'what') OR starts_with(lower(content), 'how') OR contains(lower(content), 'prefer') THEN 2
    WHEN {R.has_part('content', C.RELATION_PARTS)} OR {_N} > 30 THEN CASE WHEN contains(lower(content), ' and ') AND {_N} < 100 THEN 3 ELSE 4 END ELSE 2 END"""


@query(f"WITH {DOCS} SELECT doc_id, {_FIVE} AS class_id FROM d")
def route_5class_rules(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", policies.five_class(F.col("content"))[0].alias("class_id"))


@query(
    f"""WITH {DOCS}, r AS (SELECT doc_id, {R.three_class('content')} AS route FROM d)
    SELECT doc_id, route, CASE route WHEN 'discard' THEN 1 WHEN 'store' THEN 8 ELSE 15 END AS cents,
    CASE route WHEN 'discard' THEN 7 WHEN 'store' THEN 30 ELSE 50 END AS ms,
    CASE route WHEN 'discard' THEN 'drop' WHEN 'compress' THEN 'summarize' ELSE 'store' END AS action FROM r"""
)
def route_cost_latency(spark, sf_dir):
    name = policies.three_class(F.col("content"))
    cents, ms = policies.route_cost(F.col("route"))
    rows = documents(spark, sf_dir).select("doc_id", name.alias("route"))
    return rows.select("doc_id", "route", cents.alias("cents"), ms.alias("ms"), policies.action_of(F.col("route")).alias("action"))


@query(
    f"""WITH {TURNS}, {_PLACED}, s AS (SELECT *, {R.stripped('content')} AS s FROM t),
    f AS (SELECT *, {R.columns(R.flags('s'))} FROM s), a AS (SELECT session_id, turn_no, {R.HEURISTIC} AS wanted FROM f),
    j AS (SELECT p.*, a.wanted, {R.BACKEND} AS placed,
          CASE WHEN a.wanted = 'store' THEN greatest(0, round_even(0.05::DOUBLE + {R.token_estimate('content')} * 0.0001::DOUBLE + 0.01::DOUBLE / 30.0::DOUBLE, 0)::INT) END AS predicted_cents
          FROM p JOIN a USING (session_id, turn_no))
    SELECT session_id, turn_no, item_id, priority, content_type, CASE WHEN predicted_cents > 0.1 THEN 'drop' ELSE wanted END AS action,
    CASE WHEN wanted <> 'drop' AND NOT coalesce(predicted_cents > 0.1, false) THEN placed END AS backend, predicted_cents, 67.5::DOUBLE AS predicted_ms, turn_count FROM j"""
)
def route_flagship(spark, sf_dir):
    return policies.routed(turns(spark, sf_dir))


@query(
    f"""WITH {TURNS}, {_STRIPPED}, h AS (SELECT session_id, turn_no, {R.HEURISTIC} AS action FROM f)
    SELECT session_id, turn_no, action, CASE action WHEN 'drop' THEN 0 WHEN 'summarize' THEN 2 ELSE 1 END AS class_id, 'store' AS naive_action FROM h"""
)
def action_classes(spark, sf_dir):
    rows = turns(spark, sf_dir).select(*KEY, policies.policy("heuristic")(F.col("content"), F.col("speaker")).alias("action"), policies.policy("store_all")(F.col("content"), F.col("speaker")).alias("naive_action"))
    ids = F.create_map(*[F.lit(x) for pair in policies.CLASS_IDS.items() for x in pair])
    return rows.withColumn("class_id", ids[policies.class_of(F.col("action"))])


IMPORTANCES = {"char_count": 0.2, "word_count": 0.3, "comma_count": 0.15, "sentence_count": 0.1, "complexity_ratio": 0.15, "is_greeting": 0.1}


@query(
    f"""WITH {TURNS}, f AS (SELECT session_id, turn_no, {R.columns({k: f'({v})::DOUBLE' for k, v in _FEATURES.items()})} FROM t),
    u AS (SELECT session_id, turn_no, unnest({R.names(list(IMPORTANCES))}) AS name,
          unnest([{', '.join(f'abs({k}) * {v}::DOUBLE' for k, v in IMPORTANCES.items())}]) AS weight FROM f)
    SELECT session_id, turn_no, name, weight, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY session_id, turn_no ORDER BY weight DESC, name)::INT AS rank FROM u) WHERE rank <= 5"""
)
def explain_routes(spark, sf_dir):
    rows, found = router_input(spark, sf_dir)
    top = rows.select(*KEY, F.posexplode(policies.top_features(found, IMPORTANCES)).alias("at", "x"))
    return top.select(*KEY, F.col("x.name").alias("name"), F.col("x.weight").alias("weight"), (F.col("at") + 1).alias("rank"))


# --- prices -------------------------------------------------------------------------------------------------------

#: A sample pricebook (backend, op, write, read, index, gc, base, per token, per k, per log n, p50, p95).
SAMPLE_PRICES = [
    ("memory_store", "store", 0.01, 0.0, 0.001, 0.0001, 1, 0, 0.1, 0.1, 1.0, 2.5),
    ("faiss_store", "store", 0.06, 0.0, 0.02, 0.001, 2, 40, 0.5, 1.0, 40.0, 110.0),
    ("faiss_store", "retrieve", 0.0, 0.3, 0.02, 0.001, 1, 10, 0.4, 0.5, 25.0, 60.0),
]
_BOOK = "b AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(R.q(x) if isinstance(x, str) else f"{x}::DOUBLE" for x in row) + ")" for row in SAMPLE_PRICES
) + ") v(backend, op, wr, rd, ix, gc, base, per_token, per_k, per_logn, p50, p95))"
_OPS = "o AS (SELECT * FROM (VALUES ('store'), ('retrieve'), ('maintain'), ('summarize')) v(op)), n AS (SELECT * FROM (VALUES ('memory_store'), ('faiss_store'), ('file_store')) v(backend))"


@query(
    f"""WITH {TURNS}, {_BOOK}, {_OPS},
    x AS (SELECT t.session_id, t.turn_no, n.backend, o.op, {R.token_estimate('content')} AS n_tokens, coalesce(wr, 0.05) AS wr, coalesce(rd, 0.02) AS rd,
          coalesce(ix, 0.01) AS ix, coalesce(b.gc, 0.005) AS gc, coalesce(base, 0) AS base, coalesce(per_token, 0) AS per_token, coalesce(per_k, 0) AS per_k,
          coalesce(per_logn, 0) AS per_logn, coalesce(p50, 50) AS p50, coalesce(p95, 120) AS p95, 100 + t.turn_no AS n_items
          FROM t CROSS JOIN n CROSS JOIN o LEFT JOIN b ON b.backend = n.backend AND b.op = o.op)
    SELECT session_id, turn_no, backend, op, greatest(0, round_even(CASE op WHEN 'store' THEN wr + n_tokens * 0.0001::DOUBLE + ix / 30.0::DOUBLE
      WHEN 'retrieve' THEN rd + 5 * 0.002::DOUBLE + log10(n_items) * 0.001::DOUBLE WHEN 'maintain' THEN ix * n_items + gc * n_items * 4.0::DOUBLE
      ELSE base + per_token * n_tokens / 1e6::DOUBLE + per_k * 5 + per_logn * log10(n_items) END, 0)::INT) AS predicted_cents, p50 + (p95 - p50) * 0.25::DOUBLE AS predicted_ms FROM x"""
)
def predict_costs(spark, sf_dir):
    ops = F.explode(F.array(*map(F.lit, ("store", "retrieve", "maintain", "summarize"))))
    backends = F.explode(F.array(*[F.lit(n) for n, _ in C.BACKENDS]))
    rows = turns(spark, sf_dir).select(*KEY, T.token_estimate(F.col("content")).alias("n_tokens"), (F.col("turn_no") + 100).alias("n_items"), ops.alias("op"))
    rows = rows.withColumn("backend", backends).withColumn("k", F.lit(5)).withColumn("concurrency", F.lit("single"))
    priced = pricing.with_prices(rows, pricing.pricebook(spark, SAMPLE_PRICES))
    return pricing.predicted(priced).select(*KEY, "backend", "op", "predicted_cents", "predicted_ms")


@query(
    f"""WITH {DOCS}, x AS (SELECT doc_id, content, {R.token_estimate('content')} AS n FROM d)
    SELECT doc_id, 0.05::DOUBLE + n * 0.0001::DOUBLE + 0.01::DOUBLE / 30.0::DOUBLE AS write_cents, 0.02::DOUBLE + 5 * 0.002::DOUBLE + log10(greatest(1, n)) * 0.001::DOUBLE AS read_cents,
    0.001::DOUBLE * (length(content) / 1000000.0::DOUBLE) AS storage_cents, 0.01::DOUBLE * n + 0.005::DOUBLE * n * 4.0::DOUBLE AS maintenance_cents, {R.size_class('n')} AS size_class,
    CASE WHEN n < 1000 THEN 'low' WHEN n < 10000 THEN 'medium' WHEN n < 100000 THEN 'high' ELSE 'critical' END AS pressure FROM x"""
)
def unit_costs(spark, sf_dir):
    n = F.col("n")
    rows = documents(spark, sf_dir).withColumn("n", T.token_estimate(F.col("content")))
    return rows.select(
        "doc_id",
        pricing.write_cost(n).alias("write_cents"),
        pricing.read_cost(F.lit(5), n).alias("read_cents"),
        pricing.storage_cost(F.length(F.col("content")) / 1000000.0).alias("storage_cents"),
        pricing.maintenance_cost(n).alias("maintenance_cents"),
        T.size_class(n).alias("size_class"),
        T.pressure_class(n).alias("pressure"),
    )


_MODELS = "m AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {p}::DOUBLE)" for n, p in C.SUMMARY_PRICES) + ") v(model, price))"
_FACTORS = "z AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {p}::DOUBLE)" for n, p in C.SIZE_FACTORS) + ") v(size_class, factor))"


@query(
    f"""WITH {DOCS}, {_MODELS}, {_FACTORS}, x AS (SELECT doc_id, {R.size_class(R.token_estimate('content'))} AS size_class FROM d)
    SELECT doc_id, model, size_class, price * factor AS cents, CASE WHEN contains(model, 'gpt') THEN 2000 ELSE 500 END AS ms FROM x JOIN z USING (size_class) CROSS JOIN m"""
)
def summarization_costs(spark, sf_dir):
    models = F.explode(F.array(*[F.lit(n) for n, _ in C.SUMMARY_PRICES]))
    rows = documents(spark, sf_dir).select("doc_id", T.size_class(T.token_estimate(F.col("content"))).alias("size_class"), models.alias("model"))
    joined = rows.join(pricing.size_factors(spark), "size_class").join(pricing.summary_prices(spark), "model")
    ms = F.when(F.col("model").contains("gpt"), 2000).otherwise(500)
    return joined.select("doc_id", "model", "size_class", (F.col("price") * F.col("factor")).alias("cents"), ms.alias("ms"))


@query(
    f"""WITH {DOCS} SELECT doc_id, 0.0::DOUBLE AS memory_store, 1e-5::DOUBLE * least(length(content) / 1000.0::DOUBLE, 2.0::DOUBLE) AS file_store,
    1e-4::DOUBLE * least(length(content) / 500.0::DOUBLE, 3.0::DOUBLE) + 1e-4::DOUBLE AS vector_store,
    1e-4::DOUBLE * least(30 / 100.0::DOUBLE, 10.0::DOUBLE) * least(5 / 5.0::DOUBLE, 2.0::DOUBLE) AS file_retrieve,
    1e-4::DOUBLE * least(length(content) / 200.0::DOUBLE, 2.0::DOUBLE) + 1e-4::DOUBLE * least(5 / 5.0::DOUBLE, 1.5::DOUBLE) * least(500 / 1000.0::DOUBLE, 2.0::DOUBLE) AS vector_retrieve,
    (length(content) / 1000.0::DOUBLE * 0.03::DOUBLE + 150 / 1000.0::DOUBLE * 0.06::DOUBLE) * 100 AS gpt_summary,
    len({R.words('content')}) / 1000.0::DOUBLE * 0.00015::DOUBLE + 150 / 1000.0::DOUBLE * 0.0006::DOUBLE AS labelling, greatest(10, length(content) // 10)::INT AS naive FROM d"""
)
def backend_cost_formulas(spark, sf_dir):
    k, n, files = F.lit(5), F.lit(500), F.lit(30)
    return documents(spark, sf_dir).select(
        "doc_id",
        F.lit(0.0).alias("memory_store"),
        pricing.file_store_cost(F.col("content")).alias("file_store"),
        pricing.vector_store_cost(F.col("content")).alias("vector_store"),
        pricing.file_retrieve_cost(files, k).alias("file_retrieve"),
        pricing.vector_retrieve_cost(F.col("content"), k, n).alias("vector_retrieve"),
        pricing.summary_cost_gpt(F.length(F.col("content")), F.lit(150)).alias("gpt_summary"),
        pricing.labelling_cost(T.word_count(F.col("content")), F.lit(150)).alias("labelling"),
        F.greatest(F.lit(10), F.floor(F.length(F.col("content")) / 10).cast("int")).alias("naive"),
    )
