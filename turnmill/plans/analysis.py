"""Queries on filters, retrieval, sessions and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.functions import constants as C
from turnmill.functions import text as T
from turnmill.operators import filters, metrics, policies, retrieval, sessions, summaries
from turnmill.operators.text_index import TextIndex
from turnmill.operators.vector_index import VectorIndex
from turnmill.plans import registry as R
from turnmill.plans.registry import DOCS, TURNS, query
from turnmill.sources import generators
from turnmill.sources.shared import shared_folder
from turnmill.sources.tables import documents, query_texts, read, telemetry, turns

KEY = ["session_id", "turn_no"]

# --- filters ------------------------------------------------------------------------------------------------------

# Turns with metadata: `lang` on even turns only, so that strict and lenient filters differ.
_META = "m AS (SELECT *, CASE WHEN turn_no % 2 = 0 THEN CASE WHEN length(content) % 3 = 0 THEN 'en' ELSE 'fr' END END AS lang FROM t)"


def with_metadata(spark, sf_dir):
    lang = F.when(F.length("content") % 3 == 0, "en").otherwise("fr")
    meta = F.when(F.col("turn_no") % 2 == 0, F.create_map(F.lit("lang"), lang)).otherwise(F.create_map().cast("map<string,string>"))
    return turns(spark, sf_dir).withColumn("metadata", meta)


@query(f"WITH {TURNS}, {_META} SELECT session_id, turn_no FROM m WHERE speaker = 'user' AND lang = 'en'")
def filter_strict(spark, sf_dir):
    wanted = filters.metadata_strict(F.col("speaker"), F.col("metadata"), {"speaker": "user", "lang": "en"})
    return with_metadata(spark, sf_dir).where(wanted).select(*KEY)


@query(f"WITH {TURNS}, {_META} SELECT session_id, turn_no FROM m WHERE speaker = 'user' AND (lang IS NULL OR lang = 'en')")
def filter_lenient(spark, sf_dir):
    wanted = filters.metadata_lenient(F.col("speaker"), F.col("metadata"), {"speaker": "user", "lang": "en"})
    return with_metadata(spark, sf_dir).where(wanted).select(*KEY)


@query(
    rf"""WITH {TURNS} SELECT session_id, turn_no, length(content) BETWEEN 2 AND 2000 AND regexp_matches(content, '\S') AND item_id % 5 <= 3 AND length(content) * 100 <= 10000
    AND turn_no % 7 <> 3 AND item_id % 11 <> 5 AS valid_example, length(content) BETWEEN 1 AND 10000 AND speaker IN ('user', 'assistant') AND session_id % 13 <> 4 AS valid_request FROM t"""
)
def validity(spark, sf_dir):
    # Features beyond the range, not a number or too few, labels beyond the last class, and names with a blank occur.
    raw = [F.length("content") * 100.0, F.when(F.col("turn_no") % 7 == 3, float("nan")).otherwise(F.col("turn_no")), *map(F.lit, [0.5] * 7)]
    made = F.when(F.col("item_id") % 11 == 5, F.array(*raw)).otherwise(F.array(*raw, F.lit(1.0)))
    session = F.concat(F.when(F.col("session_id") % 13 == 4, "s ").otherwise("s-"), F.col("session_id").cast("string"))
    return turns(spark, sf_dir).select(
        *KEY,
        filters.valid_example(F.col("content"), F.col("item_id") % 5, made).alias("valid_example"),
        filters.valid_request(F.col("content"), F.col("speaker"), session).alias("valid_request"),
    )


@query(
    f"""WITH {DOCS}, x AS (SELECT doc_id, {R.token_estimate('content')} * 0.0001::DOUBLE AS cost, length(content) / 1000.0::DOUBLE AS spent FROM d)
    SELECT doc_id, cost <= 0.1 AND spent + cost <= 10 AND (spent + cost) / greatest(0.5::DOUBLE, 0.1::DOUBLE) <= 2 AS within,
    spent > 0.8 AS minimal_critical, spent > 4 AS standard_critical, spent > 16 AS premium_critical, false AS unlimited_critical FROM x"""
)
def budget_compliance(spark, sf_dir):
    cost, spent = F.col("cost"), F.col("spent")
    rows = documents(spark, sf_dir).select(
        "doc_id", (T.token_estimate(F.col("content")) * C.PER_TOKEN).alias("cost"), (F.length("content") / 1000.0).alias("spent")
    )
    critical = [filters.budget_critical(F.lit(b), spent).alias(f"{b}_critical") for b, _, _ in C.BUDGETS]
    return rows.select("doc_id", filters.within_budget(cost, spent, F.lit(0.5)).alias("within"), *critical)


@query(
    f"""WITH b AS (SELECT * FROM (VALUES ('memory_store', ['fast', 'cheap', 'searchable'], true), ('faiss_store', ['vector', 'semantic', 'fast', 'scalable', 'persistent'], true),
    ('file_store', ['persistent', 'cheap', 'searchable', 'scalable'], false)) v(backend, caps, healthy)),
    w AS (SELECT * FROM (VALUES (0, ['fast']), (1, ['cheap', 'persistent']), (2, ['vector', 'semantic']), (3, ['semantic', 'searchable'])) v(need, wanted)),
    {TURNS}, n AS (SELECT length(coalesce(content, '')) % 4 AS need, count(*) AS turns FROM t GROUP BY 1)
    SELECT backend, array_to_string(wanted, '+') AS wanted, healthy, turns FROM b, w JOIN n USING (need) WHERE list_has_all(caps, wanted)"""
)
def capability_match(spark, sf_dir):
    """Which backends could take how many turns, by the capabilities that each turn needs."""
    rows = [(n, caps, n != "file_store") for n, caps in C.BACKENDS]
    backends = spark.createDataFrame(rows, "backend string, caps array<string>, healthy boolean")
    needs = turns(spark, sf_dir).groupBy((F.length(F.coalesce("content", F.lit(""))) % 4).alias("need")).agg(F.count(F.lit(1)).alias("turns"))
    parts = None
    for need, wanted in enumerate((["fast"], ["cheap", "persistent"], ["vector", "semantic"], ["semantic", "searchable"])):
        one = backends.where(filters.has_capabilities(F.col("caps"), wanted)).select("backend", F.lit("+".join(wanted)).alias("wanted"), "healthy", F.lit(need).alias("need"))
        parts = one if parts is None else parts.union(one)
    return needs.join(parts, "need").drop("need")


@query(
    """WITH now AS (SELECT doc_id, sha256(text) AS sha FROM documents), then_ AS (SELECT doc_id, CASE WHEN doc_id % 50 = 3 THEN 'x' ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 40 <> 7)
    SELECT now.doc_id, then_.doc_id IS NULL AS missing FROM now LEFT JOIN then_ USING (doc_id) WHERE then_.sha IS DISTINCT FROM now.sha"""
)
def manifest_check(spark, sf_dir):
    now = documents(spark, sf_dir).select("doc_id", F.sha2("content", 256).alias("sha"))
    then = now.where(F.col("doc_id") % 40 != 7).select("doc_id", F.when(F.col("doc_id") % 50 == 3, "x").otherwise(F.col("sha")).alias("old"))
    return now.join(then, "doc_id", "left").where(~F.col("old").eqNullSafe(F.col("sha"))).select("doc_id", F.col("old").isNull().alias("missing"))


# --- retrieval ----------------------------------------------------------------------------------------------------

_TERMS = f"""k AS (SELECT item_id AS query_id, text AS query FROM benchmark), n AS (SELECT count(*)::DOUBLE AS n FROM d),
    dl AS MATERIALIZED (SELECT doc_id, {R.tokens('content')} AS t FROM d), dt AS (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM dl),
    dc AS MATERIALIZED (SELECT doc_id, len, term, count(*) AS c FROM dt GROUP BY ALL),
    idf AS (SELECT term, ln((SELECT n FROM n) / count(*)) AS idf FROM dc GROUP BY term),
    dw AS MATERIALIZED (SELECT doc_id, term, c::DOUBLE / len * idf AS w FROM dc JOIN idf USING (term) WHERE idf <> 0),
    dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY doc_id),
    ql AS MATERIALIZED (SELECT query_id, {R.tokens('query')} AS t FROM k), qt AS MATERIALIZED (SELECT query_id, len(t) AS len, unnest(t) AS term FROM ql),
    qw AS (SELECT query_id, term, count(*)::DOUBLE / len * any_value(idf) AS q FROM qt JOIN idf USING (term) WHERE idf <> 0 GROUP BY query_id, len, term),
    qn AS (SELECT query_id, sqrt(sum(q * q)) AS norm FROM qw GROUP BY query_id),
    ts AS MATERIALIZED (SELECT query_id, doc_id, round(sum(w * q) / (any_value(dn.norm) * any_value(qn.norm)), 9) AS score
           FROM dw JOIN qw USING (term) JOIN dn USING (doc_id) JOIN qn USING (query_id) GROUP BY query_id, doc_id),
    tf AS (SELECT a.query_id, d.doc_id, coalesce(ts.score, 0.0) AS score FROM (SELECT DISTINCT query_id FROM qt) a CROSS JOIN d
           LEFT JOIN ts ON ts.query_id = a.query_id AND ts.doc_id = d.doc_id)"""
_JACCARD = f"""s AS (SELECT doc_id, list_distinct({R.tokens('content')}) AS t FROM d), u AS (SELECT item_id AS query_id, list_distinct({R.tokens('text')}) AS t FROM benchmark),
    st AS (SELECT doc_id, len(t) AS n, unnest(t) AS token FROM s), ut AS (SELECT query_id, len(t) AS m, unnest(t) AS token FROM u),
    ja AS (SELECT query_id, doc_id, count(*)::DOUBLE / (n + m - count(*)) AS jaccard FROM st JOIN ut USING (token) GROUP BY query_id, doc_id, n, m)"""


def _top(table: str, k: int = 5, item: str = "doc_id") -> str:
    return (
        f"SELECT query_id, {item}, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {item})::INT AS rank FROM {table}) WHERE rank <= {k}"
    )


@query(f"WITH {DOCS}, {_TERMS} {_top('tf')}")
def tfidf_topk(spark, sf_dir):
    return retrieval.tfidf_top_k(documents(spark, sf_dir), query_texts(spark, sf_dir), 5)


def _kept_postings(spark, sf_dir, name):
    """All documents in an index that was given nine tenths of them, got the rest later, and is read again."""
    items = documents(spark, sf_dir)
    folder = shared_folder(spark, name)
    later = F.col("doc_id") % 10 == 9
    index = TextIndex.create(items.where(~later), folder)
    index.add(items.where(later))
    index.refresh()
    return TextIndex(spark, folder)


@query(f"WITH {DOCS}, {_TERMS} {_top('tf')}")
def text_index_topk(spark, sf_dir):
    """The kept index gives what `tfidf_topk` gives."""
    return _kept_postings(spark, sf_dir, "text_index_topk").search(query_texts(spark, sf_dir), 5)


@query(
    f"WITH {DOCS}, {_TERMS} SELECT count(DISTINCT query_id) AS queries, count(*) AS matches, true AS fewer_read FROM dw JOIN qw USING (term)"
)
def text_index_reads(spark, sf_dir):
    """Postings of the queries' terms, and whether the searches read fewer than all of them."""
    blocks = _kept_postings(spark, sf_dir, "text_index_reads").needed(query_texts(spark, sf_dir), 5)
    read = F.sum(F.when(F.col("read"), F.col("n")).otherwise(0))
    return blocks.agg(F.count_distinct("query_id").alias("queries"), F.sum("n").cast("long").alias("matches"), (read < F.sum("n")).alias("fewer_read"))


@query(f"WITH {DOCS}, {_JACCARD}, r AS (SELECT query_id, doc_id, round(jaccard, 9) AS score FROM ja) {_top('r')}")
def jaccard_topk(spark, sf_dir):
    return retrieval.jaccard_top_k(documents(spark, sf_dir), query_texts(spark, sf_dir), 5)


_RECENT = "r AS (SELECT query_id, doc_id, round(jaccard + 1.0::DOUBLE / (doc_id % 30 + 1) * 0.1::DOUBLE, 9) AS score FROM ja)"


@query(f"WITH {DOCS}, {_JACCARD}, {_RECENT} {_top('r')}")
def jaccard_recency_topk(spark, sf_dir):
    return retrieval.jaccard_top_k(documents(spark, sf_dir), query_texts(spark, sf_dir), 5, days_back=F.col("doc_id") % 30)


_IP = """ip AS (SELECT q.vec_id AS query_id, i.vec_id, round(list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) + 0.0::DOUBLE AS score, i.label
    FROM embeddings q, embeddings i WHERE q.vec_id % 20 = 0)"""


def vector_results(spark, sf_dir, k=5):
    items = read(spark, sf_dir, "embeddings")
    asked = items.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return items, retrieval.inner_product_top_k(items, asked, k)


@query(f"WITH {_IP} {_top('ip', item='vec_id')}")
def vector_topk(spark, sf_dir):
    return vector_results(spark, sf_dir)[1]


def _kept_index(spark, sf_dir, name):
    """All embeddings in an index that was built on nine tenths of them, got the rest later, and is read again."""
    items = read(spark, sf_dir, "embeddings")
    folder = shared_folder(spark, name)
    later = F.col("vec_id") % 10 == 9
    VectorIndex.build(items.where(~later), folder).add(items.where(later))
    asked = items.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return items, asked, VectorIndex(spark, folder)


@query(f"WITH {_IP} {_top('ip', item='vec_id')}")
def vector_index_exact(spark, sf_dir):
    """The exact way through the kept index: the same as without one."""
    _, asked, index = _kept_index(spark, sf_dir, "vector_index_exact")
    return index.search(asked, 5, exact=True)


@query(f"WITH {_IP}, x AS ({_top('ip', 10, item='vec_id')}) SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, true AS found_enough, true AS fewer_cells FROM x")
def vector_index_recall(spark, sf_dir):
    """How many of the exact ten best a search of a part of the cells finds: at least nine tenths."""
    items, asked, index = _kept_index(spark, sf_dir, "vector_index_recall")
    exact = retrieval.inner_product_top_k(items, asked, 10)
    found = index.search(asked, 10).select("query_id", "vec_id", F.lit(1).alias("hit"))
    few = F.lit(index.meta()["probes"] < index.meta()["cells"])
    return exact.join(found, ["query_id", "vec_id"], "left").agg(
        F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("neighbours"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("found_enough"), few.alias("fewer_cells")
    )


@query(
    f"WITH {_IP}, x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM ip) SELECT query_id, vec_id, score, rank FROM x WHERE rank <= 5 AND label % 2 = 0"
)
def vector_topk_postfilter(spark, sf_dir):
    items, best = vector_results(spark, sf_dir)
    return best.join(items.select("vec_id", "label"), "vec_id").where(F.col("label") % 2 == 0).drop("label").select("query_id", "vec_id", "score", "rank")


@query(
    f"""WITH {DOCS}, {_TERMS}, {_JACCARD}, {_RECENT}, a AS ({_top('tf')}), b AS ({_top('r')}),
    c AS (SELECT *, 'memory' AS backend, 0 AS position FROM a UNION ALL SELECT *, 'file' AS backend, 1 AS position FROM b)
    SELECT query_id, doc_id AS item_id, backend, score, backend_rank, rank FROM (SELECT query_id, doc_id, backend, score, rank AS backend_rank,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position, rank)::INT AS rank FROM c) WHERE rank <= 5"""
)
def multi_backend_topk(spark, sf_dir):
    docs, asked = documents(spark, sf_dir), query_texts(spark, sf_dir)
    memory = retrieval.tfidf_top_k(docs, asked, 5).withColumnRenamed("doc_id", "item_id")
    file = retrieval.jaccard_top_k(docs, asked, 5, days_back=F.col("doc_id") % 30).withColumnRenamed("doc_id", "item_id")
    return retrieval.merged_top_k([("memory", memory), ("file", file)], 5)


@query(
    f"""WITH {DOCS}, {_TERMS}, a AS ({_top('tf', 3)}), j AS (SELECT query_id, string_agg(content, ' ' ORDER BY rank) AS s FROM a JOIN d USING (doc_id) WHERE length(content) > 10 GROUP BY query_id)
    SELECT query_id, CASE WHEN length(s) > 200 THEN substr(s, 1, 200) || '...' ELSE s END AS answer FROM j"""
)
def assembled_answers(spark, sf_dir):
    docs = documents(spark, sf_dir)
    best = retrieval.tfidf_top_k(docs, query_texts(spark, sf_dir), 3).join(docs.select("doc_id", "content"), "doc_id")
    ranked = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("c"))
    return ranked.select("query_id", retrieval.assembled_answer(F.col("c.content")).alias("answer")).where("answer <> ''")


@query(
    f"""WITH {DOCS}, {_TERMS}, a AS ({_top('tf')}), x AS (SELECT k.query_id, bool_or(contains(d.content, k.query)) AS correct, count(a.doc_id) > 0 AS any_hit
    FROM k LEFT JOIN a USING (query_id) LEFT JOIN d USING (doc_id) GROUP BY k.query_id)
    SELECT count(*) AS n_queries, avg(any_hit::INT) AS recall_any, avg(coalesce(correct, false)::INT) AS recall, sum(coalesce(correct, false)::INT)::BIGINT AS correct,
    count(*) * 8.0::DOUBLE / greatest(1, sum(coalesce(correct, false)::INT)) AS cost_per_correct FROM x"""
)
def run_metrics(spark, sf_dir):
    docs, asked = documents(spark, sf_dir), query_texts(spark, sf_dir)
    best = retrieval.tfidf_top_k(docs, asked, 5).join(docs.select("doc_id", "content"), "doc_id").drop("score")
    found = asked.join(best, "query_id", "left").groupBy("query_id").agg(
        F.coalesce(F.bool_or(F.col("content").contains(F.col("query"))), F.lit(False)).alias("correct"), (F.count("doc_id") > 0).alias("any_hit")
    )
    hits = F.sum(F.col("correct").cast("int"))
    return found.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg(F.col("any_hit").cast("int")).alias("recall_any"),
        F.avg(F.col("correct").cast("int")).alias("recall"),
        hits.alias("correct"),
        (F.count(F.lit(1)) * 8.0 / F.greatest(F.lit(1), hits)).alias("cost_per_correct"),
    )


# --- sessions -----------------------------------------------------------------------------------------------------


@query(
    f"""WITH {TURNS} SELECT session_id, turn_no, turn_count, array_to_string(list(turn_no::VARCHAR) OVER (PARTITION BY session_id ORDER BY turn_no ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), ',') AS recent FROM t"""
)
def turn_context_window(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = policies.with_session_context(turns(spark, sf_dir))
    frame = W.partitionBy("session_id").orderBy("turn_no").rowsBetween(-10, -1)
    recent = F.array_join(F.collect_list(F.col("turn_no").cast("string")).over(frame), ",")
    return rows.select(*KEY, "turn_count", F.when(F.col("turn_count") > 0, recent).alias("recent"))


@query(
    f"""WITH RECURSIVE {TURNS}, c AS (SELECT *, 0.05::DOUBLE + {R.token_estimate('content')} * 0.0001::DOUBLE + 0.01::DOUBLE / 30.0::DOUBLE AS cost FROM t),
    l AS (SELECT session_id, turn_count, turn_no, cost, cost <= 0.1 AND cost <= 0.25 AND cost / 0.1::DOUBLE <= 2 AS accepted,
          CASE WHEN cost <= 0.1 AND cost <= 0.25 AND cost / 0.1::DOUBLE <= 2 THEN cost ELSE 0.0 END AS spent FROM c WHERE turn_count = 0
          UNION ALL
          SELECT c.session_id, c.turn_count, c.turn_no, c.cost, c.cost <= 0.1 AND l.spent + c.cost <= 0.25 AND (l.spent + c.cost) / 0.1::DOUBLE <= 2,
          l.spent + CASE WHEN c.cost <= 0.1 AND l.spent + c.cost <= 0.25 AND (l.spent + c.cost) / 0.1::DOUBLE <= 2 THEN c.cost ELSE 0.0 END
          FROM l JOIN c ON c.session_id = l.session_id AND c.turn_count = l.turn_count + 1)
    SELECT session_id, turn_no, cost, accepted, spent FROM l"""
)
def budget_ledger(spark, sf_dir):
    cost = F.lit(C.WRITE) + T.token_estimate(F.col("content")) * F.lit(C.PER_TOKEN) + F.lit(C.INDEX) / F.lit(30.0)
    return sessions.budget_ledger(turns(spark, sf_dir), cost, session=0.25)


@query(f"WITH {TURNS} SELECT session_id, turn_no FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_no DESC) AS r FROM t) WHERE r <= 3")
def lru_last_n(spark, sf_dir):
    return sessions.last_items(turns(spark, sf_dir), 3, "session_id", ["turn_no"]).select(*KEY)


@query(
    f"""WITH {DOCS}, w AS (SELECT doc_id, {R.words('content')} AS w FROM d), s AS (SELECT doc_id, w, unnest(range(0, len(w), 80)) AS start FROM w)
    SELECT doc_id, (start // 80)::INT AS chunk, array_to_string(w[start + 1 : start + 100], ' ') AS text FROM s"""
)
def chunk_tokens(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(summaries.chunks(T.words(F.col("content")), 100, 20)).alias("chunk", "c"))
    return rows.select("doc_id", "chunk", F.array_join("c", " ").alias("text"))


_SUMMARY = rf"""a AS (SELECT doc_id, source, content, string_split(content, '.') AS s, string_split(content, chr(10)) AS lines FROM d),
    b AS (SELECT *, len(s) AS n, greatest(1, floor(len(s) * 0.3::DOUBLE)::INT) AS target FROM a),
    c AS (SELECT *, greatest(1, ((n - 2) // greatest(target - 2, 1))::INT) AS step FROM b),
    e AS (SELECT *, list_sort(list_distinct([0] || CASE WHEN target > 2 AND n > 2 THEN list_slice(range(1, greatest(n - 2, 1) + 1, step), 1, target - 2) ELSE [] END
          || CASE WHEN target > 1 THEN [n - 1] ELSE [] END)) AS idx FROM c),
    f AS (SELECT *, array_to_string(list_transform(idx, lambda i: regexp_replace(s[i + 1], '^\s+|\s+$', '', 'g')), '. ') AS j FROM e),
    y AS (SELECT doc_id, source, content, lines, CASE WHEN {R.token_estimate('content')} > 300 THEN CASE WHEN ends_with(j, '.') THEN j ELSE j || '.' END ELSE content END AS summary FROM f)"""


@query(f"WITH {DOCS}, {_SUMMARY} SELECT doc_id, summary, array_to_string(lines[1 : greatest(1, len(lines) // 3)], chr(10)) AS first_third FROM y")
def extractive_summary(spark, sf_dir):
    c = F.col("content")
    return documents(spark, sf_dir).select("doc_id", summaries.extractive(c, least_tokens=300).alias("summary"), summaries.first_third(c).alias("first_third"))


_HASH = "md5('{0}|' || doc_id)"


@query(
    f"""SELECT doc_id, quality, CASE WHEN (r - 1)::DOUBLE / n < 0.2 THEN 'test' WHEN (r - 1)::DOUBLE / n < 0.4 THEN 'validation' ELSE 'train' END AS split, shadow, fold FROM (
    SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_HASH.format('42')}, doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n,
    row_number() OVER (PARTITION BY quality ORDER BY {_HASH.format('7')}, doc_id) <= greatest(1, floor(count(*) OVER (PARTITION BY quality) * 0.25)) AS shadow,
    ((row_number() OVER (PARTITION BY quality ORDER BY {_HASH.format('42')}, doc_id) - 1) % 5)::INT AS fold FROM labels)"""
)
def stratified_splits(spark, sf_dir):
    rows = sessions.stratified_split(read(spark, sf_dir, "labels"), "quality", "doc_id")
    rows = sessions.stratified_folds(sessions.shadow_split(rows, "quality", "doc_id"), "quality", "doc_id")
    return rows.select("doc_id", "quality", "split", "shadow", F.col("fold").cast("int").alias("fold"))


@query(
    f"""SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_HASH.format('42')}, doc_id) AS r FROM labels)
    WHERE r <= 2 * greatest(20, (SELECT count(*) // greatest(1, 3 * count(DISTINCT quality)) FROM labels))"""
)
def class_caps(spark, sf_dir):
    return sessions.capped_classes(read(spark, sf_dir, "labels"), "quality", "doc_id").select("doc_id", "quality")


@query(
    f"""WITH {DOCS}, x AS (SELECT doc_id, length(content)::DOUBLE AS chars, len({R.words('content')})::DOUBLE AS words FROM d)
    SELECT doc_id, round((chars - avg(chars) OVER ()) / stddev_pop(chars) OVER (), 6) AS chars, round((words - avg(words) OVER ()) / stddev_pop(words) OVER (), 6) AS words FROM x"""
)
def standardize(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.length("content").cast("double").alias("chars"), T.word_count(F.col("content")).cast("double").alias("words"))
    return sessions.standardized(rows, ["chars", "words"]).select("doc_id", F.round("chars", 6).alias("chars"), F.round("words", 6).alias("words"))


# --- evaluation ---------------------------------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT event_type AS op, value AS v FROM events WHERE value IS NOT NULL),
    l AS (SELECT op, count(*) AS n, list_sort(list(v)) AS x, median(v) AS p50 FROM e GROUP BY op)
    SELECT op, n, p50, x[ceil(n * 0.95)::INT] AS nearest_rank, x[floor(n * 0.95)::INT + 1] AS by_index,
    CASE WHEN n >= 20 THEN (x[greatest(1, least(19 * (n + 1) // 20, n - 1))] * (20 - (19 * (n + 1) - 20 * greatest(1, least(19 * (n + 1) // 20, n - 1))))
      + x[greatest(1, least(19 * (n + 1) // 20, n - 1)) + 1] * (19 * (n + 1) - 20 * greatest(1, least(19 * (n + 1) // 20, n - 1)))) / 20.0::DOUBLE
      WHEN n = 1 THEN 1.5 * p50 ELSE x[n] END AS exclusive FROM l"""
)
def latency_quantiles(spark, sf_dir):
    return metrics.p95_by_definition(telemetry(spark, sf_dir), "op", "observed_ms")


_SAMPLES = """s AS (SELECT event_type AS backend, CASE WHEN event_id % 2 = 0 THEN 'store' ELSE 'retrieve' END AS op, CASE WHEN event_id % 3 <> 0 THEN round(value) / 10.0::DOUBLE END AS cents,
    value AS ms, user_id AS n_tokens, json_extract_string(props, '$.k')::INT AS k FROM events)"""


@query(
    f"""WITH {_SAMPLES}, m AS (SELECT backend, median(cents) FILTER (op = 'store') AS st, median(cents) FILTER (op = 'retrieve') AS re, median(cents) AS m,
    median(cents / (greatest(1, k) + 1e-6::DOUBLE)) AS per_k, median(ms) AS p50 FROM s GROUP BY backend),
    x AS (SELECT s.backend, median(greatest(0.0, cents - round_even(m, 0)) / (n_tokens + 1e-6::DOUBLE)) FILTER (n_tokens > 0 AND cents IS NOT NULL) AS extra FROM s JOIN m USING (backend) GROUP BY s.backend)
    SELECT backend, coalesce(st, 0.05) AS write, coalesce(re, 0.02) AS read, least(0.02, m * 0.1) AS index_maint, least(0.01, m * 0.05) AS gc_maint, least(0.005, m * 0.02) AS storage_month,
    round_even(m, 0)::INT AS base_cents, round_even(extra * 1e6, 0)::INT AS per_token_micros, per_k AS per_k_cents, p50 AS p50_ms FROM m JOIN x USING (backend)"""
)
def latency_refit(spark, sf_dir):
    return metrics.fitted_coefficients(samples(spark, sf_dir), "backend").drop("p95_ms")


def samples(spark, sf_dir):
    """Events as samples of what operations cost and took."""
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id",
        "ts",
        F.col("event_type").alias("backend"),
        F.when(F.col("event_id") % 2 == 0, "store").otherwise("retrieve").alias("op"),
        F.when(F.col("event_id") % 3 != 0, F.round("value") / 10.0).alias("observed_cents"),
        F.col("value").alias("observed_ms"),
        F.col("user_id").alias("n_tokens"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


@query("SELECT event_id, op FROM (SELECT event_id, event_type AS op, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 10000")
def newest_samples(spark, sf_dir):
    return metrics.newest_samples(telemetry(spark, sf_dir), "op", ["ts", "event_id"]).select("event_id", "op")


@query(
    f"""WITH {DOCS}, r AS (SELECT {R.three_class('content')} AS route FROM d), c AS (SELECT route, count(*) AS n FROM r GROUP BY route)
    SELECT route, n, n::DOUBLE / sum(n) OVER () AS share FROM c"""
)
def routing_distribution(spark, sf_dir):
    return metrics.distribution(documents(spark, sf_dir).select(policies.three_class(F.col("content")).alias("route")), "route")


@query(
    f"""WITH {DOCS}, r AS (SELECT {R.three_class('content')} AS route FROM d), c AS (SELECT count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM r GROUP BY route)
    SELECT -sum(p * log2(p)) / log2(3) AS balance FROM c"""
)
def class_entropy(spark, sf_dir):
    return metrics.balance(documents(spark, sf_dir).select(policies.three_class(F.col("content")).alias("route")), "route", 3)


_PRED = f"p AS (SELECT l.doc_id, quality, (length(content) > 1000)::INT AS predicted FROM labels l JOIN d USING (doc_id))"
_SCORES = """c AS (SELECT quality, predicted, count(*) AS n FROM p GROUP BY ALL),
    a AS (SELECT quality AS label, sum(n)::BIGINT AS support, coalesce(sum(n) FILTER (quality = predicted), 0)::BIGINT AS hits FROM c GROUP BY quality),
    b AS (SELECT predicted AS label, sum(n)::BIGINT AS said FROM c GROUP BY predicted),
    s AS (SELECT label, support, CASE WHEN coalesce(said, 0) > 0 THEN hits::DOUBLE / said ELSE 0.0 END AS precision, hits::DOUBLE / support AS recall FROM a LEFT JOIN b USING (label)),
    z AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM s)"""


def predictions(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", (F.length("content") > 1000).cast("int").alias("predicted"))
    return read(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", "quality", "predicted")


@query(f"WITH {DOCS}, {_PRED} SELECT quality, predicted, count(*) AS n FROM p GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir), "quality", "predicted")


@query(f"WITH {DOCS}, {_PRED}, {_SCORES} SELECT * FROM z")
def class_scores(spark, sf_dir):
    return metrics.class_scores(predictions(spark, sf_dir), "quality", "predicted")


@query(
    f"""WITH {DOCS}, {_PRED}, {_SCORES} SELECT sum(precision * support) / sum(support) AS weighted_precision, sum(recall * support) / sum(support) AS weighted_recall,
    sum(f1 * support) / sum(support) AS weighted_f1, sum(f1 / (label + 0.1::DOUBLE)) / sum(1 / (label + 0.1::DOUBLE)) AS cost_weighted_f1 FROM z"""
)
def weighted_f1(spark, sf_dir):
    scores = metrics.class_scores(predictions(spark, sf_dir), "quality", "predicted")
    return metrics.weighted_scores(scores, F.col("label"))


@query(
    f"""WITH {TURNS}, x AS (SELECT session_id, turn_no, list_distinct({R.words('lower(content)')}) AS r,
    list_distinct({R.words("lower(lag(content) OVER (PARTITION BY session_id ORDER BY turn_no))")}) AS e FROM t),
    y AS (SELECT *, len(list_intersect(e, r)) AS tp FROM x WHERE e IS NOT NULL)
    SELECT session_id, turn_no, CASE WHEN len(e) = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE tp::DOUBLE / len(r) END AS precision,
    CASE WHEN len(e) = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE tp::DOUBLE / len(e) END AS recall,
    CASE WHEN len(e) = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (len(e) + len(r)) END AS f1, tp >= least(3.0, len(e) * 0.5) AS correct FROM y"""
)
def term_prf1(spark, sf_dir):
    from pyspark.sql import Window as W

    order = W.partitionBy("session_id").orderBy("turn_no", "item_id")
    bag = lambda c: F.array_distinct(T.words(F.lower(c)))
    rows = turns(spark, sf_dir).withColumn("before", F.lag("content").over(order)).where("before is not null")
    rows = rows.select(*KEY, bag(F.col("content")).alias("r"), bag(F.col("before")).alias("e"))
    scores = metrics.set_scores(F.col("e"), F.col("r"))
    return rows.select(*KEY, *[v.alias(k) for k, v in scores.items()], metrics.overlap_correct(F.col("e"), F.col("r")).alias("correct"))


_ROUTED = f"""s AS (SELECT *, {R.stripped('content')} AS s FROM t), f AS (SELECT *, {R.columns(R.flags('s'))} FROM s), h AS (SELECT *, {R.HEURISTIC} AS action FROM f)"""


@query(
    f"""WITH {TURNS}, {_ROUTED} SELECT session_id, count(*) AS decisions, count(*) FILTER (action = 'store') AS stored, count(*) FILTER (action = 'drop') AS dropped,
    count(*) FILTER (action = 'summarize') AS summarized, sum(CASE WHEN action = 'store' THEN 0.05::DOUBLE + {R.token_estimate('content')} * 0.0001::DOUBLE ELSE 0.0 END) AS spent,
    sum(CASE WHEN action = 'drop' THEN 12.0::DOUBLE ELSE 0.0 END) AS saved, avg(length(content)) AS mean_length FROM h GROUP BY session_id"""
)
def session_summary(spark, sf_dir):
    c, s = F.col("content"), F.col("speaker")
    rows = turns(spark, sf_dir).withColumn("action", policies.heuristic_action(c, s))
    cost = F.when(F.col("action") == "store", C.WRITE + T.token_estimate(c) * C.PER_TOKEN).otherwise(0.0)
    return rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("decisions"),
        F.count_if(F.col("action") == "store").alias("stored"),
        F.count_if(F.col("action") == "drop").alias("dropped"),
        F.count_if(F.col("action") == "summarize").alias("summarized"),
        F.sum(cost).alias("spent"),
        F.sum(F.when(F.col("action") == "drop", 12.0).otherwise(0.0)).alias("saved"),
        F.avg(F.length(c)).alias("mean_length"),
    )


@query(
    f"""WITH {TURNS}, {_ROUTED}, r AS (SELECT *, {R.three_class('content')} AS route FROM h),
    u AS (SELECT 'heuristic' AS policy, action FROM r UNION ALL SELECT 'three_class', CASE route WHEN 'discard' THEN 'drop' WHEN 'compress' THEN 'summarize' ELSE 'store' END FROM r
          UNION ALL SELECT 'store_all', 'store' FROM r),
    a AS (SELECT policy, count(*) AS n, sum(CASE action WHEN 'drop' THEN 1 WHEN 'store' THEN 8 ELSE 15 END)::BIGINT AS cents, count(*) FILTER (action = 'drop') AS dropped FROM u GROUP BY policy)
    SELECT policy, n, cents, dropped, cents::DOUBLE / n AS cents_each, 1 - cents::DOUBLE / (12 * n) AS reduction FROM a"""
)
def policy_compare(spark, sf_dir):
    c, s = F.col("content"), F.col("speaker")
    names = ["heuristic", "three_class", "store_all"]
    actions = F.array(*[F.struct(F.lit(n).alias("policy"), policies.policy(n)(c, s).alias("action")) for n in names])
    rows = turns(spark, sf_dir).select(F.explode(actions).alias("p")).select("p.*")
    cents = F.when(F.col("action") == "drop", 1).when(F.col("action") == "store", 8).otherwise(15)
    found = rows.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.sum(cents).alias("cents"), F.count_if(F.col("action") == "drop").alias("dropped"))
    return found.withColumn("cents_each", F.col("cents") / F.col("n")).withColumn("reduction", 1 - F.col("cents") / (12 * F.col("n")))


@query(
    """SELECT user_id AS session_id, event_type AS op, count(*) AS operations, sum(value) AS spent, round(avg(value), 6) AS mean_ms, max(value) AS max_ms,
    sum(CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END)::DOUBLE / count(*) AS success_rate FROM events GROUP BY user_id, event_type"""
)
def cost_by_session_op(spark, sf_dir):
    return telemetry(spark, sf_dir).groupBy("session_id", "op").agg(
        F.count(F.lit(1)).alias("operations"),
        F.sum("observed_ms").alias("spent"),
        F.round(F.avg("observed_ms"), 6).alias("mean_ms"),
        F.max("observed_ms").alias("max_ms"),
        (F.sum(F.when(F.col("observed_ms").isNotNull(), 1).otherwise(0)) / F.count(F.lit(1))).alias("success_rate"),
    )


@query(
    f"""WITH {DOCS}, x AS (SELECT lang, source, length(content) AS n, {R.token_estimate('content')} AS t FROM d)
    SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, min(n) AS shortest, max(n) AS longest, avg(n) AS mean_length, sum(t)::BIGINT AS tokens FROM x GROUP BY lang"""
)
def dataset_stats(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("n_chars", F.length("content"))
    return rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("source").alias("sources"),
        F.min("n_chars").alias("shortest"),
        F.max("n_chars").alias("longest"),
        F.avg("n_chars").alias("mean_length"),
        F.sum(T.token_estimate(F.col("content"))).alias("tokens"),
    )


@query(
    f"""WITH {DOCS}, {_SUMMARY}, x AS (SELECT source, {R.token_estimate('content')} AS before, {R.token_estimate('summary')} AS after FROM y)
    SELECT source, count(*) AS summaries, sum(before)::BIGINT AS tokens_before, sum(after)::BIGINT AS tokens_after, avg(after::DOUBLE / greatest(1, before)) AS mean_ratio FROM x GROUP BY source"""
)
def summary_stats(spark, sf_dir):
    content = F.col("content")
    rows = documents(spark, sf_dir).select(
        "source", T.token_estimate(content).alias("before"), F.length(summaries.extractive(content, least_tokens=300)).alias("n")
    )
    # The estimate needs no more than the length, so that a summary is made once.
    rows = rows.select("source", "before", T.token_estimate_of_length(F.col("n")).alias("after"))
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("summaries"),
        F.sum("before").alias("tokens_before"),
        F.sum("after").alias("tokens_after"),
        F.avg(F.col("after") / F.greatest(F.lit(1), F.col("before"))).alias("mean_ratio"),
    )


@query(f"WITH {DOCS}, t AS (SELECT unnest({R.tokens('content')}) AS term, doc_id FROM d) SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM t GROUP BY term")
def token_counts(spark, sf_dir):
    counts = retrieval.term_counts(documents(spark, sf_dir), "doc_id", "content")
    return counts.groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("df"))


@query(
    """SELECT event_type AS op, time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL"""
)
def hourly_telemetry(spark, sf_dir):
    rows = telemetry(spark, sf_dir).groupBy("op", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("observed_ms"), 6).alias("total"))
    return rows.select("op", F.col("w.start").alias("window_start"), "n", "total")


# --- generated data -----------------------------------------------------------------------------------------------


@query(
    """WITH r AS (SELECT item_id AS i FROM benchmark), x AS (SELECT i, ['Alice', 'Bob', 'Carol', 'Diego', 'Erin'][i % 5 + 1] AS name FROM r)
    SELECT 'F' || i AS id, 'factual_lookup' AS stratum, 'Order ' || (4000 + i) || ' for ' || name || ' is ready for pickup at 5pm on 04/2' || (i % 10) || '/2025.' AS content,
    'What''s the pickup time for order ' || (4000 + i) || '?' AS query FROM x"""
)
def golden_factual(spark, sf_dir):
    return generators.golden(query_texts(spark, sf_dir).select(F.col("query_id").alias("id"))).where(F.col("stratum") == "factual_lookup").select("id", "stratum", "content", "query")


@query(
    f"""WITH {DOCS}, r AS (SELECT *, {R.three_class('content')} AS route, length(content) > 20 AS good FROM d WHERE content IS NOT NULL)
    SELECT count(*) FILTER (route = 'discard') AS discarded, count(*) FILTER (route = 'store') AS stored, count(*) FILTER (route = 'compress') AS compressed,
    sum(CASE route WHEN 'discard' THEN 1 WHEN 'store' THEN 8 ELSE 15 END)::BIGINT AS cents, 12 * count(*) AS naive_cents,
    sum(CASE WHEN route <> 'discard' THEN good::INT ELSE CASE WHEN good THEN 0.0 ELSE 0.5 END END)::DOUBLE / count(*) AS accuracy, avg(good::INT) AS naive_accuracy FROM r"""
)
def eval_simulation(spark, sf_dir):
    rows = documents(spark, sf_dir).where("content is not null").select(F.col("doc_id").alias("id"), "content")
    rows = generators.evaluation_items(rows).withColumn("route", policies.three_class(F.col("content")))
    good = F.col("expected_quality") > 0.5
    cents, _ = policies.route_cost(F.col("route"))
    credit = F.when(F.col("route") != "discard", good.cast("double")).otherwise(F.when(good, 0.0).otherwise(0.5))
    count = lambda r: F.count_if(F.col("route") == r)
    return rows.agg(
        count("discard").alias("discarded"),
        count("store").alias("stored"),
        count("compress").alias("compressed"),
        F.sum(cents).alias("cents"),
        (12 * F.count(F.lit(1))).alias("naive_cents"),
        (F.sum(credit) / F.count(F.lit(1))).alias("accuracy"),
        F.avg(good.cast("int")).alias("naive_accuracy"),
    )
