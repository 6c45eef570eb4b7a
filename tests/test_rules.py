"""Policies, features, prices and filters on literal cases."""

import math

import pytest
from pyspark.sql import functions as F

from turnmill.functions import constants as C
from turnmill.functions import features, pricing
from turnmill.functions import text as T
from turnmill.operators import filters, metrics, policies, retrieval, sessions, summaries
from turnmill.plans import evaluation
from turnmill.sources import generators


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column).first()[0]


@pytest.mark.parametrize(
    "content,speaker,action",
    [
        ("ok", "user", "drop"),
        ("Thanks!", "user", "drop"),
        ("👍", "user", "drop"),
        ("sounds good", "assistant", "drop"),
        ("What is my order number?", "user", "store"),
        ("My name is Alice Johnson", "user", "store"),
        ("The invoice is 1234.50 in total", "assistant", "store"),
        ("word " * 130, "assistant", "summarize"),
        ("lorem ipsum dolor", "assistant", "store"),
    ],
)
def test_heuristic_policy(spark, content, speaker, action):
    assert one(spark, policies.heuristic_action(F.col("c"), F.col("s")), c=content, s=speaker) == action


def test_critical_budget_drops_what_is_neither_asked_nor_factual(spark):
    action = policies.heuristic_action(F.col("c"), F.col("s"), F.lit(True))
    assert one(spark, action, c="lorem ipsum dolor", s="assistant") == "drop"
    assert one(spark, action, c="lorem ipsum dolor", s="user") == "store"


@pytest.mark.parametrize(
    "content,speaker,turn,minutes,budget,expected",
    [
        ("How do I reset it?", "user", 0, 0, "standard", "faiss_store"),
        ("My name is Alice Johnson", "user", 5, 0, "standard", "memory_store"),
        ("Alice Johnson called", "assistant", 20, 0, "standard", "faiss_store"),
        ("plain words here", "assistant", 20, 45, "standard", "file_store"),
        ("plain words here", "assistant", 20, 0, "premium", "faiss_store"),
        ("plain words here", "assistant", 20, 0, "minimal", "memory_store"),
        ("plain " * 60, "assistant", 20, 0, "standard", "faiss_store"),
    ],
)
def test_backends(spark, content, speaker, turn, minutes, budget, expected):
    chosen = policies.choose_backend(F.col("c"), F.col("s"), F.col("t"), F.col("m"), budget)
    assert one(spark, chosen, c=content, s=speaker, t=turn, m=minutes) == expected


def test_three_class_and_five_class(spark):
    cases = {"hi": ("discard", 0), "my phone is 5 and more words": ("store", 1), "what shall we do about everything here then": ("store", 2), "x " * 90: ("compress", 4)}
    for content, (name, number) in cases.items():
        assert one(spark, policies.three_class(F.col("c")), c=content) == name
        assert one(spark, policies.five_class(F.col("c"))[0], c=content) == number


def test_policy_registry(spark):
    policies.register("none", lambda c, s: F.lit("drop"))
    assert one(spark, policies.policy("none")(F.col("c"), F.col("s")), c="x", s="y") == "drop"
    assert policies.policy() is policies.heuristic_action
    with pytest.raises(KeyError):
        policies.policy("missing")


def test_flags_know_word_boundaries_of_all_scripts(spark):
    frame = spark.createDataFrame([("Él Niño Ab",), ("Anna Berg",), ("i'm happy",)], "c string")
    got = [r[0] for r in frame.select(features.content_flags(F.col("c"))["contains_names"]).collect()]
    assert got == [False, True, True]


def test_router_features_of_an_empty_text(spark):
    made = features.router_features(F.col("c"), F.lit(None).cast("string"), F.lit(0), F.lit(1), F.lit(0))
    assert len(made) == 32
    row = spark.createDataFrame([("",)], "c string").select(*[v.alias(k) for k, v in made.items()]).first()
    assert row["word_count"] == 0 and row["avg_word_length"] == 0 and row["complexity_ratio"] == 0


def test_text_primitives(spark):
    assert one(spark, T.tokens(F.col("c")), c="Don't 2x é") == ["don", "t", "2x"]
    assert one(spark, T.sentence_count(F.col("c")), c="A. B.\n . C") == 3
    assert one(spark, T.token_estimate(F.col("c")), c="") == 0
    assert one(spark, T.token_estimate(F.col("c")), c="x") == 1
    assert one(spark, T.pricebook_key(F.col("a"), F.col("b"), F.col("m")), a="x", b="store", m="small") == "x|store|model=small"


def test_prices_are_monotone_and_rounded_half_to_even(spark):
    rows = spark.range(0, 20000, 500).select(F.col("id").alias("n"), pricing.write_cost(F.col("id")).alias("w"), pricing.read_cost(F.lit(5), F.col("id")).alias("r"))
    found = rows.orderBy("n").collect()
    assert all(a["w"] < b["w"] and a["r"] <= b["r"] and b["r"] >= 0 for a, b in zip(found, found[1:]))  # noqa: B905
    assert [one(spark, pricing.whole_cents(F.col("x")), x=x) for x in (0.5, 1.5, 2.5, -3.0)] == [0, 2, 2, 0]
    free = spark.range(4400, 4600).where(pricing.whole_cents(pricing.write_cost(F.col("id"))) > 0).agg(F.min("id")).first()[0]
    assert free == 4497


def test_default_prices_and_learned_ones(spark):
    ops = spark.createDataFrame([("memory_store", "store", 100, 5, 10, "single"), ("other", "store", 100, 5, 10, "heavy")], "backend string, op string, n_tokens int, k int, n_items int, concurrency string")
    book = pricing.pricebook(spark, [("memory_store", "store", 3.0, 0.0, 0.0, 0.0, 0, 0, 0.0, 0.0, 1.0, 3.0)])
    got = {r["backend"]: r for r in pricing.predicted(pricing.with_prices(ops, book)).collect()}
    assert (got["memory_store"]["predicted_cents"], got["memory_store"]["predicted_ms"]) == (3, 1.5)
    assert (got["other"]["predicted_cents"], got["other"]["predicted_ms"]) == (0, 106.0)


def test_metadata_filters(spark):
    rows = [(1, "user", {"city": "Rome"}), (2, "user", {}), (3, None, {"city": "Rome"}), (4, "user", {"city": "Oslo"}), (5, "user", None)]
    frame = spark.createDataFrame(rows, "id int, s string, m map<string,string>")
    ids = lambda f, w: [r["id"] for r in frame.where(f(F.col("s"), F.col("m"), w)).orderBy("id").collect()]
    assert ids(filters.metadata_strict, {"city": "Rome"}) == [1, 3]
    assert ids(filters.metadata_lenient, {"city": "Rome"}) == [1, 2, 3, 5]
    assert ids(filters.metadata_strict, {"speaker": "user", "city": "Rome"}) == [1]


def test_capabilities():
    assert policies.by_capability("cheap") == "memory_store"
    assert policies.by_capability("vector", "semantic") == "faiss_store"
    assert policies.by_capability("semantic", "searchable") is None


def test_tfidf_and_jaccard_by_hand(spark):
    docs = spark.createDataFrame([(1, "red fish blue fish"), (2, "red dog"), (3, "green tree"), (4, "")], "doc_id int, content string")
    asked = spark.createDataFrame([(7, "fish red")], "query_id int, query string")
    got = [(r["doc_id"], r["score"]) for r in retrieval.tfidf_top_k(docs, asked, 5).orderBy("rank").collect()]
    red, fish, blue, dog = (math.log(4 / n) for n in (2, 1, 1, 1))
    norm1 = math.hypot(red / 4, fish / 2, blue / 4)
    q = math.hypot(red / 2, fish / 2)
    one_ = (red / 4 * red / 2 + fish / 2 * fish / 2) / (norm1 * q)
    two = (red / 2 * red / 2) / (math.hypot(red / 2, dog / 2) * q)
    assert got == [(1, pytest.approx(one_, abs=1e-8)), (2, pytest.approx(two, abs=1e-8)), (3, 0), (4, 0)]  # unmatched items fill up
    jac = [(r["doc_id"], r["score"]) for r in retrieval.jaccard_top_k(docs, asked, 5).orderBy("rank").collect()]
    assert jac == [(1, pytest.approx(2 / 3, abs=1e-8)), (2, pytest.approx(1 / 3, abs=1e-8))]
    fresh = retrieval.jaccard_top_k(docs, asked, 1, days_back=F.when(F.col("doc_id") == 1, 9).otherwise(0)).first()
    assert fresh["score"] == pytest.approx(2 / 3 + 0.01, abs=1e-8)


def test_inner_products_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "ITEM_BLOCK", 5)
    rows = [(i, [math.cos(i), math.sin(i)]) for i in range(20)] + [(99, None)]
    items = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    asked = items.where("vec_id % 4 = 0").withColumnRenamed("vec_id", "query_id")
    got = retrieval.inner_product_top_k(items, asked, 3).collect()
    for qid in range(0, 20, 4):
        best = sorted(range(20), key=lambda i: (-round(math.cos(qid - i), 6), i))[:3]
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == qid] == best


def test_quantile_definitions(spark):
    rows = [("a", float(x)) for x in range(1, 41)] + [("b", 7.0)] + [("c", float(x)) for x in (3, 1, 2)] + [("d", None)]
    got = {r["k"]: r for r in metrics.p95_by_definition(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    import statistics

    values = [float(x) for x in range(1, 41)]
    assert got["a"]["exclusive"] == pytest.approx(statistics.quantiles(values, n=20)[18])
    assert (got["a"]["nearest_rank"], got["a"]["by_index"], got["a"]["p50"]) == (38.0, 39.0, 20.5)
    assert (got["b"]["exclusive"], got["b"]["p50"]) == (10.5, 7.0)
    assert (got["c"]["exclusive"], got["c"]["p50"]) == (3.0, 2.0)


def test_set_scores(spark):
    frame = spark.createDataFrame([(["a", "b"], ["b", "c", "d"]), ([], ["x"]), (["a"], []), (["a"], ["b"])], "e array<string>, r array<string>")
    got = [tuple(round(x, 4) for x in row) for row in frame.select(*metrics.set_scores(F.col("e"), F.col("r")).values()).collect()]
    assert got == [(0.3333, 0.5, 0.4), (1, 1, 1), (0, 0, 0), (0, 0, 0)]


def test_ledger_is_a_recurrence(spark):
    rows = [(1, i, c) for i, c in enumerate([0.05, 0.2, 0.09, 0.09, 0.01, None])] + [(2, 0, 0.1)]
    got = sessions.budget_ledger(spark.createDataFrame(rows, "session_id int, turn_no int, c double"), F.col("c")).orderBy("session_id", "turn_no").collect()
    assert [r["accepted"] for r in got] == [True, False, True, False, True, False, True]
    assert got[4]["spent"] == pytest.approx(0.15)


def test_lru_and_splits(spark):
    items = spark.createDataFrame([("s", i) for i in range(5)], "k string, n int")
    assert sorted(r["n"] for r in sessions.last_items(items, 3, "k", ["n"]).collect()) == [2, 3, 4]
    rows = spark.range(200).select(F.col("id"), (F.col("id") % 2).alias("label"))
    split = sessions.stratified_split(rows, "label", "id").groupBy("label", "split").count().collect()
    assert {(r["label"], r["split"]): r["count"] for r in split} == {(k, s): n for k in (0, 1) for s, n in (("test", 20), ("validation", 20), ("train", 60))}
    assert sessions.shadow_split(rows, "label", "id").where("shadow").count() == 50


def test_summaries(spark):
    text = ". ".join(f"Sentence {i}" for i in range(20)) + "."
    got = one(spark, summaries.extractive(F.col("c"), least_tokens=10), c=text)
    assert got.startswith("Sentence 0. ") and got.endswith(".") and len(got) < len(text) / 2
    assert one(spark, summaries.extractive(F.col("c")), c=text) == text
    assert one(spark, summaries.first_third(F.col("c")), c="a\nb\nc\nd") == "a"
    chunks = one(spark, summaries.chunks(F.split("c", " "), 3, 1), c="a b c d e")
    assert chunks == [["a", "b", "c"], ["c", "d", "e"], ["e"]]


def test_budget_constants():
    assert [b for b, _, _ in C.BUDGETS] == ["minimal", "standard", "premium", "unlimited"]


def test_the_fixed_cases_of_the_benchmark(spark):
    cases = [("cost", "user", x, None) for x in C.BENCHMARK_MESSAGES] + [("routing", "user", x, y) for x, y in C.BENCHMARK_CASES]
    got = {r["part"]: r for r in evaluation.benchmark(spark.createDataFrame(cases, "part string, speaker string, content string, expected string")).collect()}
    assert (got["cost"]["n"], got["routing"]["n"]) == (len(C.BENCHMARK_MESSAGES), len(C.BENCHMARK_CASES))
    assert 0 < got["cost"]["stored"] < len(C.BENCHMARK_MESSAGES) and got["routing"]["correct"] > len(C.BENCHMARK_CASES) / 2


def test_evaluation_items_take_the_texts_in_turn(spark):
    rows = generators.evaluation_items(spark.range(30)).orderBy(F.monotonically_increasing_id()).collect()
    assert [r["content"] for r in rows] == [generators.EVALUATION_TEXTS[i % len(generators.EVALUATION_TEXTS)] for i in range(30)]
    assert {len(r["content"]) > 20 for r in rows if r["expected_quality"] == 0.8} == {True}
