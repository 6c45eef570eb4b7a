"""The kept text index against the search without one."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from turnmill.functions import text as T
from turnmill.operators import retrieval
from turnmill.operators.text_index import TextIndex

ITEMS = "doc_id long, content string"
QUERIES = "query_id long, query string"


def texts(rng, n, most=30):
    """Common words in every text, rare ones in a few."""
    def word():
        return f"w{min(int(rng.paretovariate(0.6)), 900)}"

    return [(i, " ".join(word() for _ in range(rng.randint(0, most)))) for i in range(n)]


def same(index, items, queries, k):
    got = index.search(queries, k).collect()
    expected = retrieval.tfidf_top_k(items, queries, k).collect()
    key = lambda r: (r["query_id"], r["rank"], r["doc_id"], round(r["score"], 8))
    assert sorted(map(key, got)) == sorted(map(key, expected))
    return got


@pytest.mark.parametrize("k", [1, 4])
def test_search_equals_the_one_without_an_index(spark, tmp_path, k):
    rng = random.Random(k)
    rows = [*texts(rng, 300), (1000, None), (1001, ""), (1002, "w1 " * 500), (1003, "w1 w2 w3 only here"), (1004, "w1 w2 w3 only here")]
    items = spark.createDataFrame(rows, ITEMS)
    asked = [*texts(rng, 20, 8), (50, None), (51, "!!"), (52, "nobody knows"), (53, "only here"), (54, "w1"), (55, "here here w1")]
    queries = spark.createDataFrame(asked, QUERIES)
    index = TextIndex.create(items, str(tmp_path / "index"))
    index.refresh()
    got = same(index, items, queries, k)
    assert {r["query_id"] for r in got} == {i for i, q in asked if q and any(c.isalnum() for c in q)}
    reads = index.needed(queries, k).groupBy("read").agg(F.sum("n").alias("n")).collect()
    assert {r["read"] for r in reads} == {True, False}  # some lists aren't read


def test_added_items_count_after_a_refresh(spark, tmp_path):
    rng = random.Random(5)
    rows = texts(rng, 120)
    queries = spark.createDataFrame([(1, "w1 w2 w7"), (2, rows[90][1] + " w5"), (3, rows[3][1] + " w9")], QUERIES)
    first, whole = spark.createDataFrame(rows[:80], ITEMS), spark.createDataFrame(rows, ITEMS)
    index = TextIndex.create(first, str(tmp_path / "index"))
    index.refresh()
    same(index, first, queries, 3)
    index.add(spark.createDataFrame([*rows[70:], (None, "w1 w2 w7")], ITEMS))  # ten of them are there already
    same(index, first, queries, 3)  # not before a new version
    index.refresh()
    same(TextIndex(spark, index.folder), whole, queries, 3)
    assert index.version() == 2
    index.refresh()
    same(index, whole, queries, 3)
    assert not (tmp_path / "index" / "version=1").exists()


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], ITEMS)
    index = TextIndex.create(none, str(tmp_path / "index"))
    index.refresh()
    queries = spark.createDataFrame([(1, "a word")], QUERIES)
    assert index.search(queries, 3).count() == 0
    index.add(spark.createDataFrame([(7, "a word"), (8, "another")], ITEMS))
    index.refresh()
    assert [(r["doc_id"], r["rank"]) for r in index.search(queries, 3).orderBy("rank").collect()] == [(7, 1), (8, 2)]
    assert index.search(queries.limit(0), 3).count() == 0


def test_items_of_equal_score_go_by_id(spark, tmp_path):
    """Copies share a score, over several blocks of one list; the smaller ids are first."""
    items = spark.createDataFrame([*[(i, "same words here") for i in range(600, 0, -1)], *[(i, "other things") for i in range(700, 900)]], ITEMS)
    index = TextIndex.create(items, str(tmp_path / "index"))
    index.refresh()
    got = same(index, items, spark.createDataFrame([(1, "same words"), (2, "things here")], QUERIES), 5)
    assert sorted(r["doc_id"] for r in got if r["query_id"] == 1) == [1, 2, 3, 4, 5]


def test_common_words_deal_out_items_and_not_pairs(spark, tmp_path):
    """30 queries of words that all items have need each item once."""
    items = spark.createDataFrame([(i, f"one two {i % 50}") for i in range(200)], ITEMS)
    index = TextIndex.create(items, str(tmp_path / "index"))
    index.refresh()
    queries = spark.createDataFrame([(i, f"one two {i}") for i in range(30)], QUERIES)
    read = index._members(index.needed(queries, 5).where("read"), index.version())
    assert read.count() <= 200
    same(index, items, queries, 5)


def test_terms_are_counted_text_by_text(spark, monkeypatch):
    """No aggregate over all tokens of all texts; counts and weights are right for texts that lower-case oddly, and where most terms are rare."""
    odd = ["A\u0130b K\u212a9 \u00c9a-B_c", None, "", " ", "x" * 70000 + " y", "\u4e2dA1\u4e2da1", "end", "nul\u0000a A"]
    items = spark.createDataFrame(list(enumerate(odd)), ITEMS)
    counted = {r["id"]: (r["len"], {x["term"]: x["n"] for x in r["terms"]}) for r in retrieval.item_terms(items, "doc_id", "content").collect()}
    for r in items.select("doc_id", T.tokens(F.coalesce("content", F.lit(""))).alias("t")).collect():
        assert counted[r["doc_id"]] == (len(r["t"]), dict(Counter(r["t"])))
    rows = spark.createDataFrame([(i, f"one w{i % 7} w{i % 11} only{i}") for i in range(60)], ITEMS)
    queries = spark.createDataFrame([(i, f"w{i} only{i} w3") for i in range(9)], QUERIES)
    best = retrieval.tfidf_top_k(rows, queries, 4)
    assert "Aggregate" not in best._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(retrieval, "HEAD", 2)
    few = retrieval.tfidf_top_k(rows, queries, 4)
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, few.collect()))
