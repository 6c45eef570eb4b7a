"""TF-IDF features in batches: the same vectors as the pipeline's, and each text is cut once."""

import random

import pytest
from pyspark.sql import functions as F

from turnmill.operators import models
from turnmill.plans import learning

ODD = ["", None, "a I the of", "naïve café, café naïve", "x_y snake_case ab12 cd", "ÄB ab ÅNGSTRÖM Kelvin İstanbul", "tab\tab\nab  ab", "don't stop-word end."]


def texts(n):
    draw = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ["r", "n", "st", "é", "_x", "7"]] + ["the", "and", "of", "Q"]
    weight = [1 / (k + 1) for k in range(len(words))]
    return ODD * 2 + [" ".join(draw.choices(words, weight, k=draw.randrange(60))).capitalize() for _ in range(n)]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(list(enumerate(texts(300))), "doc_id long, content string").repartition(3).cache()


def by_term(terms, found):
    return {r["doc_id"]: {terms[i]: round(v, 9) for i, v in zip(r["indices"], r["values"], strict=True)} for r in found.collect()}


def of_pipeline(rows, size):
    fitted = models.tfidf_pipeline(size=size).fit(rows.fillna(""))
    terms = fitted.stages[3].vocabulary + fitted.stages[4].vocabulary
    found = fitted.transform(rows.fillna("")).select("doc_id", "tfidf").collect()
    return terms, {r["doc_id"]: {terms[i]: round(float(v), 9) for i, v in zip(r["tfidf"].indices, r["tfidf"].values, strict=True)} for r in found}


def test_vectors_are_the_pipelines(spark, rows):
    terms, vectors = models.tfidf_vectors(rows, "doc_id", size=5000)
    expected_terms, expected = of_pipeline(rows, 5000)
    assert sorted(terms) == sorted(expected_terms) and len(terms) > 200
    assert by_term(terms, vectors) == expected


@pytest.mark.parametrize(("leading", "most_sent"), [(2, 1 << 20), (2, 0), (1 << 13, 1 << 20)])
def test_pairs_beyond_the_leading_words_count(spark, rows, monkeypatch, leading, most_sent):
    """However few words' pairs come first, the most frequent pairs are found."""
    monkeypatch.setattr(models, "LEADING", leading)
    monkeypatch.setattr(models, "MOST_SENT", most_sent)
    terms, _ = models.tfidf_vectors(rows, "doc_id", size=40)
    kept = models.tfidf_pipeline().getStages()
    words = kept[1].transform(kept[0].transform(rows.fillna("")))
    pairs = kept[2].transform(words).select("doc_id", F.explode("pairs").alias("t"))
    every = words.select("doc_id", F.explode("kept").alias("t"))
    for found, part in ((terms[:40], every), (terms[40:], pairs)):
        counts = part.groupBy("t").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).where("d >= 2")
        assert found == [r["t"] for r in counts.orderBy(F.desc("n"), "t").limit(40).collect()]


def test_texts_are_read_once(spark, tmp_path):
    """One pass over the documents, however many passes over words; the pipeline's fit read and cut them four times."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame(list(enumerate(texts(50))), "doc_id long, content string")
    watched = rows.mapInArrow(seen, "doc_id long, content string")
    _, vectors = models.tfidf_vectors(watched, "doc_id", size=40)
    assert vectors.count() == 66 and read.value == 66


def test_no_documents_and_no_terms(spark, tmp_path):
    kinds = "doc_id long, text string, source string, lang string"
    for name, given in (("none", []), ("odd", [(1, None, "s", "en"), (2, "", "s", "en"), (3, "one word", None, None)])):
        spark.createDataFrame(given, kinds).write.parquet(str(tmp_path / name / "documents.parquet"))
        assert [tuple(r) for r in learning.tfidf_features(spark, str(tmp_path / name)).collect()] == [(len(given), True, True)]
