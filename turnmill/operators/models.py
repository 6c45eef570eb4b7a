"""Learned routing: features to classes with calibrated confidence, and a TF-IDF pipeline."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.operators.policies import gated
from turnmill.operators.retrieval import tokens_of
from turnmill.sources.shared import small_batches, written

#: Words whose pairs are counted first, and words that are sent to all tasks at most.
LEADING, MOST_SENT = 1 << 13, 1 << 20


def train_router(rows: DataFrame, features: list[str], label: str, seed: int = 42, trees: int = 30) -> PipelineModel:
    """A random forest on numeric columns; `label` is the class number."""
    vector = VectorAssembler(inputCols=features, outputCol="vector", handleInvalid="keep")
    forest = RandomForestClassifier(featuresCol="vector", labelCol=label, numTrees=trees, maxDepth=6, seed=seed)
    return Pipeline(stages=[vector, forest]).fit(rows)


def _with_shares(model: PipelineModel | BoostedRouter, rows: DataFrame) -> DataFrame:
    out = model.transform(rows)
    return out.withColumn("shares", F.col("probability") if isinstance(model, BoostedRouter) else vector_to_array("probability"))


def calibrate(model: PipelineModel | BoostedRouter, rows: DataFrame, label: str, classes: int) -> list:
    """One isotonic curve per class, from the model's share for it to how often it is right."""
    scored = _with_shares(model, rows)
    curves = []
    for k in range(classes):
        one = scored.select(F.get("shares", F.lit(k)).alias("features"), (F.col(label) == k).cast("double").alias("label"))
        curves.append(IsotonicRegression(featuresCol="features").fit(one))
    return curves


def predict(model: PipelineModel | BoostedRouter, rows: DataFrame, curves: list | None = None) -> DataFrame:
    """Adds shares (an array that sums to one), class_id and confidence."""
    out = _with_shares(model, rows).drop("rawPrediction", "probability", "prediction", "vector")
    for k, curve in enumerate(curves or []):
        out = out.withColumn("features", F.get("shares", F.lit(k)))
        out = curve.transform(out).withColumnRenamed("prediction", f"_c{k}").drop("features")
    if curves:
        raw = F.array(*[F.greatest(F.col(f"_c{k}"), F.lit(1e-6)) for k in range(len(curves))])
        total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
        out = out.withColumn("shares", F.transform(raw, lambda x: x / total)).drop(*[f"_c{k}" for k in range(len(curves))])
    best = F.array_max("shares")
    return out.withColumn("confidence", best).withColumn("class_id", (F.array_position("shares", best) - 1).cast("int"))


def routed_by_model(scored: DataFrame, names: list[str], fallback, least: float = 0.75) -> DataFrame:
    """Adds route, abstained and action: unsure predictions leave the action to `fallback`."""
    route = F.element_at(F.array(*map(F.lit, names)), F.col("class_id") + 1)
    out = scored.withColumn("route", route).withColumn("abstained", F.col("confidence") < least)
    return out.withColumn("action", gated(F.col("route"), F.col("confidence"), fallback, least))


class BoostedRouter:
    """Boosted trees, one set against the rest for each class, over one vector of features."""

    def __init__(self, vector: VectorAssembler, models: list[GBTClassificationModel | None]):
        self.vector, self.models = vector, models

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str], label: str, classes: int, *, rounds: int = 20, depth: int = 4, seed: int = 42) -> "BoostedRouter":
        """`label` is the class number. The vectors are worked out once, and classes are fitted side by side. A class that no
        row or every row has needs no trees."""
        vector = VectorAssembler(inputCols=features, outputCol="vector", handleInvalid="keep")
        held = written(vector.transform(rows.select(*features, F.col(label).cast("int").alias("class"))).select("vector", "class"), "boosted")
        sizes = {r["class"]: r["count"] for r in held.groupBy("class").count().collect()}

        def one(k: int) -> GBTClassificationModel | None:
            if sizes.get(k, 0) in (0, sum(sizes.values())):
                return None
            trees = GBTClassifier(featuresCol="vector", labelCol="is_class", maxIter=rounds, maxDepth=depth, seed=seed)
            return trees.fit(held.withColumn("is_class", (F.col("class") == k).cast("double")))

        with ThreadPoolExecutor(classes) as pool:
            models = list(pool.map(one, range(classes)))
        found = cls(vector, models)
        found.always = [1.0 if sizes and sizes.get(k, 0) == sum(sizes.values()) else 0.0 for k in range(classes)]
        return found

    always: list[float] = []

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds probability: an array of the classes' chances, each against the rest, divided by their sum."""
        out = self.vector.transform(rows)
        for k, model in enumerate(self.models):
            if model is None:
                out = out.withColumn(f"_p{k}", F.lit(self.always[k]))
            else:
                scored = model.setProbabilityCol(f"_v{k}").setRawPredictionCol(f"_r{k}").setPredictionCol(f"_c{k}").transform(out)
                out = scored.withColumn(f"_p{k}", vector_to_array(f"_v{k}")[1]).drop(f"_v{k}", f"_r{k}", f"_c{k}")
        raw = F.array(*[F.col(f"_p{k}") for k in range(len(self.models))])
        total = F.greatest(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x), F.lit(1e-12))
        return out.withColumn("probability", F.transform(raw, lambda x: x / total)).drop("vector", *[f"_p{k}" for k in range(len(self.models))])

    def save(self, folder: str) -> None:
        self.vector.write().overwrite().save(f"{folder}/vector")
        for k, model in enumerate(self.models):
            if model is not None:
                model.write().overwrite().save(f"{folder}/class-{k}")
        spark = SparkSession.active()
        kept = [(k, model is not None, always) for k, (model, always) in enumerate(zip(self.models, self.always, strict=True))]
        spark.createDataFrame(kept, "class int, trees boolean, always double").write.mode("overwrite").parquet(f"{folder}/classes")

    @classmethod
    def load(cls, folder: str) -> "BoostedRouter":
        classes = SparkSession.active().read.parquet(f"{folder}/classes").orderBy("class").collect()
        models = [GBTClassificationModel.load(f"{folder}/class-{r['class']}") if r["trees"] else None for r in classes]
        found = cls(VectorAssembler.load(f"{folder}/vector"), models)
        found.always = [r["always"] for r in classes]
        return found


def cross_validated(rows: DataFrame, fold: str, folds: int, fit: Callable[[DataFrame], PipelineModel | BoostedRouter]) -> DataFrame:
    """`rows` with shares, class_id and confidence from a model that was fitted on the other folds (`fold` counts from 0).

    Folds are fitted side by side. `fit` takes rows and returns a model; the rows are written once before.
    """
    held = written(rows, "folds")
    with ThreadPoolExecutor(folds) as pool:
        models = list(pool.map(lambda k: fit(held.where(F.col(fold) != k)), range(folds)))
    out = None
    for k, model in enumerate(models):
        part = predict(model, held.where(F.col(fold) == k))
        out = part if out is None else out.unionByName(part)
    return out


def tfidf_pipeline(text: str = "content", size: int = 1000) -> Pipeline:
    """Words of two letters or more and pairs of them, at least in two texts, without stop words, as unit vectors."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="tokens", pattern=r"\b[a-zA-Z][a-zA-Z]+\b", gaps=False),
            StopWordsRemover(inputCol="tokens", outputCol="kept"),
            NGram(inputCol="kept", outputCol="pairs", n=2),
            CountVectorizer(inputCol="kept", outputCol="one", vocabSize=size, minDF=2),
            CountVectorizer(inputCol="pairs", outputCol="two", vocabSize=size, minDF=2),
            VectorAssembler(inputCols=["one", "two"], outputCol="counts"),
            IDF(inputCol="counts", outputCol="weights"),
            Normalizer(inputCol="weights", outputCol="tfidf"),
        ]
    )


def _kept_words(rows: DataFrame, key: str, text: str, pattern: str, stop: list[str]) -> DataFrame:
    """`key` and the words that tokenizer and stop words of `tfidf_pipeline` leave, joined by blanks; written.

    In ASCII the pattern is a run of letters, digits and underscores that has two letters or more and nothing else, which
    tasks find in whole batches. Other texts go through the pattern itself.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = F.array_join(F.regexp_extract_all(low, F.lit(pattern), F.lit(0)), " ")
    plain = F.when(F.octet_length(low) == F.char_length(low), low).otherwise(found)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, length = tokens_of(batch.column(1), "abcdefghijklmnopqrstuvwxyz0123456789_")
            held = names.dictionary_encode()
            good = pc.and_(pc.match_substring_regex(held.dictionary, "^[a-z]{2,}$"), pc.invert(pc.is_in(held.dictionary, pa.array(stop))))
            stays = good.take(held.indices)
            row = np.repeat(np.arange(len(batch)), length)[stays.to_numpy(zero_copy_only=False)]
            bounds = np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), names.filter(stays)), " ")], [key, "words"])

    small_batches(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    return written(rows.select(key, plain.alias("words")).mapInArrow(keep, f"`{key}` {kind}, words string"), "tfidf_words")


def _coded(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """The distinct words of a batch, the number of each word in these, and its row."""
    names, length = tokens_of(texts)
    held = names.dictionary_encode()
    return held.dictionary, held.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(texts)), length)


def _counted(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes, how often each occurs and in how many rows; `rows` ascend."""
    order = np.argsort(codes, kind="stable")
    codes, rows = codes[order], rows[order]
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    first = np.flatnonzero(new)
    new[1:] |= rows[1:] != rows[:-1]
    docs = np.add.reduceat(new, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes))), docs


def _term_counts(words: DataFrame, least: int, pairs: bool = False, among: list[str] | None = None) -> DataFrame:
    """(term, n, docs): how often each word, or pair of neighbours, occurs and in how many rows, if in `least` at least.
    `among`: only pairs of these words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = pa.array(among, pa.string()) if among is not None else None
        for batch in batches:
            names, code, row = _coded(batch.column(0))
            if pairs:
                near = row[1:] == row[:-1]
                if chosen is not None:
                    known = pc.is_in(names, chosen).to_numpy(zero_copy_only=False)[code]
                    near &= known[1:] & known[:-1]
                code, row = (code[:-1] * len(names) + code[1:])[near], row[1:][near]
            code, n, docs = _counted(code, row)
            if pairs:
                one, two = (names.take(pa.array(x)) for x in np.divmod(code, max(len(names), 1)))
                terms = pc.binary_join_element_wise(one, two, " ")
            else:
                terms = names.take(pa.array(code))
            yield pa.RecordBatch.from_arrays([terms, pa.array(n), pa.array(docs)], ["term", "n", "docs"])

    counts = words.select("words").mapInArrow(count, "term string, n long, docs long")
    return counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)


def _vocabularies(words: DataFrame, size: int, least: int) -> list[list]:
    """The `size` most frequent words and pairs (term, n, docs) of those in `least` rows at least; equal counts by name.

    A pair is no more frequent than either of its words. So pairs of the LEADING words are counted first; where the last of
    the best isn't above all words left out, the words as frequent as it are taken, beside which no pair can count.
    """

    def best(counts: DataFrame, most: int) -> list:
        return counts.orderBy(F.desc("n"), "term").limit(most).collect()

    singles = written(_term_counts(words, least), "tfidf_counts")
    leading = best(singles, max(size, LEADING + 1))
    left_out = leading[LEADING]["n"] if len(leading) > LEADING else 0
    pairs = best(_term_counts(words, least, True, [r["term"] for r in leading[:LEADING]]), size)
    lowest = pairs[-1]["n"] if len(pairs) == size else 1
    if left_out >= lowest:
        more = singles.where(F.col("n") >= lowest).select("term")
        among = [r["term"] for r in more.collect()] if more.count() <= MOST_SENT else None
        pairs = best(_term_counts(words, least, True, among), size)
    return [leading[:size], pairs]


def tfidf_vectors(rows: DataFrame, key: str, text: str = "content", size: int = 1000) -> tuple[list[str], DataFrame]:
    """The terms and, by `key`, the vectors (indices, values) that `tfidf_pipeline`, fitted to `rows`, gives them.

    Each text is cut once; its words are written, counted batch by batch and looked up. A null text has no words. Where
    counts are equal at the end of a vocabulary, the pipeline takes any term, this the first by name.
    """
    cut, drop, _, counter, *_ = tfidf_pipeline(text, size).getStages()
    words = _kept_words(rows, key, text, cut.getPattern(), drop.getStopWords())
    singles, pairs = _vocabularies(words, size, int(counter.getMinDF()))
    total, terms = words.count(), [r["term"] for r in singles + pairs]
    idf = np.log((total + 1.0) / (np.array([r["docs"] for r in singles + pairs]) + 1.0))
    halves = [r["term"].split(" ") for r in pairs]
    parts = sorted({w for both in halves for w in both})
    number = {w: i for i, w in enumerate(parts)}
    joined = np.array([number[a] * len(parts) + number[b] for a, b in halves], np.int64)
    by_code = np.argsort(joined)
    alone, columns = [r["term"] for r in singles], len(singles)

    def places(names: pa.StringArray, vocabulary: list[str]) -> np.ndarray:
        return pc.fill_null(pc.index_in(names, pa.array(vocabulary, pa.string())), -1).to_numpy().astype(np.int64)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, code, row = _coded(batch.column(1))
            one, part = places(names, alone)[code], places(names, parts)[code]
            near = (row[1:] == row[:-1]) & (part[1:] >= 0) & (part[:-1] >= 0)
            code_of_pair = (part[:-1] * len(parts) + part[1:])[near]
            at = np.searchsorted(joined[by_code], code_of_pair)
            hit = np.append(joined[by_code], -1)[at] == code_of_pair
            column = np.concatenate([one[one >= 0], columns + by_code[at[hit]]])
            found, n = np.unique(np.concatenate([row[one >= 0], row[1:][near][hit]]) * max(len(terms), 1) + column, return_counts=True)
            row, column = np.divmod(found, max(len(terms), 1))
            weight = n * idf[column]
            length = np.sqrt(np.bincount(row, weight * weight, len(batch)))[row]
            bounds = pa.array(np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32))
            values = np.divide(weight, length, out=weight, where=length > 0)
            lists = [pa.ListArray.from_arrays(bounds, x) for x in (pa.array(column.astype(np.int32)), pa.array(values))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], [key, "indices", "values"])

    kind = words.schema[key].dataType.simpleString()
    return terms, words.mapInArrow(weigh, f"`{key}` {kind}, indices array<int>, values array<double>")
