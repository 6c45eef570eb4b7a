"""Evaluation: quantiles in three definitions, set scores, entropies, classifier metrics, coefficient fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnmill.functions import constants as C
from turnmill.functions import text as T


def ranked_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, c, before, n): distinct values with their counts, how many are smaller, and the key's total.

    Quantiles by position need only this table: values are counted before they are
    sorted, and sorted by ranges: a range is the value's sign, exponent and leading binary
    digits, so that a key's values are dealt to many tasks in order.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("c"))
    counted = counted.withColumn("_bin", _value_range(F.col(value).cast("double")))
    bins = counted.groupBy(F.col(key).alias("_k"), F.col("_bin").alias("_b")).agg(F.sum("c").alias("_c"))
    w = W.partitionBy("_k")
    smaller = F.coalesce(F.sum("_c").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("_start", smaller).withColumn("n", F.sum("_c").over(w)).drop("_c")
    within = W.partitionBy(key, "_bin").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum("c").over(within), F.lit(0)))
    joined = counted.join(bins, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_bin") == F.col("_b")))
    return joined.select(key, value, "c", (F.col("before") + F.col("_start")).alias("before"), "n")


def _value_range(v: Column) -> Column:
    """A number that grows with `v`: 64 steps for each doubling, negative values mirrored; NaN is above all."""
    size = F.least(F.abs(v), F.lit(1.7e308))
    doubling = F.floor(F.log2(F.greatest(size, F.lit(1e-300))) - 1e-9)
    step = F.floor((size / F.pow(F.lit(2.0), doubling) - 1) * 64)
    grade = (doubling + 1100) * 80 + F.greatest(F.lit(0), F.least(step, F.lit(79)))
    return F.when(F.isnan(v), F.lit(1 << 40)).when(size < 1e-300, 0).otherwise(F.signum(v) * grade).cast("long")


def value_at(position: Column) -> Column:
    """Aggregate over ranked_values: the value at a position from 1."""
    return F.max(F.when((position > F.col("before")) & (position <= F.col("before") + F.col("c")), F.col("v")))


def p95_by_definition(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, p50, nearest_rank, by_index, exclusive: 95th percentiles by rank ceil(0.95 n), by sorted[int(0.95 n)],
    and by the exclusive method from 20 values on (below: the maximum, or 1.5 times a single value)."""
    ranked = ranked_values(rows, key, value).withColumnRenamed(value, "v")
    n = F.col("n")
    j = F.greatest(F.lit(1), F.least(F.floor(19 * (n + 1) / 20), n - 1))
    found = ranked.groupBy(key, "n").agg(
        value_at(F.ceil(n * 0.95)).alias("nearest_rank"),
        value_at(F.floor(n * 0.95) + 1).alias("by_index"),
        value_at(j).alias("low"),
        value_at(j + 1).alias("high"),
        value_at(F.floor((n + 1) / 2)).alias("m1"),
        value_at(F.floor((n + 2) / 2)).alias("m2"),
        F.max("v").alias("top"),
    )
    delta = 19 * (n + 1) - 20 * j
    p50 = (F.col("m1") + F.col("m2")) / 2
    exclusive = F.when(n >= 20, (F.col("low") * (20 - delta) + F.col("high") * delta) / 20).when(n == 1, 1.5 * p50).otherwise(F.col("top"))
    return found.select(key, "n", p50.alias("p50"), "nearest_rank", "by_index", exclusive.alias("exclusive"))


def set_scores(expected: Column, retrieved: Column) -> dict[str, Column]:
    """Precision, recall and F1 of two distinct arrays; all 1 if nothing is expected, 0 without a hit."""
    hits = F.size(F.array_intersect(expected, retrieved))
    none, miss = F.size(expected) == 0, (F.size(retrieved) == 0) | (hits == 0)
    precision = F.when(none, 1.0).when(miss, 0.0).otherwise(hits / F.greatest(F.size(retrieved), F.lit(1)))
    recall = F.when(none, 1.0).when(miss, 0.0).otherwise(hits / F.greatest(F.size(expected), F.lit(1)))
    f1 = F.when(none, 1.0).when(miss, 0.0).otherwise(2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12)))
    return {"precision": precision, "recall": recall, "f1": f1}


def overlap_correct(expected: Column, answer: Column) -> Column:
    """Whether an answer's words cover enough of the expected ones: at least min(3, half of them)."""
    hits = F.size(F.array_intersect(expected, answer))
    return hits >= F.least(F.lit(3.0), F.size(expected) * 0.5)


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """(column, n, share)."""
    counted = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0))))


def balance(rows: DataFrame, column: str, classes: int) -> DataFrame:
    """Entropy of the classes by that of even ones: 1 is balanced."""
    shares = distribution(rows, column)
    return shares.agg((-F.sum(F.col("share") * F.log2("share")) / F.log2(F.lit(float(classes)))).alias("balance"))


def confusion(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    return rows.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_scores(rows: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(label, support, precision, recall, f1) from the confusion counts; a ratio without a denominator is 0."""
    counts = confusion(rows, actual, predicted)
    hits = F.sum(F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0))
    real = counts.groupBy(F.col(actual).alias("label")).agg(F.sum("n").alias("support"), hits.alias("hits"))
    said = counts.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("said"))
    out = real.join(said, "label", "left").withColumn("said", F.coalesce("said", F.lit(0)))
    p = F.when(F.col("said") > 0, F.col("hits") / F.greatest("said", F.lit(1))).otherwise(0.0)
    r = F.col("hits") / F.col("support")
    f1 = F.when(p + r > 0, 2 * p * r / F.greatest(p + r, F.lit(1e-12))).otherwise(0.0)
    return out.select("label", "support", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def weighted_scores(scores: DataFrame, costs: Column) -> DataFrame:
    """Averages of class_scores: by support (the weighted recall is the accuracy), and F1 with weights 1 / (cost + 0.1), so
    that cheap classes count more."""
    mean = lambda c: (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}")
    weight = 1.0 / (costs + 0.1)
    return scores.agg(mean("precision"), mean("recall"), mean("f1"), (F.sum(F.col("f1") * weight) / F.sum(weight)).alias("cost_weighted_f1"))


def medians(rows: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """(key, and one median for each of `columns`), all from one ranking; nulls are left out, keys without any value are missing."""
    values = F.array(*[F.struct(F.lit(name).alias("name"), value.cast("double").alias("v")) for name, value in columns.items()])
    stacked = rows.select(F.col(key).alias("k"), F.explode(values).alias("x")).select(F.struct("k", "x.name").alias("kn"), "x.v")
    ranked = ranked_values(stacked, "kn", "v")
    n = F.col("n")
    middle = (value_at(F.floor((n + 1) / 2)) + value_at(F.floor((n + 2) / 2))) / 2
    found = ranked.groupBy("kn", "n").agg(middle.alias("median"))
    wide = [F.max(F.when(F.col("kn.name") == name, F.col("median"))).alias(name) for name in columns]
    return found.groupBy(F.col("kn.k").alias(key)).agg(*wide)


def set_f1(expected: Column, predicted: Column) -> Column:
    """F1 of two distinct arrays: 1 if both are empty, 0 if one is."""
    hits = F.size(F.array_intersect(expected, predicted))
    sizes = F.size(expected) + F.size(predicted)
    return F.when(sizes == 0, 1.0).otherwise(2.0 * hits / F.greatest(sizes, F.lit(1)))


def answer_correct(question_type: Column, question: Column, expected: Column, answer: Column) -> Column:
    """Long-chat answers: a question to abstain from needs words of refusal, any other enough of the expected words."""
    abstain = (question_type == "abstention") | question.contains("_abs")
    words = lambda c: F.array_distinct(T.words(F.lower(c)))
    return F.when(abstain, T.has_part(answer, C.REFUSALS)).otherwise(overlap_correct(words(expected), words(answer)))


def confidence_analysis(rows: DataFrame, actual: str, predicted: str, confidence: str, threshold: float = 0.7) -> DataFrame:
    """One row: accuracy, abstention_rate (below the threshold) and high_conf_accuracy (0 if nothing is above)."""
    right, sure = (F.col(actual) == F.col(predicted)).cast("int"), F.col(confidence) >= threshold
    return rows.agg(
        F.avg(right).alias("accuracy"),
        (1 - F.avg(sure.cast("int"))).alias("abstention_rate"),
        F.coalesce(F.avg(F.when(sure, right)), F.lit(0.0)).alias("high_conf_accuracy"),
    )


def fitted_coefficients(samples: DataFrame, key: str) -> DataFrame:
    """Price and latency coefficients per key from samples (op, observed_cents, observed_ms, n_tokens, k, n_items).

    Robust medians: costs from rows with a cost, latencies from rows with one. What a
    token adds is taken above the rounded median cost, in a second pass.
    """
    cost = F.col("observed_cents")
    first = samples.select(key).distinct().join(
        medians(
            samples,
            key,
            {
                "store": F.when(F.col("op") == "store", cost),
                "retrieve": F.when(F.col("op") == "retrieve", cost),
                "middle": cost,
                "per_k": cost / (F.greatest(F.lit(1), F.col("k")) + 1e-6),
            },
        ),
        key,
        "left",
    )
    joined = samples.join(first.select(key, F.bround("middle").alias("base")), key)
    extra = F.greatest(F.lit(0.0), cost - F.col("base")) / (F.col("n_tokens") + 1e-6)
    second = medians(joined, key, {"extra": F.when((F.col("n_tokens") > 0) & cost.isNotNull(), extra)})
    latency = p95_by_definition(samples, key, "observed_ms").select(key, "n", "p50", F.col("exclusive").alias("p95"))
    m = F.col("middle")
    priced = m.isNotNull()
    zero = lambda c: F.when(priced, c).otherwise(0.0)
    return (
        first.join(second, key, "left")
        .join(latency, key, "left")
        .select(
            key,
            zero(F.coalesce("store", F.lit(C.WRITE))).alias("write"),
            zero(F.coalesce("retrieve", F.lit(C.READ))).alias("read"),
            zero(F.least(F.lit(0.02), m * 0.1)).alias("index_maint"),
            zero(F.least(F.lit(0.01), m * 0.05)).alias("gc_maint"),
            zero(F.least(F.lit(0.005), m * 0.02)).alias("storage_month"),
            F.coalesce(F.bround(m), F.lit(0.0)).cast("int").alias("base_cents"),
            F.coalesce(F.bround(F.col("extra") * 1e6), F.lit(0.0)).cast("int").alias("per_token_micros"),
            F.coalesce("per_k", F.lit(0.0)).alias("per_k_cents"),
            F.coalesce("p50", F.lit(C.P50_MS)).alias("p50_ms"),
            F.coalesce("p95", F.lit(C.P95_MS)).alias("p95_ms"),
        )
    )


def newest_samples(samples: DataFrame, key: str, order: list[str], keep: int = 10000) -> DataFrame:
    """The newest samples of each key: the bounded buffer from which coefficients are refitted."""
    w = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return samples.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")
