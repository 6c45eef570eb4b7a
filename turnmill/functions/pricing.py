"""Prices in cents as columns; price tables are small literal dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions import constants as C


def write_cost(n_tokens: Column, write: Column | float = C.WRITE, index: Column | float = C.INDEX) -> Column:
    return write + n_tokens * F.lit(C.PER_TOKEN) + index / F.lit(30.0)


def read_cost(k: Column, n_items: Column, read: Column | float = C.READ) -> Column:
    return read + k * F.lit(C.PER_RESULT) + F.log(10.0, F.greatest(F.lit(1), n_items)) * F.lit(C.PER_LOG_ITEMS)


def storage_cost(megabytes: Column, month: Column | float = C.STORAGE_MONTH) -> Column:
    return month * megabytes


def maintenance_cost(n_items: Column, gc_runs: int = 4, index: Column | float = C.INDEX, gc: Column | float = C.GC) -> Column:
    return index * n_items + gc * n_items * F.lit(float(gc_runs))


def whole_cents(cents: Column) -> Column:
    """Rounded half to even, never negative."""
    return F.greatest(F.lit(0), F.bround(cents).cast("int"))


def latency_ms(concurrency: Column, p50: Column, p95: Column) -> Column:
    return p50 + (p95 - p50) * F.when(concurrency.isin("single", "light"), 0.25).otherwise(0.8)


def with_prices(ops: DataFrame, pricebook: DataFrame) -> DataFrame:
    """`ops` (backend, op) with that key's coefficients, or the defaults where it has none.

    The pricebook has one row per backend and operation; Spark broadcasts it if it is small.
    """
    joined = ops.join(pricebook, ["backend", "op"], "left")
    defaults = {"write": C.WRITE, "read": C.READ, "index_maint": C.INDEX, "gc_maint": C.GC, "p50_ms": C.P50_MS, "p95_ms": C.P95_MS}
    defaults |= {"base_cents": 0, "per_token_micros": 0, "per_k_cents": 0.0, "per_logn_cents": 0.0}
    return joined.select(*ops.columns, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def predicted(priced: DataFrame) -> DataFrame:
    """Adds predicted_cents and predicted_ms for rows with op, n_tokens, k, n_items, concurrency and coefficients."""
    c = F.col
    cents = (
        F.when(c("op") == "store", write_cost(c("n_tokens"), c("write"), c("index_maint")))
        .when(c("op") == "retrieve", read_cost(c("k"), c("n_items"), c("read")))
        .when(c("op") == "maintain", maintenance_cost(c("n_items"), 4, c("index_maint"), c("gc_maint")))
        .otherwise(
            c("base_cents")
            + c("per_token_micros") * c("n_tokens") / 1e6
            + c("per_k_cents") * F.greatest(F.lit(1), c("k"))
            + c("per_logn_cents") * F.log(10.0, F.greatest(F.lit(1), c("n_items")))
        )
    )
    return priced.withColumn("predicted_cents", whole_cents(cents)).withColumn(
        "predicted_ms", latency_ms(c("concurrency"), c("p50_ms"), c("p95_ms"))
    )


def pricebook(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(
        rows,
        "backend string, op string, write double, read double, index_maint double, gc_maint double, base_cents int,"
        " per_token_micros int, per_k_cents double, per_logn_cents double, p50_ms double, p95_ms double",
    )


def summary_prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.SUMMARY_PRICES, "model string, price double")


def size_factors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.SIZE_FACTORS, "size_class string, factor double")


def budgets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.BUDGETS, "budget string, conversation_limit double, critical_above double")


def with_budget_limits(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """`rows` (with budget) and its limits; an unknown budget has the standard conversation limit."""
    joined = rows.join(dimension.select("budget", "conversation_limit"), "budget", "left")
    limits = {"operation_limit": C.OPERATION_LIMIT, "session_limit": C.SESSION_LIMIT, "daily_limit": C.DAILY_LIMIT, "burst_limit": C.BURST_LIMIT}
    limit = F.coalesce("conversation_limit", F.lit(5.0)).alias("conversation_limit")
    return joined.select(*rows.columns, limit, *[F.lit(v).alias(k) for k, v in limits.items()])


def file_store_cost(c: Column) -> Column:
    return 1e-5 * F.least(F.length(c) / 1000.0, F.lit(2.0))


def file_retrieve_cost(n_files: Column, k: Column) -> Column:
    return 1e-4 * F.least(n_files / 100.0, F.lit(10.0)) * F.least(k / 5.0, F.lit(2.0))


def vector_store_cost(c: Column, persisted: bool = True) -> Column:
    return 1e-4 * F.least(F.length(c) / 500.0, F.lit(3.0)) + F.lit(1e-4 if persisted else 0.0)


def vector_retrieve_cost(query: Column, k: Column, n_items: Column) -> Column:
    text = 1e-4 * F.least(F.length(query) / 200.0, F.lit(2.0))
    return text + 1e-4 * F.least(k / 5.0, F.lit(1.5)) * F.least(n_items / 1000.0, F.lit(2.0))


def summary_cost_gpt(tokens_in: Column, tokens_out: Column) -> Column:
    return (tokens_in / 1000.0 * 0.03 + tokens_out / 1000.0 * 0.06) * 100


def labelling_cost(tokens_in: Column, tokens_out: Column, per_1k_in: float = 0.00015, per_1k_out: float = 0.0006) -> Column:
    return tokens_in / 1000.0 * F.lit(per_1k_in) + tokens_out / 1000.0 * F.lit(per_1k_out)
