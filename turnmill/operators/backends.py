"""Memory backends: what a store does, as operations on DataFrames, and a registry of kinds."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions import constants as C
from turnmill.operators import filters, retrieval
from turnmill.sources import sinks

STORED = "item_id long, content string, speaker string, metadata map<string,string>, days_back int"


class Backend(Protocol):
    """A named store of items (STORED). `retrieve` takes queries (query_id, query) and returns query_id, item_id, score, rank."""

    name: str

    def store(self, items: DataFrame) -> None: ...

    def retrieve(self, queries: DataFrame, k: int = 5, wanted: dict[str, str | None] | None = None) -> DataFrame: ...

    def items(self) -> DataFrame: ...

    def count(self) -> int: ...

    def clear(self) -> None: ...

    def statistics(self) -> DataFrame: ...


class TableBackend:
    """Items in a Parquet table that is appended to; kinds differ in how they filter and score."""

    def __init__(self, spark: SparkSession, name: str, folder: str, score: Callable[[DataFrame, DataFrame, int], DataFrame], strict: bool):
        self.spark, self.name, self.folder, self.score, self.strict = spark, name, folder, score, strict
        self.clear_if_missing()

    def clear_if_missing(self) -> None:
        self.spark.createDataFrame([], STORED).write.mode("ignore").parquet(self.folder)

    def store(self, items: DataFrame) -> None:
        columns = [f.split()[0] for f in STORED.split(", ")]
        sinks.append_vectors(items.select(*columns), self.folder)

    def items(self) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(self.folder)

    def retrieve(self, queries: DataFrame, k: int = 5, wanted: dict[str, str | None] | None = None) -> DataFrame:
        rule = filters.metadata_strict if self.strict else filters.metadata_lenient
        held = self.items()
        if wanted:
            held = held.where(rule(F.col("speaker"), F.col("metadata"), wanted))
        return self.score(held, queries, k)

    def count(self) -> int:
        return self.items().count()

    def clear(self) -> None:
        sinks.replace(self.spark.createDataFrame([], STORED), self.folder)

    def statistics(self) -> DataFrame:
        return self.items().agg(F.lit(self.name).alias("backend"), F.count(F.lit(1)).alias("total_items"), F.count_distinct("speaker").alias("speakers"))


def _memory(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return retrieval.tfidf_top_k(items, queries, k, item="item_id")


def _file(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return retrieval.jaccard_top_k(items, queries, k, item="item_id", days_back=F.coalesce("days_back", F.lit(0)))


class Registry:
    """Kinds of backends by name, each with its capabilities, and the instances made of them."""

    def __init__(self) -> None:
        self.kinds: dict[str, Callable[[SparkSession, str], Backend]] = {}
        self.capabilities: dict[str, list[str]] = {}
        self.instances: dict[str, Backend] = {}

    def register(self, name: str, make: Callable[[SparkSession, str], Backend], capabilities: list[str]) -> None:
        """Adds a kind; ValueError if there is one of that name."""
        if name in self.kinds:
            raise ValueError(f"{name} is registered already")
        self.kinds[name], self.capabilities[name] = make, list(capabilities)

    def create(self, spark: SparkSession, name: str, folder: str, instance: str | None = None) -> Backend:
        """A new instance; KeyError if there is no such kind."""
        made = self.kinds[name](spark, folder)
        self.instances[instance or name] = made
        return made

    def get(self, instance: str) -> Backend:
        return self.instances[instance]

    def names(self) -> list[str]:
        return sorted(self.kinds)

    def table(self, spark: SparkSession) -> DataFrame:
        """(backend, capabilities)."""
        return spark.createDataFrame([(n, self.capabilities[n]) for n in self.names()], "backend string, capabilities array<string>")

    def clear(self) -> None:
        self.kinds, self.capabilities, self.instances = {}, {}, {}


def default_registry() -> Registry:
    """The text backends: one ranks by TF-IDF under strict filters, the other by overlap and age under lenient ones."""
    found = Registry()
    capabilities = dict(C.BACKENDS)
    found.register("memory_store", lambda s, f: TableBackend(s, "memory_store", f, _memory, True), capabilities["memory_store"])
    found.register("file_store", lambda s, f: TableBackend(s, "file_store", f, _file, False), capabilities["file_store"])
    return found
