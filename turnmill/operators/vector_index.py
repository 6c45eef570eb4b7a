"""An inverted file over vectors: kept in the shared folder, appended to, and searched in the cells nearest to a query."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.operators.retrieval import ITEM_BLOCK, QUERY_BLOCK, inner_product_top_k, products_of_blocks, top_k
from turnmill.sources.shared import small_batches

#: Vectors that centroids are fitted on, most cells, and vectors that the number of probes is measured with.
SAMPLE, MOST_CELLS, MEASURED = 20_000, 4096, 256
_META = "cells int, probes int, k int, recall double, queries long"


def _nearest_cells(rows: DataFrame, key: str, vector: str, centres: np.ndarray, most: int) -> DataFrame:
    """(id, v, cell, place): the `most` nearest cells of each vector, nearest first."""
    small_batches(rows.sparkSession)  # distances of a batch to all cells are in memory
    held = rows.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CELLS vectors

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        length = (own * own).sum(1)
        for batch in batches:
            for low in range(0, len(batch), ITEM_BLOCK):
                part = batch.slice(low, ITEM_BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
                far = length - 2 * (x @ own.T)  # less the vector's own length, which all cells share
                near = np.argsort(far, axis=1, kind="stable")[:, :most]
                times = pa.array(np.repeat(np.arange(len(part)), near.shape[1]))
                place = np.tile(np.arange(near.shape[1], dtype=np.int32), len(part))
                columns = [part.column(0).take(times), part.column(1).take(times), pa.array(near.ravel().astype(np.int32)), pa.array(place)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "v", "cell", "place"])

    kinds = [rows.schema[c].dataType.simpleString() for c in (key, vector)]
    given = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, vector)
    return given.mapInArrow(work, f"id {kinds[0]}, v {kinds[1]}, cell int, place int")


def _packed_by_cell(rows: DataFrame) -> DataFrame:
    """(cell, i): items of one cell in blocks, packed where they are read, without a shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(2).to_numpy(zero_copy_only=False)
            order = np.argsort(cells, kind="stable")
            edges = np.flatnonzero(np.diff(cells[order], prepend=-1, append=-1))
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                for at in range(low, high, ITEM_BLOCK):
                    rows_ = pa.array(order[at : min(at + ITEM_BLOCK, high)])
                    block = pa.StructArray.from_arrays([batch.column(c).take(rows_) for c in (0, 1)], ["id", "v"])
                    cell = pa.array([cells[order[at]]], pa.int32())
                    yield pa.RecordBatch.from_arrays([cell, pa.ListArray.from_arrays(pa.array([0, len(block)], pa.int32()), block)], ["cell", "i"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "v")]
    return rows.select("id", "v", "cell").mapInArrow(pack, f"cell int, i array<struct<id {kinds[0]}, v {kinds[1]}>>")


class VectorIndex:
    """`folder` holds centroids, the items by cell, and how many cells a search looks into.

    Vectors of a table have one length; rows with a null id or vector aren't indexed. An id that is added twice is found twice.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def build(cls, items: DataFrame, folder: str, *, key: str = "vec_id", vector: str = "embedding", k: int = 10, recall: float = 0.95, cells: int | None = None) -> "VectorIndex":
        """Fits centroids on up to SAMPLE vectors chosen by a hash, assigns all items, and measures how many cells must be
        searched for `recall` of the exact `k` best of up to MEASURED vectors."""
        self = cls(items.sparkSession, folder)
        rows = items.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
        n = rows.count()
        if not n:
            raise ValueError("there are no vectors to fit centroids on")
        cells = min(cells or max(1, round(math.sqrt(n))), MOST_CELLS)
        chosen = rows.orderBy(F.xxhash64(key), key).limit(SAMPLE).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
        found = KMeans(k=cells, seed=7, maxIter=10).fit(chosen).clusterCenters() if n > 1 else []
        if n == 1:
            found = [np.array(rows.first()[vector], float)]
        centres = [(c, [float(x) for x in v]) for c, v in enumerate(found)]
        self.spark.createDataFrame(centres, "cell int, v array<double>").write.parquet(f"{folder}/centres")
        self.add(items, key=key, vector=vector)
        self._measure(rows, key, vector, k, recall)
        return self

    def _centres(self) -> np.ndarray:
        found = self.spark.read.parquet(f"{self.folder}/centres").orderBy("cell").collect()  # at most MOST_CELLS rows
        return np.array([r["v"] for r in found], float)

    def items(self) -> DataFrame:
        """(id, v, cell) of all that is indexed."""
        return self.spark.read.parquet(f"{self.folder}/items")

    def add(self, items: DataFrame, *, key: str = "vec_id", vector: str = "embedding") -> None:
        """Appends items to their cells. What is there is neither read nor moved."""
        found = _nearest_cells(items, key, vector, self._centres(), 1)
        found.drop("place").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).write.mode("append").partitionBy("cell").parquet(
            f"{self.folder}/items"
        )

    def _measure(self, rows: DataFrame, key: str, vector: str, k: int, recall: float) -> None:
        asked = rows.orderBy(F.xxhash64(F.col(key), F.lit(1)), key).limit(MEASURED).select(F.col(key).alias("query_id"), vector)
        exact = inner_product_top_k(rows, asked, k, key, vector)
        centres = self._centres()
        places = _nearest_cells(asked, "query_id", vector, centres, len(centres)).select(F.col("id").alias("query_id"), "cell", "place")
        where = self.items().select(F.col("id").alias(key), "cell").distinct()
        # The neighbours, of which there are at most k * MEASURED, join all items' cells.
        hits = where.join(F.broadcast(exact.select("query_id", key)), key).join(places, ["query_id", "cell"])
        counts = dict(hits.groupBy("place").count().collect())
        total, so_far, probes = sum(counts.values()), 0, len(centres)
        for place in range(len(centres)):
            so_far += counts.get(place, 0)
            if so_far >= recall * total:
                probes = place + 1
                break
        found = [(len(centres), probes, k, so_far / total, asked.count())]
        self.spark.createDataFrame(found, _META).write.mode("overwrite").parquet(f"{self.folder}/meta")

    def meta(self) -> dict:
        """cells, probes, and the recall that so many probes had at k over so many queries when the index was built."""
        return self.spark.read.schema(_META).parquet(f"{self.folder}/meta").first().asDict()

    def search(self, queries: DataFrame, k: int, *, vector: str = "embedding", item: str = "vec_id", probes: int | None = None, exact: bool = False) -> DataFrame:
        """The k best items of each query (query_id, vector) by inner product: query_id, item, score, rank.

        Looks into as many cells as the build has measured, or `probes`, or all of them if `exact`. Queries meet the
        items of their cells in blocks; only k rows of each query and block are shuffled.
        """
        if exact:  # all cells: blocks of queries meet blocks of items, and no query is copied to every cell
            return inner_product_top_k(self.items().select(F.col("id").alias(item), F.col("v").alias(vector)), queries, k, item, vector)
        centres = self._centres()
        most = min(probes or self.meta()["probes"], len(centres))
        asked = _nearest_cells(queries, "query_id", vector, centres, most)
        blocks = max(1, math.ceil(queries.count() * most / max(1, len(centres)) / QUERY_BLOCK))
        asked = asked.groupBy("cell", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("q"))
        pairs = _packed_by_cell(self.items()).join(asked, "cell")
        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {item} {self.items().schema['id'].dataType.simpleString()}"
        return top_k(pairs.select("q", "i").mapInArrow(products_of_blocks(item, k), f"{kinds}, score double"), k, [item])
