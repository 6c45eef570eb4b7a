"""Vector codes by product quantisation, with Lloyd's rounds kept up to date by differences.

Vectors are cut into equal parts; each part position has a codebook, and a vector's
code is the nearest entry of each of its parts. Vectors are scaled to integers, so
that sums are exact in any order.

Vectors lie in blocks of a batch each, written once in buckets by block number. A
round's assignments are a table of the same buckets, so that the next round joins
both where they lie: no vector is shuffled after the first writing. What a block's
changed parts add to and take from the entries' sums stands beside its assignments,
and only that is shuffled. The running sums (a few numbers for each entry) are a
table too, from which the next codebooks follow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm.common import Shelf, shared_dir, sized
from turnmill.llm.words import free_memory

#: Scale of the components, part positions, entries of a codebook, and rounds.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """`rows` (id, vector, label) with `v`: floor(scale * x) of each component. Rows whose vector is null, empty, or has
    components that are null or not finite go."""
    x = F.col("vector")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    held = rows.where(x.isNotNull() & (F.size(x) > 0) & finite)
    return held.select("id", "label", F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale)))).alias("v"))


class Buckets:
    """Tables in the shared folder, bucketed by `block`, that are joined without a shuffle."""

    def __init__(self, spark: SparkSession, shelf: Shelf):
        self.spark, self.shelf, self.names = spark, shelf, []
        self.count = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def put(self, rows: DataFrame) -> DataFrame:
        name = f"turnmill_{uuid4().hex}"
        self.names.append(name)
        path = f"{shared_dir(self.spark)}/tables/{name}"
        writer = rows.write.bucketBy(self.count, "block").option("path", path).option("compression", "zstd")
        writer.format("parquet").saveAsTable(name)
        return self.spark.table(name)

    def clear(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(self.spark)}/tables/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        self.names = []


def _blocks(vectors: DataFrame) -> DataFrame:
    """(ids, labels, v): a row for each batch of vectors, `v` their components one after the other."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                edges = pa.array([0, len(batch)], pa.int32())
                flat = batch.column(2).flatten().cast(pa.int32())
                lists = [pa.ListArray.from_arrays(edges, batch.column(k)) for k in (0, 1)]
                lists.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
                yield pa.RecordBatch.from_arrays(lists, ["ids", "labels", "v"])
        free_memory()

    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("id", "label")}
    return vectors.select("id", "label", "v").mapInArrow(pack, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, v array<int>")


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For vectors `x` and `books` (part, entry, component): the nearest entry of each part, and its squared distance.
    The lower entry wins a tie."""
    parts, entries, width = books.shape
    code = np.zeros((len(x), parts), np.uint8)
    least = np.zeros((len(x), parts), np.int64)
    for p in range(parts):
        own = x[:, p * width : (p + 1) * width]
        for e in range(entries):
            apart = own - books[p, e]
            far = np.einsum("ij,ij->i", apart, apart)
            if e == 0:
                least[:, p] = far
            else:
                closer = far < least[:, p]
                code[closer, p], least[closer, p] = e, far[closer]
    return code, least


def changes(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """What parts whose entry has changed add to the entries' counts and sums, less what they take from their old ones:
    places ((part * entries + entry) * (width + 1), then a count and the sums) and amounts, without zeros."""
    parts = new.shape[1]
    width = x.shape[1] // parts
    total = np.zeros((parts, entries, width + 1), np.int64)
    for p in range(parts):
        moved = np.ones(len(x), bool) if old is None else old[:, p] != new[:, p]
        if moved.any():
            own = np.column_stack([np.ones(moved.sum(), np.int64), x[moved, p * width : (p + 1) * width]])
            np.add.at(total[p], new[moved, p], own)
            if old is not None:
                np.subtract.at(total[p], old[moved, p], own)
    total = total.ravel()
    at = np.flatnonzero(total)
    return at, total[at]


def _round(blocks: DataFrame, books: Broadcast, assigned: DataFrame | None) -> DataFrame:
    """(block, code, at, amount): the blocks' assignments, and what they change since `assigned`."""
    joined = blocks.select("block", "v")
    again = assigned is not None
    if again:
        joined = joined.join(assigned.select("block", "code"), "block")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = books.value
        parts, entries, width = own.shape
        for batch in batches:
            for k in range(len(batch)):
                x = batch.column(1)[k].values.to_numpy().astype(np.int64).reshape(-1, parts * width)
                old = np.frombuffer(batch.column(2)[k].as_py(), np.uint8).reshape(-1, parts) if again else None
                code, _ = nearest(x, own)
                at, amount = changes(x, old, code, entries)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), pa.array([code.tobytes()]), pa.array([at]), pa.array([amount])],
                    ["block", "code", "at", "amount"],
                )
        free_memory()

    return joined.mapInArrow(work, "block long, code binary, at array<long>, amount array<long>")


def _coded(blocks: DataFrame, books: Broadcast) -> DataFrame:
    """(id, label, codes, error): every vector's entries, in hex, and the sum of its parts' squared distances."""
    kinds = {c: blocks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels")}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = books.value
        hexes = np.array([f"{e:02x}" for e in range(own.shape[1])])
        for batch in batches:
            for k in range(len(batch)):
                x = batch.column(2)[k].values.to_numpy().astype(np.int64).reshape(-1, own.shape[0] * own.shape[2])
                code, far = nearest(x, own)
                text = ["".join(row) for row in hexes[code]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[k].values, batch.column(1)[k].values, pa.array(text, pa.string()), pa.array(far.sum(1))],
                    ["id", "label", "code", "error"],
                )
        free_memory()

    return blocks.select("ids", "labels", "v").mapInArrow(work, f"id {kinds['ids']}, label {kinds['labels']}, code string, error long")


def compress_vectors(
    rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """One row for each vector kept: vec_id, code, error, label_error, codebooks_sha256.

    Codebooks start as the parts of the vectors with the `entries` (at most 256) smallest ids and are
    refined in `rounds` rounds: each part goes to its nearest entry (ties: the lower), each entry that
    has parts becomes the componentwise floor of their mean. `error` adds up a vector's squared
    distances, `label_error` the errors of all vectors with an equal label (null labels are equal),
    `codebooks_sha256` names all final entries.

    Vectors that are null or empty, or have null or non-finite components, are dropped; so are vectors of
    another length than most have (the longer at a tie), or all if that length can't be cut into `parts`.
    Null ids come last and repeated ids are ordered by their vectors; rows that repeat count each. With
    fewer vectors than entries, codebooks have as many. An empty table gives an empty table; other
    columns are ignored. Components so large that squared distances might not fit a long raise an error.
    """
    spark = rows.sparkSession
    shelf, result = Shelf(spark), Shelf(spark)
    buckets = Buckets(spark, shelf)
    vectors = integer_vectors(rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label")), scale)
    most = F.max(F.array_max(F.transform("v", F.abs)))
    lengths = vectors.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"), most.alias("most"))
    usual = lengths.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    if not usual or usual[0]["size"] % parts:
        kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("id", "label")}
        return spark.createDataFrame([], f"vec_id {kinds['id']}, code string, error long, label_error long, codebooks_sha256 string")
    size = usual[0]["size"]
    if size * (2 * usual[0]["most"]) ** 2 >= 1 << 63:
        raise ValueError(f"components up to {usual[0]['most'] / scale:g} are too large for exact squared distances")
    vectors = vectors.where(F.size("v") == size)
    first = vectors.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, size // parts).swapaxes(0, 1).copy()
    numbered = _blocks(vectors).withColumn("block", F.monotonically_increasing_id())
    blocks = buckets.put(numbered.repartition(buckets.count, "block"))
    assigned, sums = None, None
    for _ in range(rounds):
        assigned = buckets.put(_round(blocks, shelf.broadcast(books), assigned))
        moved = assigned.select(F.explode(F.arrays_zip("at", "amount")).alias("x")).select("x.at", "x.amount")
        before = moved if sums is None else sums.unionAll(moved)
        held = shelf.put(before.groupBy("at").agg(F.sum("amount").alias("amount")))
        if sums is not None and moved.isEmpty():
            break  # the sums, and so all codebooks to come, stay as they are
        sums = held
        total = np.zeros(books.shape[0] * books.shape[1] * (books.shape[2] + 1), np.int64)
        for row in sums.collect():  # a number for each component of an entry, and a count
            total[row["at"]] = row["amount"]
        total = total.reshape(books.shape[0], books.shape[1], -1)
        used = total[:, :, 0] > 0
        books = books.copy()
        books[used] = total[:, :, 1:][used] // total[:, :, :1][used]
    coded = result.put(_coded(blocks, shelf.broadcast(books)))
    buckets.clear()
    shelf.clear()
    name = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = result.put(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    return coded.join(sized(by_label), F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(name).alias("codebooks_sha256")
    )
