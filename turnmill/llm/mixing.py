"""Mixing sources to target weights by systematic sampling (DataFrame operations only).

Every document of a source has the same expected number of copies, its source's
rate. Along a fixed order of the source the expected copies are summed up, one
random offset is added, and a document is emitted once for each integer that
its stretch of the sum crosses.

The prefix sum is hierarchical so that no task sees a whole source: documents
go to size classes (so that neighbours are of like size, which keeps the words
taken close to the target) and to hash bins within the class. A window over at
most a few hundred classes, one over at most `BINS` bins and a rank within a
bin add up to the document's rank in its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnmill.llm.common import cut_lineage, row_struct, unpack, word_count

BINS = 1024
_OFFSET_BITS = 20


def _hash_int(text: Column) -> Column:
    """First 32 bits of the md5 of a string, as a long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_repeat: float = 2.0
) -> DataFrame:
    """Target words for each source.

    `sizes` has one row per source: `no_source` (true for the null source), `source`,
    `source_size`. Sources take the weights in turn, by code point with null last.
    Together they get `share` of all sizes; none gets more than `max_repeat` times
    its own, and what is cut off is shared again by weight. That settles where
    target = min(cap, weight * level): sources reach their cap in the order of
    cap / weight, so `level` follows from running sums in that order: it is the first
    that its source doesn't cap, and the largest such, as later ones assume too many caps.
    An empty table gives an empty table. The windows run over sources, never over documents.
    """
    everything = W.partitionBy(F.lit(0))
    ranked = sizes.withColumn("k", F.row_number().over(everything.orderBy("no_source", "source")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    capped = (
        ranked.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    )
    order = everything.orderBy(F.col("cap") / F.col("weight"), "k")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    levels = capped.withColumn(
        "level",
        (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward),
    )
    reached = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    return levels.withColumn("level", F.max(reached).over(everything)).select(
        "no_source",
        "source",
        "source_size",
        F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level"))).alias("target"),
    )


def systematic_mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    max_repeat: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """`docs` as the struct `row`, with `size`, `source_size`, `target` and `copies`.

    Nulls: a null text has size 0, null is a source of its own, a null id sorts
    first. Documents of size 0 take copies but no words; a source of size 0 has
    target 0 and no copies. Repeated rows are documents of their own. Same rows
    and seed, same result: rows that tie in id and size are interchangeable.
    An empty table gives an empty table; other columns stay inside `row`.
    """
    size = word_count(F.col("text")) if size is None else size
    ident = F.col(id_col)
    rows = docs.select(
        row_struct(docs).alias("row"),
        ident.alias("ident"),
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        size.alias("size"),
        F.coalesce(_hash_int(ident.cast("string")) % BINS, F.lit(0)).alias("bin"),
    ).withColumn("class", F.floor(F.log(F.col("size") + F.lit(1.0)) * 20).cast("int"))
    keys = ["no_source", "source", "class", "bin"]
    counts = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")))
    classes = counts.groupBy("no_source", "source", "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    sources = classes.groupBy("no_source", "source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sources, weights=weights, share=share, max_repeat=max_repeat)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.floor(
        _hash_int(F.concat_ws("|", F.lit(seed), F.col("no_source").cast("string"), F.col("source"))) / F.lit(2.0 ** (32 - _OFFSET_BITS))
    ) / F.lit(2.0**_OFFSET_BITS)
    targets = targets.withColumn("rate", rate).withColumn("offset", offset)

    def before(order: str, *by: str) -> Column:
        w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(w), F.lit(0))

    classes = classes.withColumn("class_start", before("class", "no_source", "source")).drop("n", "words")
    plan = (
        counts.withColumn("bin_start", before("bin", "no_source", "source", "class"))
        .join(classes.join(targets, ["no_source", "source"]), ["no_source", "source", "class"])
        .withColumn("start", F.col("class_start") + F.col("bin_start"))
        .select(*keys, "start", "source_size", "target", "rate", "offset")
    )
    within = W.partitionBy(*keys).orderBy("ident", "size")
    placed = rows.join(plan, keys).withColumn("rank", F.col("start") + F.row_number().over(within) - 1)

    def crossed(rank: Column) -> Column:
        return F.floor(F.col("offset") + rank * F.col("rate"))

    copies = F.least(crossed(F.col("rank") + 1) - crossed(F.col("rank")), F.lit(max_repeat))
    return placed.select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it (0 to `max_repeat` times)."""
    plan = systematic_mix(docs, **options).where("copies > 0")
    return plan.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        *unpack(plan, "row", docs.columns)
    )
