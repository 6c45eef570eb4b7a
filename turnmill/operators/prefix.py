"""Running totals and ranks of a whole table without one task for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bins that a group's rows are dealt to by a hash, and integer keys in one bin of a running total.
BINS, WIDTH = 256, 4096


def running_total(rows: DataFrame, key: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """Adds `name`: the sum of `value` over all rows with a smaller integer `key`, in two levels.

    Keys go to bins of `width`; one window runs over bins, which are few, others within a
    bin. A null value counts as 0. Rows that tie in the key get sums that include neither.
    """
    binned = rows.withColumns({"_bin": F.floor(F.col(key) / width), "_v": F.coalesce(value, F.lit(0))})
    sums = binned.groupBy("_bin").agg(F.sum("_v").alias("_s"))
    wide = W.partitionBy(F.floor(F.col("_bin") / width)).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    far = sums.groupBy(F.floor(F.col("_bin") / width).alias("_far")).agg(F.sum("_s").alias("_t"))
    far = far.withColumn("_before", F.coalesce(F.sum("_t").over(W.partitionBy(F.lit(0)).orderBy("_far").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    starts = sums.withColumn("_far", F.floor(F.col("_bin") / width)).withColumn("_near", F.coalesce(F.sum("_s").over(wide), F.lit(0)))
    starts = starts.join(far.select("_far", "_before"), "_far").select("_bin", (F.col("_near") + F.col("_before")).alias("_start"))
    within = W.partitionBy("_bin").orderBy(key).rangeBetween(W.unboundedPreceding, -1)
    total = F.col("_start") + F.coalesce(F.sum("_v").over(within), F.lit(0))
    return binned.join(starts, "_bin").withColumn(name, total).drop("_bin", "_v", "_start")


def group_ranks(rows: DataFrame, group: str, order: Column, ties: str, rank: str, size: str) -> DataFrame:
    """Adds `rank` (from 1) within each `group` by `order`, a string of hex digits, then `ties`; and the group's `size`.

    The first two digits are the bin: a window ranks within a group's bin, another sums up
    a group's bins, so that a group is never in one task. A null group is one of its own.
    """
    binned = rows.withColumn("_o", order).withColumn("_bin", F.substring("_o", 1, 2))
    counts = binned.groupBy(F.col(group).alias("_g"), F.col("_bin").alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy("_g")
    before = F.coalesce(F.sum("_c").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_start", before).withColumn(size, F.sum("_c").over(w)).drop("_c")
    within = F.row_number().over(W.partitionBy(group, "_bin").orderBy("_o", ties))
    joined = binned.withColumn(rank, within).join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bin") == F.col("_b")))
    return joined.withColumn(rank, F.col(rank) + F.col("_start")).drop("_o", "_bin", "_g", "_b", "_start")
