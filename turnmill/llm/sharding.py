"""Sharding by minimax contiguous partition (DataFrame operations only).

Equal texts form an atomic group, ordered by hash. A group above an equal share of
the bytes has a shard of its own; the others, in order, go to the other shards. The
smallest capacity for which a greedy left-to-right pass over the groups needs no more
shards than there are is found by binary search. Each shard is then cut where it comes
nearest to an equal part of what is left, as far as that capacity allows.

There may be billions of groups, so the search runs on blocks of neighbouring groups,
which fit one row, and narrows down: for every capacity that may still be the smallest, it
bounds where the passes from the left and from the right can end a shard. Only blocks that
such an end may fall into are split by further digits of the hash, until none is left that
holds several groups. What is then found holds over single groups.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnmill.llm.common import cut_lineage

#: Hash digits (bits) of the first blocks, and of the parts in which shards are numbered.
BITS = 16
BINS = 1024


def minimax_capacity(sizes: Column, shards: int) -> Column:
    """Smallest capacity with which greedy filling cuts the array `sizes` into at most `shards` runs.

    The capacity lies between max(largest, mean) and mean + largest, where greedy
    filling always succeeds.
    """
    zero = F.lit(0).cast("long")
    total = F.aggregate(sizes, zero, lambda a, x: a + x)
    largest = F.coalesce(F.array_max(sizes), zero)
    mean = F.ceil(total / F.lit(shards)).cast("long")

    def runs(capacity: Column) -> Column:
        start = F.struct(F.lit(1).alias("n"), zero.alias("used"))

        def add(a: Column, x: Column) -> Column:
            fits = a["used"] + x <= capacity
            return F.struct(
                F.when(fits, a["n"]).otherwise(a["n"] + 1).alias("n"),
                F.when(fits, a["used"] + x).otherwise(x).alias("used"),
            )

        return F.aggregate(sizes, start, add, lambda a: a["n"])

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("long")
        fits = runs(mid) <= shards
        return F.when(s["lo"] >= s["hi"], s).when(fits, F.struct(s["lo"].alias("lo"), mid.alias("hi"))).otherwise(
            F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))
        )

    bounds = F.struct(F.greatest(largest, mean).alias("lo"), (mean + largest).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(63)), bounds, halve, lambda s: s["lo"])


def cut_ends(ends: Column, capacity: Column, shards: int) -> Column:
    """Running totals at which each shard ends: nearest to equal parts of what is left, none above `capacity`.

    `ends` are the units' running totals. A cut leaves no more than the shards after it can hold, which
    greedy filling from the right tells. Each shard gets a unit while there are any.
    """
    zero = F.lit(0).cast("long")
    total = F.coalesce(F.array_max(ends), zero)

    def leave(least: Column, _: Column) -> Column:
        found = F.array_min(F.filter(ends, lambda e: e >= F.element_at(least, -1) - capacity))
        enough = F.element_at(least, -1) <= capacity
        return F.concat(least, F.array(F.when(enough, zero).otherwise(found)))

    def cut(s: Column, left: Column) -> Column:
        start = F.coalesce(F.try_element_at(s["cuts"], F.lit(-1)), zero)
        equal = start + (total - start) / left
        fits = F.filter(ends, lambda e: (e > start) & (e <= start + capacity) & (e >= F.element_at(s["least"], left)))
        nearest = F.array_min(F.transform(fits, lambda e: F.struct(F.abs(e - equal).alias("off"), e.alias("end"))))
        end = F.coalesce(nearest["end"], start)
        return F.struct(s["least"].alias("least"), F.concat(s["cuts"], F.array(end)).alias("cuts"))

    # least[k]: where the last k - 1 shards may begin at the earliest
    least = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), F.array(total), leave)
    begin = F.struct(least.alias("least"), F.array().cast("array<bigint>").alias("cuts"))
    return F.aggregate(F.sequence(F.lit(shards), F.lit(1), F.lit(-1)), begin, cut, lambda s: s["cuts"])


def above_equal_share(sizes: list[int], total: int, shards: int) -> int:
    """How many of the largest units, `sizes` downwards, are above an equal share of what the larger ones leave."""
    for k, size in enumerate(sizes):
        if size * (shards - k) <= total:
            return k
        total -= size
    return len(sizes)


def least_capacity(blocks: Column, largest: Column, most: Column, shards: int) -> Column:
    """A capacity that none over single groups can be below, from `blocks` (bytes, single).

    A block of several groups counts as if it could be cut anywhere. `largest` is the largest group,
    `most` a capacity that suffices.
    """
    zero = F.lit(0).cast("long")

    def runs(capacity: Column) -> Column:
        start = F.struct(F.lit(1).cast("long").alias("n"), zero.alias("at"), capacity.alias("limit"))

        def add(a: Column, x: Column) -> Column:
            end = a["at"] + x["bytes"]
            more = F.when(x["single"], F.lit(1).cast("long")).otherwise(F.ceil((end - a["limit"]) / capacity).cast("long"))
            limit = F.when(x["single"], a["at"] + capacity).otherwise(a["limit"] + more * capacity)
            return F.when(end <= a["limit"], F.struct(a["n"].alias("n"), end.alias("at"), a["limit"].alias("limit"))).otherwise(
                F.struct((a["n"] + more).alias("n"), end.alias("at"), limit.alias("limit"))
            )

        return F.aggregate(blocks, start, add, lambda a: a["n"])

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("long")
        fits = F.struct(s["lo"].alias("lo"), mid.alias("hi"))
        fails = F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).when(runs(mid) <= shards, fits).otherwise(fails)

    total = F.aggregate(blocks, zero, lambda a, x: a + x["bytes"])
    mean = F.ceil(total / F.lit(shards)).cast("long")
    bounds = F.struct(F.greatest(largest, mean, F.lit(1).cast("long")).alias("lo"), F.greatest(most, F.lit(1).cast("long")).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(63)), bounds, halve, lambda s: s["lo"])


def earliest_ends(blocks: Column, capacity: Column) -> Column:
    """Totals that the ends of a greedy pass over single groups, of at least this capacity, can't be below.

    A block that doesn't fit is left for the next shard. One that is above the capacity may hold several
    ends (two shards in a row are above it together), and its start is a bound for each.
    """
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("at"), capacity.alias("limit"), F.array().cast("array<bigint>").alias("ends"))

    def add(a: Column, x: Column) -> Column:
        end = a["at"] + x["bytes"]
        inside = F.when(x["bytes"] <= capacity, F.lit(1)).otherwise(2 * F.ceil(x["bytes"] / capacity).cast("int") + 1)
        limit = F.when(x["bytes"] <= capacity, a["at"] + capacity).otherwise(end)
        return F.when(end <= a["limit"], F.struct(end.alias("at"), a["limit"].alias("limit"), a["ends"].alias("ends"))).otherwise(
            F.struct(end.alias("at"), limit.alias("limit"), F.concat(a["ends"], F.array_repeat(a["at"], inside)).alias("ends"))
        )

    return F.aggregate(blocks, start, add, lambda a: a["ends"])


def latest_ends(blocks: Column, capacity: Column, shards: int) -> Column:
    """Totals that those ends can't be above, if the capacity is at most this: blocks of several groups are cut anywhere."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("at"), capacity.alias("limit"), F.array().cast("array<bigint>").alias("ends"))

    def add(a: Column, x: Column) -> Column:
        end = a["at"] + x["bytes"]
        more = F.when(x["single"], F.lit(1)).otherwise(F.ceil((end - a["limit"]) / capacity).cast("int"))
        inside = F.transform(F.sequence(F.lit(0), more - 1), lambda i: a["limit"] + i * capacity)
        limit = F.when(x["single"], a["at"] + capacity).otherwise(a["limit"] + more * capacity)
        return F.when(end <= a["limit"], F.struct(end.alias("at"), a["limit"].alias("limit"), a["ends"].alias("ends"))).otherwise(
            F.struct(
                end.alias("at"),
                limit.alias("limit"),
                F.concat(a["ends"], F.when(x["single"], F.array(a["at"])).otherwise(inside)).alias("ends"),
            )
        )

    ends = F.aggregate(blocks, start, add, lambda a: a["ends"])
    total = F.aggregate(blocks, zero, lambda a, x: a + x["bytes"])
    return F.concat(ends, F.array_repeat(total, shards))  # a pass that is through early ends with the table


def narrowed(groups: DataFrame, shards: int, bits: int = BITS) -> DataFrame:
    """One row (blocks, capacity): `blocks` in order with bytes, single, last (largest hash), digits, shift; and the
    smallest capacity for which the groups (hash, bytes) need at most `shards` runs.

    Greedy ends can only fall on ends of these blocks, whatever capacity from there on is chosen. A round
    splits the blocks in doubt, some 2^`bits` parts in all, and narrows the range of capacities as well.
    """

    def cut(part: DataFrame, shift: int) -> DataFrame:
        digits = F.shiftright("hash", shift)
        sums = part.groupBy(digits.alias("digits")).agg(
            F.sum("bytes").alias("bytes"), F.max("hash").alias("last"), (F.min("hash") == F.max("hash")).alias("single")
        )
        return sums.select("last", "bytes", "single", "digits", F.lit(shift).alias("shift"))

    def doubtful(x: Column, shift: int) -> Column:
        within = F.exists("ranges", lambda r: (r["low"] < x["end"]) & (r["high"] > x["end"] - x["bytes"]))
        return ~x["single"] & (x["shift"] == shift) & within

    largest = groups.agg(F.coalesce(F.max("bytes"), F.lit(0)).cast("long")).first()[0]
    shift = 64 - bits
    blocks = cut(groups, shift)
    while True:
        in_order = W.partitionBy(F.lit(0)).orderBy("last").rowsBetween(W.unboundedPreceding, W.currentRow)
        ends = blocks.withColumn("end", F.sum("bytes").over(in_order))  # at most some 2^bits rows a round
        row = ends.agg(F.array_sort(F.collect_list(F.struct("last", "bytes", "single", "digits", "shift", "end"))).alias("blocks"))
        row = cut_lineage(row.withColumn("capacity", minimax_capacity(F.col("blocks.bytes"), shards)))
        low = least_capacity(F.col("blocks"), F.lit(largest).cast("long"), F.col("capacity"), shards)
        row = row.withColumn("total", F.coalesce(F.array_max("blocks.end"), F.lit(0))).withColumn("low", low)
        high = F.greatest("capacity", F.lit(1))
        both = []
        for name, side in (("left", F.col("blocks")), ("right", F.reverse("blocks"))):
            row = row.withColumn(name, F.arrays_zip(
                F.slice(F.concat(earliest_ends(side, F.col("low")), F.array_repeat("total", shards)), 1, shards).alias("low"),
                F.slice(latest_ends(side, high, shards), 1, shards).alias("high"),
            ))
            both.append(F.col(name))
        mirrored = F.transform(both[1], lambda r: F.struct((F.col("total") - r["high"]).alias("low"), (F.col("total") - r["low"]).alias("high")))
        row = cut_lineage(row.select("blocks", "capacity", F.concat(both[0], mirrored).alias("ranges")))
        doubts = row.select(F.explode(F.filter("blocks", lambda x: doubtful(x, shift))).alias("x")).select("x.digits")
        found = doubts.count()
        if not found:
            return row.select("blocks", "capacity")
        groups = cut_lineage(groups.join(F.broadcast(doubts), F.shiftright("hash", shift) == F.col("digits"), "left_semi"))
        settled = row.select(F.explode(F.filter("blocks", lambda x: ~doubtful(x, shift))).alias("x"))  # noqa: B023
        shift = max(0, shift - max(1, bits - math.ceil(math.log2(found))))
        blocks = settled.select("x.last", "x.bytes", "x.single", "x.digits", "x.shift").unionAll(cut(groups, shift))


def shard_documents(
    docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, bits: int = BITS
) -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, shard (0 to shards - 1), slot.

    Sizes are UTF-8 bytes of the text plus `overhead`; a null text has no bytes and
    is grouped with the empty text. A group above an equal share has the shard to
    itself; no other shard is larger than the best contiguous cut of the other groups,
    in order of their 64-bit hashes, allows (texts of one hash are one group).
    `slot` counts from 0 without gaps in each shard. Equal rows get different slots;
    a null id sorts first. An empty table gives an empty table; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ident = F.col(id_col)
    rows = cut_lineage(
        docs.select(
            ident.alias("doc_id"),
            (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("hash"),
            F.pmod(F.xxhash64(ident), F.lit(BINS)).cast("int").alias("bin"),
        )
    )
    groups = cut_lineage(rows.groupBy("hash").agg(F.sum("size").alias("bytes")))
    top = groups.orderBy(F.desc("bytes"), "hash").limit(shards).collect()
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    hot = [r["hash"] for r in top[: above_equal_share([r["bytes"] for r in top], total, shards)]]
    alone = F.array_position(F.array(*[F.lit(h) for h in hot]).cast("array<bigint>"), F.col("hash")).cast("int")
    left = shards - len(hot)
    plan = narrowed(groups.where(alone == 0), left, bits)
    plan = plan.withColumn("cuts", cut_ends(F.col("blocks.end"), F.col("capacity"), left))
    within = F.transform("cuts", lambda c: F.filter("blocks", lambda x: x["end"] <= c))
    # the largest hash in each shard or one before it: as many numbers as there are shards
    lasts = plan.select(F.transform(within, lambda x: F.array_max(F.transform(x, lambda y: y["last"]))).alias("lasts")).first()[0]
    bounds = F.array(*[F.lit(h) for h in lasts if h is not None]).cast("array<bigint>")
    shard = F.when(alone > 0, alone - 1).otherwise(F.size(F.filter(bounds, lambda b: b < F.col("hash"))) + len(hot))
    rows = rows.withColumn("shard", shard).withColumn("unit", F.shiftright("hash", 64 - bits)).drop("hash")
    bins = rows.groupBy("shard", "unit", "bin").agg(F.count(F.lit(1)).alias("n"))
    before_unit = W.partitionBy("shard").orderBy("unit").rowsBetween(W.unboundedPreceding, -1)
    units = bins.groupBy("shard", "unit").agg(F.sum("n").alias("n"))
    units = units.select("shard", "unit", F.coalesce(F.sum("n").over(before_unit), F.lit(0)).alias("unit_start"))
    before_bin = W.partitionBy("shard", "unit").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    starts = bins.select("shard", "unit", "bin", F.coalesce(F.sum("n").over(before_bin), F.lit(0)).alias("bin_start"))
    rank = F.row_number().over(W.partitionBy("shard", "unit", "bin").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        rows.join(starts, ["shard", "unit", "bin"])
        .join(F.broadcast(units), ["shard", "unit"])  # at most 2^bits + 2 * shards rows
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "shard",
            (F.col("unit_start") + F.col("bin_start") + rank).cast("long").alias("slot"),
        )
    )
