"""Per-session order and state: context windows, budgets, bounded stores, splits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnmill.functions import constants as C
from turnmill.operators.prefix import group_ranks


def with_recent_turns(turns: DataFrame, n: int) -> DataFrame:
    """Adds turn_count and recent (the last `n` turns before this one, as an array)."""
    order = W.partitionBy("session_id").orderBy("turn_no", "item_id")
    recent = F.collect_list(F.struct("speaker", "content")).over(order.rowsBetween(-n, -1))
    return turns.withColumn("turn_count", F.row_number().over(order) - 1).withColumn("recent", recent)


def budget_ledger(
    turns: DataFrame,
    cost: Column,
    *,
    operation: float = C.OPERATION_LIMIT,
    session: float = C.SESSION_LIMIT,
    burst: float = C.BURST_LIMIT,
    hours: float = C.LEAST_HOURS,
) -> DataFrame:
    """(session_id, turn_no, cost, accepted, spent): each turn against what its session spent before.

    A rejected turn costs nothing, so this is a recurrence, not a running sum. Sessions
    are sorted within a partition and read as a stream: one number is held per session,
    however long it is. A null cost is rejected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, spent, started = None, 0.0, False
        for batch in batches:
            accepted, totals = [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not started or key != current:
                    current, spent, started = key, 0.0, True
                fits = value is not None and value <= operation and spent + value <= session and (spent + value) / hours <= burst
                spent += value if fits else 0.0
                accepted.append(fits)
                totals.append(spent)
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(accepted, pa.bool_()), pa.array(totals, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["session_id", "turn_no", "cost", "accepted", "spent"])

    kind = {c: turns.schema[c].dataType.simpleString() for c in ("session_id", "turn_no")}
    rows = turns.select("session_id", "turn_no", cost.cast("double").alias("cost"))
    ordered = rows.repartition("session_id").sortWithinPartitions("session_id", "turn_no")
    return ordered.mapInArrow(
        run, f"session_id {kind['session_id']}, turn_no {kind['turn_no']}, cost double, accepted boolean, spent double"
    )


def lru_trace(events: DataFrame, capacity: int, passes: str = "passes") -> DataFrame:
    """(session_id, item_id): what each session's store holds at the end of its trace, in no order.

    `events` has session_id, seq, op and item_id. A `store` adds the item after evicting the
    least recently used one at capacity; a `retrieve` touches all held items for which the
    SQL condition `passes` on item_id and the event's own columns holds, given as the array
    column of that name (item ids that pass), in the order in which they came. Traces are
    read as a stream: a session's state is its items, at most `capacity`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, started = None, False
        held: dict = {}  # in the order of use; the value is the order of arrival
        arrived = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([current] * len(held), session_type), pa.array(list(held), item_type)], ["session_id", "item_id"]
            )

        for batch in batches:
            session_type, item_type = batch.schema.field(0).type, batch.schema.field(2).type
            for key, op, item, passing in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
                if not started or key != current:
                    if started and held:
                        yield out()
                    current, started, held, arrived = key, True, {}, 0
                if op == "store":
                    if len(held) >= capacity:
                        held.pop(next(iter(held)))
                    held[item] = arrived
                    arrived += 1
                else:
                    wanted = set(passing or ())
                    for x in sorted((x for x in held if x in wanted), key=held.get):
                        held[x] = held.pop(x)
        if started and held:
            yield out()

    kind = {c: events.schema[c].dataType.simpleString() for c in ("session_id", "item_id")}
    ordered = events.repartition("session_id").sortWithinPartitions("session_id", "seq")
    return ordered.select("session_id", "op", "item_id", passes).mapInArrow(run, f"session_id {kind['session_id']}, item_id {kind['item_id']}")


def last_items(items: DataFrame, capacity: int, by: str, order: list[str]) -> DataFrame:
    """What a store of that capacity still holds after taking all items in order, per key."""
    w = W.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return items.withColumn("_age", F.row_number().over(w)).where(F.col("_age") <= capacity).drop("_age")


def hash_order(key: Column, seed: str) -> Column:
    """A fixed order that looks random: the md5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")).cast("binary"))


def stratified_split(rows: DataFrame, label: str, key: str, seed: str = "42", validation: float = 0.2, test: float = 0.2) -> DataFrame:
    """Adds `split` (train, validation, test): fixed shares of each label."""
    ranked = group_ranks(rows, label, hash_order(F.col(key), seed), key, "_r", "_n")
    at = (F.col("_r") - 1) / F.col("_n")
    return ranked.withColumn("split", F.when(at < test, "test").when(at < test + validation, "validation").otherwise("train")).drop("_r", "_n")


def shadow_split(rows: DataFrame, stratum: str, key: str, share: float = 0.25, seed: str = "7") -> DataFrame:
    """Adds `shadow`: a share of each stratum, at least one row."""
    ranked = group_ranks(rows, stratum, hash_order(F.col(key), seed), key, "_r", "_n")
    return ranked.withColumn("shadow", F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))).drop("_r", "_n")


def stratified_folds(rows: DataFrame, label: str, key: str, k: int = 5, seed: str = "42") -> DataFrame:
    """Adds `fold` 0 to k - 1, even within each label."""
    ranked = group_ranks(rows, label, hash_order(F.col(key), seed), key, "_r", "_n")
    return ranked.withColumn("fold", F.pmod(F.col("_r") - 1, F.lit(k))).drop("_r", "_n")


def capped_classes(rows: DataFrame, label: str, key: str, seed: str = "42") -> DataFrame:
    """At most 2 * max(20, n // (3 * classes)) rows of each class: balances a training set."""
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("classes")).first()
    cap = 2 * max(20, totals["n"] // max(1, 3 * totals["classes"]))
    ranked = group_ranks(rows, label, hash_order(F.col(key), seed), key, "_r", "_n")
    return ranked.where(F.col("_r") <= cap).drop("_r", "_n")


def standardized(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each column less its mean, by its population deviation (1 where that is 0)."""
    stats = rows.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    scaled = {c: (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in columns}
    return rows.withColumns(scaled)
