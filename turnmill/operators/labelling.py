"""Labelling of turns under a budget, its quality, templates, rewrites, and comparison of two evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnmill.functions import constants as C
from turnmill.functions import text as T
from turnmill.operators.prefix import running_total
from turnmill.operators.sessions import hash_order


def within_budget(rows: DataFrame, key: str, cost: str, *, budget: int, call: int) -> DataFrame:
    """Adds `spent` (what rows with smaller keys cost) and `labelled`: whether one more `call` still fits the budget.

    Costs are whole numbers. After the first row that doesn't fit nothing is spent any
    more, so the sum over all rows before decides as well as that over labelled ones.
    """
    spent = running_total(rows, key, F.col(cost), "spent")
    return spent.withColumn("labelled", F.col("spent") + call <= budget)


def quality(rows: DataFrame, classes: list[str], threshold: float = 0.7) -> DataFrame:
    """One row for samples (success, route, confidence): counts of samples, failures, low confidence and classes."""
    good = F.col("success")
    return rows.agg(
        F.count_if(good).alias("total_samples"),
        F.count_if(~good).alias("api_failures"),
        F.count_if(good & (F.col("confidence") < threshold)).alias("low_confidence_count"),
        F.avg(F.when(good, F.col("confidence"))).alias("avg_confidence"),
        *[F.count_if(good & (F.col("route") == c)).alias(c) for c in classes],
    )


def template_class(template: Column) -> Column:
    """Which class a template is a candidate for; the first rule that holds."""
    has = lambda parts: T.any_of(template.contains(p) for p in parts)
    return (
        F.when((T.word_count(template) <= 4) | template.isin(C.TEMPLATE_EXACT), "discard_candidate")
        .when(has([*C.TEMPLATE_FIELDS, "is"]), "keyvalue_candidate")
        .when(template.startswith("What") | template.startswith("How") | template.contains("prefer"), "vector_candidate")
        .when(has(C.TEMPLATE_LINKS), "graph_candidate")
        .when(F.length(template) > 200, "summary_candidate")
        .otherwise("unknown")
    )


def _draw(key: Column, seed: str) -> Column:
    """A number from 0 that looks random: the first hex digits of the md5 of seed and key."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")).cast("binary")), 1, 6), 16, 10).cast("long")


def augmented(rows: DataFrame, text: str, key: str, share: float = 0.5) -> DataFrame:
    """`rows`, and a `share` of them again with one of five small rewrites; `augmented` tells them apart."""
    t = F.col(text)
    swap = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    rewrites = [swap(t, "?", "??"), swap(t, ".", "..."), swap(swap(t, " I ", " i "), "I'm", "i'm"), F.concat(t, F.lit(" (repeated)")), swap(swap(t, "user", "person"), "assistant", "AI")]
    kind = _draw(F.col(key), "5") % len(rewrites)
    rewritten = rewrites[-1]
    for i, r in reversed(list(enumerate(rewrites[:-1]))):
        rewritten = F.when(kind == i, r).otherwise(rewritten)
    more = rows.where(_draw(F.col(key), "9") % 100 < round(100 * share)).withColumn(text, rewritten)
    return rows.withColumn("augmented", F.lit(False)).union(more.withColumn("augmented", F.lit(True)))


def compared(baseline: DataFrame, enhanced: DataFrame) -> DataFrame:
    """Two evaluations (framework, n, cents, accuracy; the enhanced one with discarded) side by side, one row for each framework."""
    b, e = baseline.alias("b"), enhanced.alias("e")
    saved = F.col("b.cents") - F.col("e.cents")
    return b.join(e, F.col("b.framework").eqNullSafe(F.col("e.framework"))).select(
        "b.framework",
        (saved / F.col("b.cents") * 100).alias("cost_reduction"),
        (F.col("e.accuracy") - F.col("b.accuracy")).alias("accuracy_delta"),
        saved.alias("savings"),
        (saved / F.col("b.n")).alias("savings_per_item"),
        (F.col("e.accuracy") >= F.col("b.accuracy") - 0.05).alias("maintained"),
        (F.col("e.discarded") / F.col("e.n")).alias("discard_rate"),
    )


def overall(comparison: DataFrame) -> DataFrame:
    """One row over all frameworks, with the verdict: costs down by more than 15 %, accuracy by at most 0.05."""
    found = comparison.agg(
        F.count(F.lit(1)).alias("frameworks"),
        F.avg("cost_reduction").alias("cost_reduction"),
        F.avg("accuracy_delta").alias("accuracy_delta"),
        F.avg(F.col("maintained").cast("int")).alias("maintained_rate"),
    )
    passed = (F.col("cost_reduction") > 15) & (F.col("accuracy_delta") >= -0.05)
    return found.withColumn("status", F.when(passed, "PASSED").otherwise("NEEDS_IMPROVEMENT"))


def collected(rows: DataFrame, key: str, label: str, first: int, least: int, draws: int = 3, growth: float = 1.5) -> DataFrame:
    """Rows drawn again and again until each class has `least`: key, label, draw.

    Draws follow one order by hash, each `growth` times the one before (rounded down), the first of `first` rows; so what
    later draws add is known without reading again, and only the rows of all draws together are ever ordered. The classes
    are those that occur in them. After `draws` draws the collection ends whatever it has.
    """
    sizes = [first]
    while len(sizes) < draws:
        sizes.append(int(sizes[-1] * growth))
    taken = rows.select(key, label, hash_order(F.col(key), "draw").alias("_h")).orderBy("_h", key).limit(sum(sizes))
    taken = taken.withColumn("_n", F.row_number().over(W.orderBy("_h", key)))  # of the draws' size
    draw = F.lit(draws)
    for k in range(draws - 1, 0, -1):
        draw = F.when(F.col("_n") <= sum(sizes[:k]), k).otherwise(draw)
    taken = taken.withColumn("draw", draw)
    place = F.row_number().over(W.partitionBy(label).orderBy("_n"))
    by_class = taken.withColumn("_k", place).groupBy(label).agg(F.coalesce(F.min(F.when(F.col("_k") == least, F.col("draw"))), F.lit(draws)).alias("enough"))
    needed = by_class.agg(F.max("enough").alias("needed"))
    return taken.join(F.broadcast(needed)).where("draw <= needed").select(key, label, F.col("draw").cast("int").alias("draw"))
