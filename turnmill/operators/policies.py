"""Routing policies as first-match rules over columns, and a registry of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from turnmill.functions import constants as C
from turnmill.functions import text as T
from turnmill.functions.features import content_flags, content_type, priority

CLASS_IDS = {"discard": 0, "store": 1, "compress": 2}
#: The five classes of learned routing, by number.
CLASS_NAMES = ["Discard", "Key-Value", "Vector", "Graph", "Summary"]


def three_class(c: Column) -> Column:
    n, words = F.length(c), T.word_count(c)
    small = (n < 10) | (words < 3) | T.stripped(F.lower(c)).isin(C.CHITCHAT_EXACT)
    return F.when(small, "discard").when((n > 500) | (words > 80), "compress").otherwise("store")


def heuristic_action(c: Column, speaker: Column, critical: Column | None = None) -> Column:
    """The heuristic policy's action; `critical` tells whether the budget is nearly spent."""
    critical = F.lit(False) if critical is None else critical
    s = T.stripped(c)
    f = content_flags(s)
    keep = (speaker == "user") | f["contains_factual_info"] | f["is_procedural"]
    return (
        F.when(F.length(s) < 5, "drop")
        .when(f["is_acknowledgment"], "drop")
        .when((speaker == "user") & f["contains_question"], "store")
        .when(f["contains_factual_info"], "store")
        .when(T.word_count(s) > 125, "summarize")
        .when(critical & ~keep, "drop")
        .otherwise("store")
    )


def by_capability(*wanted: str) -> str | None:
    """The first backend that has all of `wanted`."""
    return next((name for name, has in C.BACKENDS if set(wanted) <= set(has)), None)


def choose_backend(c: Column, speaker: Column, turn_count: Column, minutes: Column, budget: str = "standard", critical: Column | None = None) -> Column:
    """The heuristic policy's backend. No backend is both semantic and searchable, so that rule never decides."""
    critical = F.lit(False) if critical is None else critical
    f = content_flags(c)
    rank, kind = priority(f, speaker), content_type(f)
    vector = by_capability("vector", "semantic")
    rules = [
        (critical, by_capability("cheap")),
        (rank == "critical", vector),
        (turn_count <= 10, by_capability("fast")),
        ((kind == "factual") | f["contains_factual_info"], vector),
        ((speaker == "user") & f["contains_question"], by_capability("semantic", "searchable")),
        (kind == "procedural", vector),
        ((minutes > 30) & rank.isin("low", "medium"), by_capability("persistent", "cheap")),
        (F.lit(budget == "premium"), vector),
        (F.lit(budget == "minimal"), by_capability("cheap")),
        (T.word_count(c) < 50, "memory_store"),
    ]
    found = F.lit("faiss_store")
    for condition, name in reversed(rules):
        if name is not None:
            found = F.when(condition, name).otherwise(found)
    return found


def router_fallback(features: dict[str, Column]) -> tuple[Column, Column]:
    """Class and confidence that the router falls back to."""
    f = {k: v > 0 for k, v in features.items()}
    discard = f["is_very_short"] | f["is_acknowledgment"] | f["is_greeting"]
    compress = f["is_very_long"] | f["has_multiple_sentences"]
    name = F.when(discard, "discard").when(compress, "compress").otherwise("store")
    return name, F.when(discard, 0.9).when(compress, 0.8).otherwise(0.7)


def action_of(name: Column) -> Column:
    return F.when(name == "discard", "drop").when(name == "compress", "summarize").otherwise("store")


def class_of(action: Column) -> Column:
    """Actions as classes; what is put off is stored."""
    return F.when(action == "drop", "discard").when(action == "summarize", "compress").otherwise("store")


def gated(name: Column, confidence: Column, fallback: Column, least: float = 0.75) -> Column:
    """The model's action if it is sure enough, else another policy's."""
    return F.when(confidence >= least, action_of(name)).otherwise(fallback)


def simple_action(c: Column) -> Column:
    n, words = F.length(c), T.word_count(c)
    chat = T.has_part(c, C.CHITCHAT_PARTS)
    return F.when((n < 10) | (words < 3) | chat, "drop").when((n > 500) | (words > 80), "summarize").otherwise("store")


def preferred_backend(c: Column) -> Column:
    """The three-class policy's backend: facts to vectors, short to memory, long to files."""
    special = T.has_part(c, C.PLACEMENT_PARTS) | c.contains("?")
    return F.when(special, "faiss_store").when(F.length(c) < 200, "memory_store").when(F.length(c) > 1000, "file_store").otherwise("memory_store")


def five_class(c: Column) -> tuple[Column, Column]:
    """Class 0 to 4 (discard, key-value, vector, graph, summary) and confidence, by the labeller's rules."""
    low, n = F.lower(c), T.word_count(c)
    rules = [
        ((n <= 4) | low.isin(C.SOCIAL_EXACT), 0, 0.9),
        (T.has_part(c, C.KEY_VALUE_PARTS) & (n < 25), 1, 0.85),
        (low.startswith("what") | low.startswith("how") | low.contains("prefer"), 2, 0.8),
        ((T.has_part(c, C.RELATION_PARTS) | (n > 30)) & low.contains(" and ") & (n < 100), 3, 0.75),
        (T.has_part(c, C.RELATION_PARTS) | (n > 30), 4, 0.8),
    ]
    name, sure = F.lit(2), F.lit(0.6)
    for condition, number, confidence in reversed(rules):
        name, sure = F.when(condition, number).otherwise(name), F.when(condition, confidence).otherwise(sure)
    return name, sure


def route_cost(name: Column, base_ms: int = 5) -> tuple[Column, Column]:
    """Cents and milliseconds of handling an item of that class."""
    cents = F.when(name == "discard", 1).when(name == "store", 8).when(name == "compress", 15).otherwise(10)
    ms = F.when(name == "discard", 2).when(name == "store", 25).when(name == "compress", 45).otherwise(30)
    return cents, ms + base_ms


def top_features(values: dict[str, Column], importances: dict[str, float], n: int = 5) -> Column:
    """The `n` features with the largest importance times size, as an array of (name, weight)."""
    items = [F.struct((-F.abs(v) * importances[k]).alias("minus"), F.lit(k).alias("name")) for k, v in values.items() if k in importances]
    best = F.slice(F.array_sort(F.array(*items)), 1, n)
    return F.transform(best, lambda x: F.struct(x["name"].alias("name"), (-x["minus"]).alias("weight")))


#: Policies by name: functions of content and speaker. Others can be added.
POLICIES: dict[str, Callable[[Column, Column], Column]] = {
    "heuristic": heuristic_action,
    "simple": lambda c, s: simple_action(c),
    "three_class": lambda c, s: action_of(three_class(c)),
    "store_all": lambda c, s: F.lit("store"),
}


def register(name: str, policy: Callable[[Column, Column], Column]) -> None:
    POLICIES[name] = policy


def policy(name: str | None = None) -> Callable[[Column, Column], Column]:
    """A policy by name; the first one without. An unknown name raises KeyError."""
    return POLICIES[name] if name else next(iter(POLICIES.values()))


def with_session_context(turns: DataFrame) -> DataFrame:
    """Adds turn_count (turns of the session so far) and minutes (since its first turn)."""
    order = W.partitionBy("session_id").orderBy("turn_no", "item_id")
    start = F.min("ts").over(W.partitionBy("session_id"))
    minutes = (F.unix_timestamp("ts") - F.unix_timestamp(start)) / 60.0
    return turns.withColumn("turn_count", F.row_number().over(order) - 1).withColumn("minutes", minutes)


def routed(turns: DataFrame, budget: str = "standard") -> DataFrame:
    """Action, backend, price and budget outcome for each turn (session_id, turn_no, speaker, content, item_id, ts).

    A stored or summarized turn is placed and priced; if its price exceeds the limit
    for one operation it is dropped, but the price stays visible. Turns that have
    turn_count and minutes already, as a stream's do, keep these.
    """
    c, s = F.col("content"), F.col("speaker")
    placed = turns if {"turn_count", "minutes"} <= set(turns.columns) else with_session_context(turns)
    out = placed.withColumn("wanted", heuristic_action(c, s))
    flags = content_flags(c)
    placed = out.withColumn(
        "placed", F.when(F.col("wanted") != "drop", choose_backend(c, s, F.col("turn_count"), F.col("minutes"), budget))
    )
    cents = F.greatest(F.lit(0), F.bround(C.WRITE + T.token_estimate(c) * C.PER_TOKEN + C.INDEX / 30.0).cast("int"))
    priced = placed.withColumn("predicted_cents", F.when(F.col("wanted") == "store", cents))
    over = F.coalesce(F.col("predicted_cents") > C.OPERATION_LIMIT, F.lit(False))
    return priced.select(
        "session_id",
        "turn_no",
        "item_id",
        priority(flags, s).alias("priority"),
        content_type(flags).alias("content_type"),
        F.when(over, "drop").otherwise(F.col("wanted")).alias("action"),
        F.when(~over, F.col("placed")).alias("backend"),
        "predicted_cents",
        (F.lit(C.P50_MS) + (C.P95_MS - C.P50_MS) * 0.25).alias("predicted_ms"),
        "turn_count",
    )


def with_default(predicted: Column, confidence: Column) -> tuple[Column, Column]:
    """A model's class and confidence, or the vector class with 0.5 where it gives none."""
    return F.coalesce(predicted, F.lit(CLASS_NAMES.index("Vector"))), F.when(predicted.isNull(), 0.5).otherwise(confidence)


def alternatives(class_id: Column) -> Column:
    """The first three other classes (class, name, probability); no model tells their probability, so it is 0.1."""
    every = F.array(*[F.struct(F.lit(i).alias("class"), F.lit(n).alias("name"), F.lit(0.1).alias("probability")) for i, n in enumerate(CLASS_NAMES)])
    return F.slice(F.filter(every, lambda x: x["class"] != class_id), 1, 3)
