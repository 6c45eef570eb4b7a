"""Summaries and chunks by array functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnmill.functions import text as T


def chunks(items: Column, size: int, overlap: int) -> Column:
    """Runs of `size` items, each starting size - overlap after the last."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.size(items) > 0, F.transform(starts, lambda s: F.slice(items, s + 1, size))).otherwise(
        F.array().cast("array<array<string>>")
    )


def extractive(text: Column, least_tokens: int = 1200, ratio: float = 0.3) -> Column:
    """First, evenly spaced middle, and last sentences; a text of at most `least_tokens` stays as it is."""
    return _once(F.split(text, r"\.", -1), lambda parts: _shortened(text, parts, least_tokens, ratio))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with `value` worked out once for a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shortened(text: Column, parts: Column, least_tokens: int, ratio: float) -> Column:
    n = F.size(parts)
    target = F.greatest(F.lit(1), F.floor(n * ratio).cast("int"))
    step = F.greatest(F.lit(1), F.floor((n - 2) / F.greatest(target - 2, F.lit(1))).cast("int"))
    middle = F.when((target > 2) & (n > 2), F.slice(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)), step), 1, F.greatest(target - 2, F.lit(0)))).otherwise(
        F.array().cast("array<int>")
    )
    last = F.when(target > 1, F.array(n - 1)).otherwise(F.array().cast("array<int>"))
    chosen = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), middle, last)))
    joined = F.array_join(F.transform(chosen, lambda i: T.stripped(F.get(parts, i))), ". ")
    summary = _once(joined, lambda x: F.when(x.endswith("."), x).otherwise(F.concat(x, F.lit("."))))
    return F.when(T.token_estimate(text) > least_tokens, summary).otherwise(text)


def first_third(text: Column) -> Column:
    """The first third of the lines, at least one."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.slice(lines, 1, F.greatest(F.lit(1), F.floor(F.size(lines) / 3).cast("int"))), "\n")
