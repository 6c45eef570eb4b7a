"""Predicates: metadata, validity, budgets and capabilities."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnmill.functions import constants as C


def metadata_strict(speaker: Column, metadata: Column, wanted: dict[str, str | None]) -> Column:
    """All of `wanted` must be there and equal; a missing key rejects."""
    found = F.lit(True)
    for key, value in wanted.items():
        if key == "speaker":
            found = found & speaker.eqNullSafe(F.lit(value))
        else:
            has = F.coalesce(F.map_contains_key(metadata, key), F.lit(False))
            found = found & has & F.coalesce(metadata[key].eqNullSafe(F.lit(value)), F.lit(False))
    return found


def metadata_lenient(speaker: Column, metadata: Column, wanted: dict[str, str | None]) -> Column:
    """As strict, but a missing key passes."""
    found = F.lit(True)
    for key, value in wanted.items():
        if key == "speaker":
            found = found & speaker.eqNullSafe(F.lit(value))
        else:
            has = F.coalesce(F.map_contains_key(metadata, key), F.lit(False))
            found = found & (~has | metadata[key].eqNullSafe(F.lit(value)))
    return found


def valid_example(text: Column, label: Column, features: Column) -> Column:
    """Training rows: 2 to 2000 characters that aren't blank, label 0 to 3, ten finite features up to 10000."""
    fine = F.forall(features, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 10000))
    return F.coalesce(
        F.length(text).between(2, 2000) & text.rlike(r"\S") & label.between(0, 3) & (F.size(features) == 10) & fine, F.lit(False)
    )


def valid_request(content: Column, speaker: Column, session: Column) -> Column:
    """Requests: 1 to 10000 characters, a user or assistant, a session name of at most 100 letters, digits, - and _."""
    return F.coalesce(
        F.length(content).between(1, 10000) & speaker.rlike("^(user|assistant)$") & session.rlike("^[A-Za-z0-9_-]{1,100}$"), F.lit(False)
    )


def within_budget(cost: Column, spent: Column, hours: Column) -> Column:
    """Limits of one operation, of the session, and of the hour (at least 0.1 hours count)."""
    rate = (spent + cost) / F.greatest(hours, F.lit(C.LEAST_HOURS))
    return (cost <= C.OPERATION_LIMIT) & (spent + cost <= C.SESSION_LIMIT) & (rate <= C.BURST_LIMIT)


def budget_critical(budget: Column, spent: Column) -> Column:
    """Most of the budget is spent; an unlimited or unknown one never is."""
    found = F.lit(False)
    for name, _, above in C.BUDGETS:
        if above is not None:
            found = F.when(budget == name, spent > above).otherwise(found)
    return F.coalesce(found, F.lit(False))


def has_capabilities(capabilities: Column, wanted: Iterable[str]) -> Column:
    """Whether the array has all of `wanted`; null has none."""
    names = F.array(*map(F.lit, wanted)).cast("array<string>")
    return F.coalesce(F.size(F.array_except(names, capabilities)) == 0, F.lit(False))
