"""Text primitives as columns. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnmill.functions.constants import PRESSURE_LIMITS, SIZE_LIMITS


def any_of(conditions: Iterable[Column]) -> Column:
    found = F.lit(False)
    for c in conditions:
        found = found | c
    return found


def unicode(pattern: str) -> str:
    r"""The pattern with \w, \d, \s and \b that know all scripts."""
    return "(?U)" + pattern


def matches(text: Column, patterns: Iterable[str]) -> Column:
    return any_of(text.rlike(unicode(p)) for p in patterns)


def occurrences(text: Column, patterns: Iterable[str]) -> Column:
    total = F.lit(0)
    for p in patterns:
        total = total + F.regexp_count(text, F.lit(unicode(p)))
    return total


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z0-9]+"), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def words(text: Column) -> Column:
    """What white space separates."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentence_count(text: Column) -> Column:
    """Parts between full stops that aren't blank."""
    return F.size(F.filter(F.split(text, r"\.", -1), lambda s: s.rlike(r"\S")))


def paragraph_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n", -1), lambda s: s.rlike(r"\S")))


def average_length(items: Column) -> Column:
    total = F.aggregate(items, F.lit(0), lambda a, w: a + F.length(w))
    return F.when(F.size(items) > 0, total / F.size(items)).otherwise(F.lit(0.0))


def token_estimate(text: Column) -> Column:
    """Characters by 4.2, rounded half to even, at least 1; an empty text has none."""
    return token_estimate_of_length(F.length(text))


def token_estimate_of_length(n: Column) -> Column:
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(n / 4.2).cast("int")))


def rough_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def has_word(text: Column, vocabulary: list[str]) -> Column:
    """Whole words as white space separates them: punctuation stays attached."""
    return F.arrays_overlap(words(F.lower(text)), F.array(*map(F.lit, vocabulary)))


def has_part(text: Column, parts: list[str]) -> Column:
    """Anywhere in the lower-case text, also inside words."""
    low = F.lower(text)
    return any_of(low.contains(p) for p in parts)


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    low = F.lower(text)
    return any_of(low.startswith(p) for p in prefixes)


def preview(text: Column, length: int = 100) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def count_matching(text: Column, pattern: str) -> Column:
    """How many characters the one-character `pattern` matches."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _bucket(value: Column, limits: list[tuple[int, str]], beyond: str) -> Column:
    found = F.lit(beyond)
    for limit, name in reversed(limits):
        found = F.when(value < limit, name).otherwise(found)
    return found


def size_class(n_tokens: Column) -> Column:
    return _bucket(n_tokens, SIZE_LIMITS, "xlarge")


def pressure_class(n_items: Column) -> Column:
    return _bucket(n_items, PRESSURE_LIMITS, "critical")


def entities(text: Column) -> Column:
    """The first five capitalised words of more than two ASCII letters."""
    return F.slice(F.filter(words(text), lambda x: x.rlike("^[A-Z][A-Za-z]{2,}$")), 1, 5)


def pricebook_key(backend: Column, op: Column, model: Column | None = None) -> Column:
    parts = [backend, op] if model is None else [backend, op, F.when(model.isNotNull(), F.concat(F.lit("model="), model))]
    return F.concat_ws("|", *parts)


def date_path(ts: Column) -> Column:
    return F.date_format(ts, "y/MM/dd")


def recency_bonus(days_back: Column) -> Column:
    return 1.0 / (days_back + 1) * 0.1
