"""Queries by name, with the SQL that gives the same rows, and pieces of that SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnmill.functions import constants as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- pieces of SQL ------------------------------------------------------------------------------------------------

TURNS = (
    "t AS (SELECT conv_id AS session_id, turn AS turn_no, role AS speaker, text AS content, conv_id * 1000 + turn AS item_id,"
    " row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_count FROM conversations)"
)
DOCS = "d AS (SELECT doc_id, text AS content, source, lang FROM documents)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def names(items: list[str]) -> str:
    return "[" + ", ".join(map(q, items)) + "]"


def words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> '')"


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-zA-Z0-9]+')"


def stripped(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def has_word(c: str, vocabulary: list[str]) -> str:
    return f"list_has_any({words(f'lower({c})')}, {names(vocabulary)})"


def has_part(c: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), {q(p)})" for p in parts) + ")"


def starts(c: str, prefixes: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with(lower({c}), {q(p)})" for p in prefixes) + ")"


def wide(pattern: str) -> str:
    """A pattern whose word boundaries know letters of all scripts, for tests only: it takes in a neighbour."""
    inner = pattern.removeprefix("(?i)")
    if inner.startswith(r"\b"):
        inner = r"(?:^|[^\pL\pN_])" + inner[2:]
    if inner.endswith(r"\b"):
        inner = inner[:-2] + r"(?:[^\pL\pN_]|$)"
    return ("(?i)" if pattern.startswith("(?i)") else "") + inner.replace(r"\w", r"[\pL\pN_]")


def matches(c: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {q(wide(p))})" for p in patterns) + ")"


def plain(c: str) -> str:
    """Accented letters as underscores: word characters under any definition, and never a-z."""
    return f"regexp_replace({c}, '[À-ÖØ-öø-ɏ]', '_', 'g')"


def occurrences(c: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({c}, {q(p)}))" for p in patterns) + ")"


def count_char(c: str, char: str) -> str:
    return f"(length({c}) - length(replace({c}, {q(char)}, '')))"


def count_matching(c: str, pattern: str) -> str:
    return f"(length({c}) - length(regexp_replace({c}, {q(pattern)}, '', 'g')))"


def sentences(c: str) -> str:
    return rf"len(list_filter(string_split({c}, '.'), lambda s: regexp_matches(s, '\S')))"


def token_estimate(c: str) -> str:
    return f"CASE WHEN length({c}) = 0 THEN 0 ELSE greatest(1, round_even(length({c}) / 4.2::DOUBLE, 0)::INT) END"


def average_length(items: str) -> str:
    return f"CASE WHEN len({items}) > 0 THEN list_sum(list_transform({items}, lambda w: length(w)))::DOUBLE / len({items}) ELSE 0.0 END"


def size_class(n: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} < {limit} THEN '{name}'" for limit, name in C.SIZE_LIMITS) + " ELSE 'xlarge' END"


def flags(c: str) -> dict[str, str]:
    name, date, number, factual = matches(c, C.NAME_PATTERNS), matches(c, C.DATE_PATTERNS), matches(c, C.NUMBER_PATTERNS), has_word(c, C.FACTUAL_WORDS)
    return {
        "contains_names": name,
        "contains_dates": date,
        "contains_numbers": number,
        "is_acknowledgment": f"({matches(c, C.ACK_PATTERNS)} OR {stripped(f'lower({c})')} IN ({', '.join(map(q, C.DROP_PHRASES))}))",
        "contains_question": matches(c, C.QUESTION_PATTERNS),
        "has_factual_keywords": factual,
        "is_procedural": has_word(c, C.PROCEDURAL_WORDS),
        "contains_factual_info": f"({name} OR {date} OR {number} OR {factual})",
        "contains_emotional": has_word(c, C.EMOTIONAL_WORDS),
        "has_structured_entities": f"({has_part(c, C.RELATION_MARKS)} OR {matches(f'lower({c})', [C.OF_PATTERN])})",
        "has_important_keywords": has_word(c, C.IMPORTANT_WORDS),
        "has_technical_terms": has_word(c, C.TECHNICAL_WORDS),
        "is_generic_response": starts(stripped(c), C.GENERIC_PREFIXES),
    }


def columns(items: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in items.items())


PRIORITY = (
    "CASE WHEN speaker = 'user' AND contains_question THEN 'critical' WHEN contains_names OR contains_dates THEN 'high'"
    " WHEN is_acknowledgment THEN 'low' WHEN contains_factual_info OR is_procedural THEN 'high' ELSE 'medium' END"
)
CONTENT_TYPE = (
    "CASE WHEN contains_factual_info THEN 'factual' WHEN is_procedural THEN 'procedural' WHEN contains_question THEN 'query'"
    " WHEN contains_emotional THEN 'emotional' WHEN is_acknowledgment THEN 'meta' ELSE 'conversational' END"
)


def three_class(c: str) -> str:
    chat = ", ".join(map(q, C.CHITCHAT_EXACT))
    return (
        f"CASE WHEN length({c}) < 10 OR len({words(c)}) < 3 OR {stripped(f'lower({c})')} IN ({chat}) THEN 'discard'"
        f" WHEN length({c}) > 500 OR len({words(c)}) > 80 THEN 'compress' ELSE 'store' END"
    )


#: The heuristic action, over columns named as in `flags` of the stripped content.
HEURISTIC = (
    "CASE WHEN length(s) < 5 THEN 'drop' WHEN is_acknowledgment THEN 'drop' WHEN speaker = 'user' AND contains_question THEN 'store'"
    f" WHEN contains_factual_info THEN 'store' WHEN len({words('s')}) > 125 THEN 'summarize' ELSE 'store' END"
)
BACKEND = (
    "CASE WHEN priority = 'critical' THEN 'faiss_store' WHEN turn_count <= 10 THEN 'memory_store'"
    " WHEN contains_factual_info THEN 'faiss_store' WHEN content_type = 'procedural' THEN 'faiss_store'"
    " WHEN turn_count > 30 AND priority IN ('low', 'medium') THEN 'file_store'"
    f" WHEN len({words('content')}) < 50 THEN 'memory_store' ELSE 'faiss_store' END"
)
