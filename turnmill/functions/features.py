"""Content features and analyses as columns of a turn (content, speaker and session context)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnmill.functions import constants as C
from turnmill.functions import text as T


def content_flags(c: Column) -> dict[str, Column]:
    """The yes-or-no features of the heuristic policy."""
    names, dates, numbers = T.matches(c, C.NAME_PATTERNS), T.matches(c, C.DATE_PATTERNS), T.matches(c, C.NUMBER_PATTERNS)
    factual_words = T.has_word(c, C.FACTUAL_WORDS)
    return {
        "contains_names": names,
        "contains_dates": dates,
        "contains_numbers": numbers,
        "is_acknowledgment": T.matches(c, C.ACK_PATTERNS) | T.stripped(F.lower(c)).isin(C.DROP_PHRASES),
        "contains_question": T.matches(c, C.QUESTION_PATTERNS),
        "has_factual_keywords": factual_words,
        "is_procedural": T.has_word(c, C.PROCEDURAL_WORDS),
        "contains_factual_info": names | dates | numbers | factual_words,
        "contains_emotional": T.has_word(c, C.EMOTIONAL_WORDS),
        "has_structured_entities": T.has_part(c, C.RELATION_MARKS) | T.matches(F.lower(c), [C.OF_PATTERN]),
        "has_important_keywords": T.has_word(c, C.IMPORTANT_WORDS),
        "has_technical_terms": T.has_word(c, C.TECHNICAL_WORDS),
        "is_generic_response": T.starts_with_any(T.stripped(c), C.GENERIC_PREFIXES),
    }


def priority(flags: dict[str, Column], speaker: Column) -> Column:
    f = flags
    return (
        F.when((speaker == "user") & f["contains_question"], "critical")
        .when(f["contains_names"] | f["contains_dates"], "high")
        .when(f["is_acknowledgment"], "low")
        .when(f["contains_factual_info"] | f["is_procedural"], "high")
        .otherwise("medium")
    )


def content_type(flags: dict[str, Column]) -> Column:
    f = flags
    return (
        F.when(f["contains_factual_info"], "factual")
        .when(f["is_procedural"], "procedural")
        .when(f["contains_question"], "query")
        .when(f["contains_emotional"], "emotional")
        .when(f["is_acknowledgment"], "meta")
        .otherwise("conversational")
    )


def router_features(c: Column, speaker: Column, turn: Column, session_length: Column, since_last: Column) -> dict[str, Column]:
    """The 32 numbers of the three-class router."""
    low, all_words, n = F.lower(c), T.words(c), F.length(c)
    emoji = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in C.ROUTER_EMOJI)
    flag = lambda x: x.cast("double")
    return {
        "char_count": flag(n),
        "word_count": flag(F.size(all_words)),
        "token_count": n / 4.2,
        "sentence_count": flag(T.sentence_count(c)),
        "avg_word_length": T.average_length(all_words),
        "is_very_short": flag(n < 4),
        "is_short": flag(F.size(all_words) < 4),
        "discard_pattern_count": flag(T.occurrences(low, [*C.ROUTER_DISCARD, f"^[{emoji}]+$"])),
        "is_acknowledgment": flag(T.has_part(c, C.ROUTER_ACKS)),
        "is_greeting": flag(T.has_part(c, C.ROUTER_GREETINGS)),
        "has_proper_names": flag(T.matches(c, [r"\b[A-Z][a-z]+\b"])),
        "has_numbers": flag(T.matches(c, [r"\b\d+\b"])),
        "has_dates": flag(T.matches(c, [r"\b\d{1,2}[/-]\d{1,2}\b"])),
        "factual_pattern_count": flag(T.occurrences(c, C.ROUTER_FACTUAL)),
        "has_email": flag(c.contains("@") & c.contains(".")),
        "has_phone": flag(c.rlike(r"\d{3}[-.]?\d{3}[-.]?\d{4}")),
        "has_question_mark": flag(c.contains("?")),
        "question_pattern_count": flag(T.occurrences(low, C.ROUTER_QUESTION)),
        "starts_with_question_word": flag(T.starts_with_any(c, C.QUESTION_WORDS)),
        "is_long": flag(n > 500),
        "is_very_long": flag(n > 1000),
        "paragraph_count": flag(T.paragraph_count(c)),
        "has_multiple_sentences": flag(T.count_char(c, ".") > 2),
        "complexity_ratio": F.size(F.array_distinct(all_words)) / F.greatest(F.lit(1), F.size(all_words)),
        "exclamation_count": flag(T.count_char(c, "!")),
        "comma_count": flag(T.count_char(c, ",")),
        "semicolon_count": flag(T.count_char(c, ";")),
        "punctuation_ratio": T.count_matching(c, r"[^\p{L}\p{N}]") / F.greatest(F.lit(1), n),
        "speaker_is_user": flag(speaker == "user"),
        "turn_number": flag(turn),
        "session_length": flag(session_length),
        "time_since_last": flag(since_last),
    }


def basic_text_features(c: Column) -> dict[str, Column]:
    """The 19 statistics of the five-class trainer."""
    all_words, n = T.words(c), F.size(T.words(c))
    out = {
        "word_count": n,
        "char_count": F.length(c),
        "sentence_count": T.sentence_count(c),
        "avg_word_length": T.average_length(all_words),
        "question_mark_count": T.count_char(c, "?"),
        "exclamation_count": T.count_char(c, "!"),
        "uppercase_ratio": T.count_matching(c, r"\p{Lu}") / F.greatest(F.length(c), F.lit(1)),
        "digit_count": T.count_matching(c, r"\p{Nd}"),
        "punctuation_count": T.count_matching(c, r"[^\p{L}\p{N}\s]"),
        "is_very_short": (n <= 4).cast("int"),
        "is_short": (n <= 10).cast("int"),
        "is_medium": ((n > 10) & (n <= 50)).cast("int"),
        "is_long": (n > 50).cast("int"),
    }
    for word in ("what", "how", "when", "where", "why"):
        out[f"starts_with_{word}"] = F.lower(c).startswith(word).cast("int")
    return out | {"ends_with_question": T.stripped(c).endswith("?").cast("int")}


def context_cues(context: Column, speaker: Column) -> dict[str, Column]:
    return {
        "context_length": F.length(context),
        "context_has_personal": T.has_part(context, C.PERSONAL_CONTEXT).cast("int"),
        "context_has_technical": T.has_part(context, C.TECHNICAL_CONTEXT).cast("int"),
        "context_has_casual": T.has_part(context, C.CASUAL_CONTEXT).cast("int"),
        "context_has_task": T.has_part(context, C.TASK_CONTEXT).cast("int"),
        "is_user": (speaker == "user").cast("int"),
        "is_assistant": (speaker == "assistant").cast("int"),
    }


def policy_context_features(c: Column, speaker: Column, turn_count: Column, stored: Column, minutes: Column, budget: str = "standard", critical: Column | None = None) -> Column:
    """Ten numbers for a learned policy, as one array."""
    critical = F.lit(False) if critical is None else critical
    values = [
        turn_count,
        F.length(c),
        T.word_count(c),
        stored,
        minutes,
        speaker == "user",
        c.contains("?"),
        critical,
        F.lit(budget == "minimal"),
        F.lit(budget == "premium"),
    ]
    return F.array(*[v.cast("double") for v in values])


def training_context_features(c: Column, speaker: Column, turn_count: Column, budget: str = "standard", exhausted: bool = False) -> Column:
    """The training generator's ten numbers, as one array."""
    code = {"minimal": 0.0, "standard": 0.5, "premium": 1.0}.get(budget, 0.5)
    values = [
        turn_count,
        F.length(c),
        T.word_count(c),
        speaker == "assistant",
        turn_count / F.greatest(F.lit(1), turn_count + 1),
        F.lit(code),
        F.lit(exhausted),
        c.contains("?"),
        T.has_part(c, C.PERSONAL_INFO),
        T.word_count(c) < 5,
    ]
    return F.array(*[v.cast("double") for v in values])


def model_input(c: Column, speaker: Column, recent: Column, turn_count: Column, budget: str = "standard", room: int = 512) -> Column:
    """Input text of a learned policy: the last two turns (100 characters each), the state and the turn itself.

    A turn that doesn't fit keeps two thirds from its start and the rest from its end.
    """
    who = lambda s: F.concat(F.lit("["), F.coalesce(s, F.lit("unknown")), F.lit("]: "))
    shown = F.transform(recent, lambda r: F.concat(who(r["speaker"]), F.substring(r["content"], 1, 100)))
    before = F.when(F.size(recent) > 0, F.concat(F.lit("Context: "), F.array_join(shown, " | "), F.lit(" | "))).otherwise(F.lit(""))
    state = F.concat(F.lit("Turn "), turn_count.cast("string"), F.lit(f", Budget: {budget} | Current: "), who(speaker))
    prefix = F.concat(before, state)
    available = F.greatest(F.lit(100), (F.lit(room) - F.length(prefix)) * 4)
    start = F.floor(available * 2 / 3).cast("int")
    end = available - start - 3
    cut = F.concat(F.substring(c, F.lit(1), start), F.lit("..."), F.right(c, end))
    return F.concat(prefix, F.when(F.length(c) > available, cut).otherwise(c))


def training_input(c: Column, speaker: Column, recent: Column, turn_count: Column, budget: str = "standard") -> Column:
    shown = F.transform(recent, lambda r: F.concat(F.lit("["), r["speaker"], F.lit("]: "), F.substring(r["content"], 1, 100)))
    context = F.when(F.size(recent) > 0, F.array_join(shown, " | ")).otherwise(F.lit("Start of conversation"))
    state = F.concat(F.lit("Turn "), turn_count.cast("string"), F.lit(f", Budget: {budget}"))
    return F.concat(F.lit("Context: "), context, F.lit(" | "), state, F.lit(" | Current: ["), speaker, F.lit("]: "), c)


def policy_analysis(c: Column) -> dict[str, Column]:
    structured, question = T.has_part(c, C.STRUCTURED_PARTS), c.contains("?")
    return {
        "content_length": F.length(c),
        "word_count": T.word_count(c),
        "has_question": question,
        "has_structured_data": structured,
        "priority": F.when(structured | question, "high").when(F.length(c) > 500, "medium").otherwise("low"),
    }


def pattern_features(pattern: Column, confidence: Column, entities: Column, flags: Column) -> dict[str, Column]:
    """Eleven features of a labelled sample: its confidence, its conversation's pattern, and what its label says of the content."""
    as_int = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    found = F.coalesce(F.size(entities), F.lit(0))
    return {
        "confidence": confidence,
        **{f"pattern_{name}": as_int(pattern == value) for name, value in C.PATTERNS},
        "detected_entities_count": found,
        "has_detected_entities": (found > 0).cast("int"),
        "content_has_entities": as_int(flags["has_entities"]),
        "content_has_relationships": as_int(flags["has_relationships"]),
        "content_is_question": as_int(flags["is_question"]),
    }
