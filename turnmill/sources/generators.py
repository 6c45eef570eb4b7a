"""Deterministic test data from the ids of a table: golden items in four strata, turns, conversations and scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words that the items are made of.
NAMES = ["Alice", "Bob", "Carol", "Diego", "Erin"]
TOPICS = ["pricing", "returns", "roadmap", "outage", "migration"]
PEOPLE = ["Maya Patel", "Jun Park", "Liam Chen", "Nora Iqbal", "Omar Aziz"]
COMPANIES = ["Acme", "Globex", "Initech", "Soylent", "Umbrella"]
ROLES = ["PM", "Engineer", "Designer", "Analyst", "Support"]
POLITE = ["thanks", "ok", "alright", "cool", "got it"]
ACTIONABLE = [
    "Book a dentist appointment for tomorrow at 2pm.",
    "Remind me to pay rent on the 1st.",
    "My email is user@example.com — store it.",
    "The router serial number is SN-8842.",
    "Flight DL210 departs at 8:10am from SFO.",
]
# Texts of the routing simulation, in turn, with their places filled.
EVALUATION_TEXTS = [
    "thanks",
    "ok",
    "got it",
    "yes",
    "no",
    "hi",
    "hello",
    "My meeting is scheduled for Tuesday at item0pm",
    "I work at item0 as a item1",
    "My email is item0@company.com",
    "The project deadline is item0",
    "I need to remember to call item0 about item1",
    "I had a really interesting discussion about item0 today. We covered many topics including item1, item2, and item3. The conversation lasted over an hour and we made significant progress on understanding the challenges and opportunities in this space. I think the key insights were around item4 and how we can leverage item5 to improve our approach.",
]
# Sentences of the golden items.
ORDER, ORDER_QUERY = "Order %d for %s is ready for pickup at 5pm on 04/2%d/2025.", "What's the pickup time for order %d?"
CREDIT = " policy clarifies edge-cases. Customers with annual plans receive pro-rated credit if they downgrade within 30 days; otherwise credits apply on the next billing cycle. This note supersedes prior guidance."
UPDATED, SUMMARIZE, ABOUT = "Our updated ", "Can you summarize the new ", " policy about billing credits?"
JOINED, WHICH = "%s joined %s as a %s on 2025-03-%d.", "Which company did %s join?"
SCHEDULE, ANYTHING = "What actionable item should I schedule?", "Is there anything to store here?"

# Texts of generated data; {n} stands for a number.
TURN_PATTERNS = [
    ("personal_assistant", ["My locker code is {n}, please keep it.", "What did I plan for day {n}?", "Thanks, that helps."]),
    ("technical_discussion", ["The service reads from queue {n} and writes to a table.", "How do I rotate key {n}?", "ok"]),
    ("casual_chat", ["Nice weather on day {n}!", "Did you see match {n}?", "Sure."]),
    ("task_planning", ["Task {n} is due on Friday and needs two reviews.", "Who takes task {n}?", "Got it."]),
    ("knowledge_query", ["What is theorem {n} about?", "Chapter {n} explains how tides follow the moon.", "I see."]),
]
CLASS_TEXTS = [
    ["ok", "thanks", "bye"],
    ["My account number is {n}.", "The meeting {n} starts at noon on Tuesday.", "Ana moved to flat {n} last week."],
    ["Long report {n}: first we listed all open points, then we went through each of them, and in the end we agreed on what comes next."] * 3,
]
CONVERSATIONS = [
    ("booking", ["I need a table for {n} people.", "For which evening?", "Friday at eight.", "Booked for Friday at eight."]),
    ("support", ["My printer shows error {n}.", "Is it plugged in?", "Yes, since this morning.", "Then hold the reset key for ten seconds."]),
    ("travel", ["Which train goes to platform {n}?", "The one at noon.", "Does it stop on the way?", "Once, for five minutes."]),
    ("cooking", ["How long does recipe {n} take?", "About an hour.", "Can I halve it?", "Yes, with a smaller pan."]),
    ("health", ["I walked {n} kilometres today.", "Well done.", "My target is twelve.", "I keep that in mind."]),
    ("greeting", ["hello", "hi", "thanks", "bye"]),
]
SCENARIOS = [("calm", "Note {n}: nothing new."), ("busy", "Please move appointment {n} to Monday."), ("silent", "ok"), ("lost", "Where did I leave key {n}?")]
SAMPLE_TURNS = [
    ("user", "Hello, I am planning a trip to the coast."),
    ("assistant", "When would you like to leave?"),
    ("user", "On the third of May, with two friends."),
    ("assistant", "I noted the third of May for three people."),
    ("user", "thanks"),
]


def _pick(values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col("id") % len(values) + 1).cast("int"))


def golden(ids: DataFrame) -> DataFrame:
    """An item of each stratum for each `id`: id, stratum, content, query, meta."""
    i, text = F.col("id"), F.col("id").cast("string")
    even = i % 2 == 0
    strata = [
        (
            "F",
            "factual_lookup",
            F.format_string(ORDER, 4000 + i, _pick(NAMES), i % 10),
            F.format_string(ORDER_QUERY, 4000 + i),
            F.create_map(F.lit("order"), (4000 + i).cast("string"), F.lit("name"), _pick(NAMES)),
        ),
        (
            "S",
            "semantic_search",
            F.concat(F.lit(UPDATED), _pick(TOPICS), F.lit(CREDIT)),
            F.concat(F.lit(SUMMARIZE), _pick(TOPICS), F.lit(ABOUT)),
            F.create_map(F.lit("topic"), _pick(TOPICS)),
        ),
        (
            "R",
            "relationship_memory",
            F.format_string(JOINED, _pick(PEOPLE), _pick(COMPANIES), _pick(ROLES), 10 + i % 10),
            F.format_string(WHICH, _pick(PEOPLE)),
            F.create_map(F.lit("person"), _pick(PEOPLE), F.lit("company"), _pick(COMPANIES), F.lit("role"), _pick(ROLES)),
        ),
        (
            "C",
            "conversation_flow",
            F.when(even, _pick(ACTIONABLE)).otherwise(_pick(POLITE)),
            F.when(even, SCHEDULE).otherwise(ANYTHING),
            F.create_map(F.lit("actionable"), F.when(even, "True").otherwise("False")),
        ),
    ]
    items = [
        F.struct(F.concat(F.lit(p), text).alias("id"), F.lit(s).alias("stratum"), c.alias("content"), q.alias("query"), m.alias("meta"))
        for p, s, c, q, m in strata
    ]
    return ids.select(F.explode(F.array(*items)).alias("item")).select("item.*")


def evaluation_items(ids: DataFrame) -> DataFrame:
    """id, content, speaker, expected_quality: the given `content`, else the texts in turn; longer ones count as better."""
    content = F.col("content") if "content" in ids.columns else _pick(EVALUATION_TEXTS)
    return ids.select(
        F.concat(F.lit("eval_"), F.col("id").cast("string")).alias("id"),
        content.alias("content"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("speaker"),
        F.when(F.length(content) > 20, 0.8).otherwise(0.3).alias("expected_quality"),
    )


def _filled(text: Column, number: Column) -> Column:
    return F.replace(text, F.lit("{n}"), number.cast("string"))


def _nested(texts: list[list[str]]) -> Column:
    return F.array(*[F.array(*map(F.lit, t)) for t in texts])


def pattern_turns(ids: DataFrame) -> DataFrame:
    """A turn (turn_id, pattern, content, speaker) for each `id`: the five patterns in turn, so that a remainder goes to the first ones."""
    i = F.col("id")
    texts = F.element_at(_nested([t for _, t in TURN_PATTERNS]), (i % len(TURN_PATTERNS) + 1).cast("int"))
    content = _filled(F.element_at(texts, (F.floor(i / len(TURN_PATTERNS)) % 3 + 1).cast("int")), i)
    speaker = F.when(i % 2 == 0, "user").otherwise("assistant")
    return ids.select(i.alias("turn_id"), _pick([p for p, _ in TURN_PATTERNS]).alias("pattern"), content.alias("content"), speaker.alias("speaker"))


def class_examples(ids: DataFrame, n: int) -> DataFrame:
    """An example (id, label 0 to 2, content) for each `id` from 0 to `n` - 1, a third of each class; the last takes the rest."""
    i = F.col("id")
    label = F.least(F.floor(i / max(n // 3, 1)), F.lit(2)).cast("int")
    content = _filled(F.element_at(F.element_at(_nested(CLASS_TEXTS), label + 1), (i % 3 + 1).cast("int")), i)
    return ids.select("id", label.alias("label"), content.alias("content"))


def conversations(ids: DataFrame) -> DataFrame:
    """A conversation (conversation_id, template, turn, speaker, content) for each `id`, from the templates in turn."""
    i = F.col("id")
    texts = F.element_at(_nested([t for _, t in CONVERSATIONS]), (i % len(CONVERSATIONS) + 1).cast("int"))
    rows = ids.select("id", _pick([t for t, _ in CONVERSATIONS]).alias("template"), F.posexplode(texts).alias("turn", "text"))
    speaker = F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant")
    return rows.select(i.alias("conversation_id"), "template", "turn", speaker.alias("speaker"), _filled(F.col("text"), i).alias("content"))


def scenarios(rows: DataFrame) -> DataFrame:
    """Sessions (session, turn, content) that play the scenarios in turn, for rows (id, turn)."""
    return rows.select(F.col("id").alias("session"), "turn", _filled(_pick([m for _, m in SCENARIOS]), F.col("turn")).alias("content"))


def sample_session(ids: DataFrame) -> DataFrame:
    """The sample session for each `id`: session, turn, speaker, content."""
    said = F.array(*[F.struct(F.lit(s).alias("speaker"), F.lit(c).alias("content")) for s, c in SAMPLE_TURNS])
    return ids.select(F.col("id").alias("session"), F.posexplode(said).alias("turn", "x")).select("session", "turn", "x.speaker", "x.content")
