"""Preference formatting of conversations (DataFrame operations only).

A pair has a chosen and a rejected conversation. Their longest common prefix of
turns is rendered once, as the prompt; what follows in each is its completion,
with a mask that covers what the model is to learn: the assistant's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, TAIL = ("<|", "|>\n"), "<|end|>\n"
LEARN_FROM = "assistant"


def escaped(text: Column) -> Column:
    r"""A text that can't forge a mark: one more backslash goes between < and |. To undo it, take one from each <\...|."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def _head(turn: Column) -> Column:
    return F.concat(F.lit(HEAD[0]), escaped(turn["role"]), F.lit(HEAD[1]))


def _body(turn: Column) -> Column:
    return F.concat(escaped(turn["text"]), F.lit(TAIL))


def render(turns: Column) -> Column:
    """One string: for each turn <|role|>, a line feed, its text and <|end|>. Nulls are empty strings; see `escaped` for
    marks inside a text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def mask_spans(turns: Column, role: str = LEARN_FROM) -> Column:
    """Array of (start, end): the characters of `render(turns)` that are learnt, `role`'s texts with their end marks."""
    spans = F.array().cast("array<struct<start:int,end:int>>")

    def add(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(_head(turn))
        end = start + F.length(_body(turn))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        own = F.coalesce(turn["role"] == role, F.lit(False))
        return F.struct(end.alias("at"), F.when(own, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), spans.alias("spans")), add, lambda s: s["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """How many turns (role and text) both conversations start with; a null equals a null."""
    differ = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    first = F.array_position(differ, True)
    return F.when(first > 0, first - 1).otherwise(F.size(differ)).cast("int")


def preference_format(pairs: DataFrame, *, chosen: str = "chosen", rejected: str = "rejected", role: str = LEARN_FROM) -> DataFrame:
    """The columns of `pairs` but the two conversations (arrays of role and text), in the struct `rest`, with
    n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    A null conversation is an empty one. Equal conversations are all prompt, with empty
    completions and masks; without a common turn the prompt is empty. Repeated rows are formatted alike; an empty table gives an empty table.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")

    def turns(name: str) -> Column:
        return F.coalesce(F.transform(name, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), empty)

    rest = [F.col(f"`{c}`") for c in pairs.columns if c not in (chosen, rejected)]
    found = pairs.select(F.struct(*rest).alias("rest"), turns(chosen).alias("a"), turns(rejected).alias("b"))
    found = found.withColumn("n", common_turns(F.col("a"), F.col("b")))
    after = {x: F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0))) for x in ("a", "b")}
    return found.select(
        "rest",
        F.col("n").alias("n_prompt_turns"),
        render(F.slice("a", 1, F.col("n"))).alias("prompt"),
        render(after["a"]).alias("chosen"),
        render(after["b"]).alias("rejected"),
        mask_spans(after["a"], role).alias("chosen_mask"),
        mask_spans(after["b"], role).alias("rejected_mask"),
    )


def pairs_from_conversations(turns: DataFrame, role: str = LEARN_FROM) -> DataFrame:
    """Pairs (conv_id, chosen, rejected) from plain conversations (conv_id, turn, role, text).

    Each conversation up to its last turn of `role` is chosen. Of its replies, turns of
    `role`, number conv_id modulo their count is where the rejected one goes astray: from
    there on it has the turns of the neighbour's chosen conversation at the same places (2k
    and 2k + 1 are neighbours), or ends if there is none. Where both happen to say the same,
    the common prefix is longer. Conversations without a reply, and turns without a conv_id,
    make no pair. Turns that tie in number are ordered by role and text; repeated rows are
    turns of their own. All turns of a conversation meet in one row, as the output has them in
    one string. An empty table gives an empty table; other columns are ignored.
    """
    held = turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    replies = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == role)
    held = held.withColumn("replies", replies).where(F.size("replies") > 0)
    own = F.slice("turns", 1, F.element_at("replies", -1))
    astray = F.get("replies", F.pmod("conv_id", F.size("replies")).cast("int"))
    plain = F.transform(own, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    held = held.select("conv_id", plain.alias("chosen"), astray.alias("astray"))
    neighbour = F.col("conv_id") + 1 - 2 * F.pmod("conv_id", F.lit(2))
    others = held.select(neighbour.alias("conv_id"), F.col("chosen").alias("other"))
    none = F.array().cast("array<struct<role:string,text:string>>")
    rest = F.coalesce(F.slice("other", F.col("astray"), F.size("other")), none)
    rejected = F.concat(F.slice("chosen", 1, F.col("astray") - 1), rest)
    return held.join(others, "conv_id", "left").select("conv_id", "chosen", rejected.alias("rejected"))
