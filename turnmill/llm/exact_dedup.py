"""Exact dedup by content-defined chunk recipes (DataFrame operations only).

A text is cut where its own content says so: a chunk runs for `MIN_CHUNK`
characters and then to the next sentence mark or line end, or at most
`MAX_CHUNK` characters. A document becomes its recipe, the ordered list of its
chunks' identifiers. Texts are cut once, into a saved table. Chunk texts move
once, to prove that no two different chunks share an identifier; after that only
the short recipes are shuffled, grouped and compared.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import Shelf, ascii_lower

MIN_CHUNK, MAX_CHUNK = 512, 4096
#: Lazy up to a sentence mark or line end; without one, the longest chunk or the rest.
CHUNK_PATTERN = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?[.!?\n]|.{{1,{MAX_CHUNK}}}"
#: Identifiers to try in turn. The last is the chunk itself and can't clash.
IDENTIFIERS: tuple[Callable[[Column], Column], ...] = (
    lambda c: F.md5(c),
    lambda c: F.sha2(c, 512),
    lambda c: c,
)


def chunks(text: Column) -> Column:
    """The chunks of a text, in order; concatenated they give the text back. Empty text: none."""
    return F.regexp_extract_all(text, F.lit(CHUNK_PATTERN), F.lit(0))


def verified_identifier(cut: DataFrame, identifiers: Sequence[Callable[[Column], Column]]):
    """The first of `identifiers` under which no two different ones of `cut`'s chunks clash.

    The distinct chunks are grouped by their whole content, so copies are dropped
    before the shuffle; an identifier with two contents disqualifies the function.
    """
    for identify in identifiers[:-1]:
        found = cut.select(F.explode("chunks").alias("chunk")).select(identify(F.col("chunk")).alias("id"), "chunk")
        clashes = found.groupBy("id", "chunk").count().groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if clashes.isEmpty():
            return identify
    return identifiers[-1]


def exact_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    identifiers: Sequence[Callable[[Column], Column]] = IDENTIFIERS,
) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the
    largest id stays. A null text counts as empty; all empty texts are one group.
    A null id never stays unless all ids of its group are null. Rows that repeat
    both id and text count in `group_size` and are all marked kept if their id
    stays: they are the same document. An empty table gives an empty table;
    other columns are ignored.
    """
    shelf, result = Shelf(docs.sparkSession), Shelf(docs.sparkSession)
    texts = docs.select(
        F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("normalised")
    )
    cut = shelf.put(texts.select("doc_id", chunks(F.col("normalised")).alias("chunks"), F.sha2("normalised", 256).alias("text_sha256")))
    identify = verified_identifier(cut, identifiers)
    recipes = result.put(cut.select("doc_id", "text_sha256", F.transform("chunks", identify).alias("recipe")))
    shelf.clear()
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # Only texts that occur again are looked up. Both sides are plain tables, so that Spark can split a large group.
    groups = result.put(groups.where("group_size > 1"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return recipes.join(groups, "recipe", "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
