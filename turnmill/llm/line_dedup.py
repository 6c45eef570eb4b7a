"""Line dedup by an exact set-similarity join.

A line is the set of its words. Sets are ordered by token rarity; two similar
sets then share one of their first tokens, so only these are indexed (prefix
filter). Candidates must also fit in length, in what the shared token's
positions leave possible, and in the distance of parity bitmaps (a small one
first, then a wide one for long lines), all of which never lose a similar pair.
What is left is verified on the full sets, and a line with an earlier match is
removed.

Lines with equal words, in any order, form a class. First each class is tested
against the earliest one under a few keys that similar sets mostly share (the
smallest tokens under some hash functions). That settles the members of large
groups of near copies; pairs of settled classes are then left out of the join.
Rarity comes from a count table of fixed size: any common order of tokens gives
the same result, so words that share a cell only cost some speed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import Shelf, row_struct, saved, sized, unpack
from turnmill.llm.filters import FILTER_BITS, doc_slot, passes, slot_filter
from turnmill.llm.minhash import similar
from turnmill.llm.words import Spans, free_memory, gather, line_spans, lists, mix, reduce_rows, slices, span_hashes, word_spans

#: Cells of the token count table (a byte each, 4 while a task counts). Words that share a cell only cost some speed.
CELLS = 1 << 23
#: Cells whose counts are handed on as one row.
BLOCK = 1 << 12
#: Keys for the first test, and how many smallest tokens make one.
KEYS, MINIMA = 3, 3
PERCENT = 80
#: Tables are of hashes and class numbers, which hardly repeat: looking for repeated values takes time and saves no room.
PLAIN = {"parquet.enable.dictionary": "false", "parquet.compression.codec.zstd.level": "1"}
#: 64-bit words of the wide parity bitmap (a power of two), which still tells lines of hundreds of words apart.
WIDE = 8


def token_counts(texts: DataFrame) -> np.ndarray:
    """How often the words of each cell occur in `texts`, as a grade: 8 for each doubling, 0 for none or once.

    Tasks add up their own counts, and hand on those above 0 block by block, a block being a row. The driver gets at most
    a grade for each cell.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int32)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                cells, n = np.unique(_cells(span_hashes(data, word_spans(data, offsets))), return_counts=True)
                total[cells] += n.astype(np.int32)
        for low in range(0, CELLS, 64 * BLOCK):
            parts = total[low : low + 64 * BLOCK].reshape(-1, BLOCK)
            some = [np.flatnonzero(part) for part in parts]
            blocks = pa.array(low // BLOCK + np.arange(len(parts)), pa.int32())
            cells = pa.array([x.astype(np.uint16).tobytes() for x in some], pa.binary())
            times = pa.array([part[x].tobytes() for part, x in zip(parts, some, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([blocks, cells, times], ["block", "cells", "n"]).filter(pa.array([len(x) > 0 for x in some]))
        free_memory()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = total.setdefault(block, np.zeros(BLOCK, np.int64))
                held[np.frombuffer(cells, np.uint16)] += np.frombuffer(n, np.int32)
        for block, held in total.items():
            grade = np.minimum(np.floor(np.log2(np.maximum(held, 1)) * 8), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([grade.tobytes()], pa.binary())], ["block", "grade"])

    counted = texts.select("text").mapInArrow(count, "block int, cells binary, n binary")
    found = counted.repartition("block").mapInArrow(add, "block int, grade binary").toArrow()  # at most CELLS bytes
    grades = np.zeros((CELLS // BLOCK, BLOCK), np.uint8)
    for block, grade in zip(*(c.to_pylist() for c in found.columns), strict=True):
        grades[block] = np.frombuffer(grade, np.uint8)
    return grades.ravel()


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(CELLS - 1)).astype(np.int64)


class Lines:
    """The lines of a slice with their word hashes; `row` and `number` place the lines that have words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.lines: Spans = line_spans(data, offsets)
        words = word_spans(data, offsets)
        self.hashes = span_hashes(data, words)
        self.bounds = np.searchsorted(words.start, np.append(self.lines.start, len(data)))
        self.filled = np.flatnonzero(np.diff(self.bounds))
        self.row = self.lines.rows[self.filled]
        self.number = (self.filled - self.lines.bounds[self.row]).astype(np.int32)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent sums of the words' hashes: a 128-bit name for each filled line's words, in any order."""
        one = reduce_rows(np.add, mix(self.hashes ^ np.uint64(0xA5A5A5A5)), self.bounds, 0)
        two = reduce_rows(np.add, mix(self.hashes + np.uint64(0x5DEECE66D)), self.bounds, 0)
        return one[self.filled].view(np.int64), two[self.filled].view(np.int64)


def _sorted_by(line: np.ndarray, often: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The order by line, grade and hash, of one number for all three where it tells them apart (36 bits of the hash do)."""
    if len(line) and line[-1] < 1 << 20:
        whole = (line.astype(np.uint64) << np.uint64(44)) | (often.astype(np.uint64) << np.uint64(36)) | (hashes >> np.uint64(28))
        order = np.argsort(whole)
        whole, sorted_hashes = whole[order], hashes[order]
        if not np.any((whole[1:] == whole[:-1]) & (sorted_hashes[1:] != sorted_hashes[:-1])):
            return order
    return np.lexsort((hashes, often, line))


class TokenSets:
    """The distinct tokens of some of the `lines`, each set in the order of rarity if grades of frequency are given."""

    def __init__(self, lines: Lines, chosen: np.ndarray, grades: np.ndarray | None = None):
        length = lines.bounds[chosen + 1] - lines.bounds[chosen]
        hashes = gather(lines.hashes, lines.bounds[chosen], length)
        line = np.repeat(np.arange(len(chosen)), length)
        often = np.zeros(len(hashes), np.uint8) if grades is None else grades[_cells(hashes)]
        order = _sorted_by(line, often, hashes)
        hashes, often, line = hashes[order], often[order], line[order]
        new = np.ones(len(line), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])
        self.tokens, self.often, self.line = hashes[new], often[new], line[new]
        self.bounds = np.searchsorted(self.line, np.arange(len(chosen) + 1))
        self.sizes = np.diff(self.bounds)

    def wide(self) -> np.ndarray:
        """WIDE words per set: for each bit, whether an odd number of tokens fall on it."""
        place = self.tokens >> np.uint64(64 - (64 * WIDE - 1).bit_length())
        parity = np.zeros((len(place), WIDE), np.uint64)
        parity[np.arange(len(place)), (place >> np.uint64(6)).astype(np.int64)] = np.uint64(1) << (place & np.uint64(63))
        return reduce_rows(np.bitwise_xor, parity, self.bounds, 0)

    def keys(self) -> np.ndarray:
        """KEYS numbers per set, each from the smallest tokens under MINIMA hash functions."""
        out = np.zeros((len(self.sizes), KEYS), np.uint64)
        for k in range(KEYS):
            for m in range(MINIMA):
                n = np.uint64(MINIMA * k + m + 1)
                least = reduce_rows(np.minimum, (self.tokens ^ mix(np.array([n]))) * (mix(np.array([n + np.uint64(99)])) | np.uint64(1)), self.bounds, 0)
                out[:, k] = mix(out[:, k] * np.uint64(31) + least + n)
        return out


def required(total: Column, percent: int) -> Column:
    """Least intersection of two similar sets whose sizes add up to `total`."""
    return ((percent * total + (99 + percent)) / F.lit(100 + percent)).cast("int")  # rounded up


def line_classes(texts: DataFrame, grades: Broadcast, percent: int, shelf: Shelf) -> DataFrame:
    """One row per distinct bag of words: class (a number), doc_id and line (the first one's), times, n, one, two,
    bits (parity bitmap), keys and tokens (the prefix, with 0 for tokens that occur once).

    Tokens are cut to 32 bits (and never 0) here: that may add candidates, but loses none.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(1)):
                lines = Lines(data, offsets)
                sets = TokenSets(lines, lines.filled, grades.value)
                prefix = sets.sizes - -(-percent * sets.sizes // 100) + 1
                edges = np.concatenate([[0], np.cumsum(prefix)])
                kept = gather(np.arange(len(sets.line)), sets.bounds[:-1], prefix)
                short = (sets.tokens[kept] >> np.uint64(32)).astype(np.uint32)
                short = np.where(sets.often[kept] > 0, np.maximum(short, 1), 0).astype(np.uint32)
                one, two = lines.digests()
                parity = np.uint64(1) << (sets.tokens >> np.uint64(58))
                bits = reduce_rows(np.bitwise_xor, parity, sets.bounds, 0).view(np.int64)
                keys = sets.keys().view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low).take(pa.array(lines.row)),
                        pa.array(lines.number),
                        pa.array(sets.sizes.astype(np.int32)),
                        pa.array(one),
                        pa.array(two),
                        pa.array(bits),
                        lists(keys, KEYS * np.arange(len(sets.sizes) + 1), pa.int64()),
                        lists(short.view(np.int32), edges, pa.int32()),
                    ],
                    ["doc_id", "line", "n", "one", "two", "bits", "keys", "tokens"],
                )
        free_memory()

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.select("doc_id", "text").mapInArrow(
        work, f"doc_id {kind}, line int, n int, one long, two long, bits long, keys array<long>, tokens array<int>"
    )
    rest = F.struct("n", "bits", "keys", "tokens")
    first = rows.groupBy("one", "two").agg(
        F.min(F.struct("doc_id", "line")).alias("first"), F.count(F.lit(1)).alias("times"), F.first(rest).alias("rest")
    )
    classes = first.select("first.*", "times", "rest.*", "one", "two")
    return shelf.put(classes.withColumn("class", F.monotonically_increasing_id()))


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) that can be similar by their wide bitmaps, which are much smaller than the full sets."""
    x = sets.select(F.col("class").alias("a"), F.col("n").alias("nx"), F.col("wide").alias("x"))
    y = sets.select(F.col("class").alias("b"), F.col("n").alias("ny"), F.col("wide").alias("y"))
    total = F.col("nx") + F.col("ny")
    differ = sum((F.bit_count(F.col("x")[i].bitwiseXOR(F.col("y")[i])) for i in range(WIDE)), F.lit(0))
    return pairs.join(x, "a").join(y, "b").where(differ <= total - 2 * required(total, percent)).select("a", "b")


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, shelf: Shelf) -> DataFrame:
    """The later classes of those `pairs` (a, b) that are similar, kept on `shelf`; all else that is made here is deleted."""
    own_shelf = Shelf(texts.sparkSession, **PLAIN)
    pairs = own_shelf.put(pairs)
    wanted = own_shelf.put(pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct())
    wanted = own_shelf.put(classes.select("class", "doc_id", "line", "one", "two").join(sized(wanted), "class"))
    docs = own_shelf.broadcast(slot_filter(wanted, doc_slot(F.col("doc_id"))))
    mask = (1 << FILTER_BITS) - 1
    own = own_shelf.broadcast(slot_filter(wanted, F.col("one").bitwiseAND(F.lit(mask)) + 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(docs.value, batch.column(0).to_numpy() - 1)))
            for _, _, data, offsets in slices(batch.column(1)):
                lines = Lines(data, offsets)
                one, two = lines.digests()
                kept = passes(own.value, one & mask)
                sets = TokenSets(lines, lines.filled[kept])
                members = lists(sets.tokens.view(np.int64), sets.bounds, pa.int64())
                wide = lists(sets.wide().view(np.int64).ravel(), WIDE * np.arange(len(sets.sizes) + 1), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one[kept]), pa.array(two[kept]), pa.array(sets.sizes.astype(np.int32)), wide, members],
                    ["one", "two", "n", "wide", "members"],
                )
        free_memory()

    found = texts.select(doc_slot(F.col("doc_id")).alias("slot"), "text").mapInArrow(
        work, "one long, two long, n int, wide array<long>, members array<long>"
    )
    place = F.struct("doc_id", "line", "one", "two").alias("place")
    sets = own_shelf.put(wanted.join(found.dropDuplicates(["one", "two"]), ["one", "two"]).select("class", place, "n", "wide", "members"))
    left = sets.select(F.col("class").alias("a"), F.col("place").alias("p"), F.col("members").alias("left"))
    right = sets.select(F.col("class").alias("b"), F.col("place").alias("q"), F.col("members").alias("right"))
    matched = _near(pairs, sets, percent).join(left, "a").join(right, "b").where(similar(F.col("left"), F.col("right"), percent))
    later = F.when(F.col("p") > F.col("q"), F.col("a")).otherwise(F.col("b"))
    later = shelf.put(matched.select(later.alias("class")).distinct())
    own_shelf.clear()
    return later


def matched_classes(classes: DataFrame, texts: DataFrame, percent: int, shelf: Shelf) -> DataFrame:
    """The classes with an earlier similar one."""

    def fits(x: str, y: str, nx: Column, ny: Column) -> Column:
        """Length and bitmap: sizes within `percent`, and no more differing tokens than similar sets may have."""
        differ = F.bit_count(F.col(f"{x}.bits").bitwiseXOR(F.col(f"{y}.bits")))
        return (
            (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny))
            & ((100 + percent) * (nx + ny - differ) >= 2 * percent * (nx + ny))  # whole numbers only: tried on very many pairs
            & (F.col(f"{x}.class") != F.col(f"{y}.class"))
        )

    def ordered(rows: DataFrame, x: str, y: str) -> DataFrame:
        pair = [F.least(f"{x}.class", f"{y}.class").alias("a"), F.greatest(f"{x}.class", f"{y}.class").alias("b")]
        return rows.select(*pair).distinct()

    leading = classes.select("doc_id", "line", "class", "n", "bits", F.explode("keys").alias("token"))
    # Written, so that Spark can split what joins a frequent key; a key of one class only meets itself. Most keys are such:
    # counts tell them before the wider rows are grouped.
    shared = shelf.put(leading.groupBy("token").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("token"))
    leading = shelf.put(leading.join(shared, "token", "left_semi"))
    first = F.min(F.struct("doc_id", "line", "class", "n", "bits")).alias("e")
    earliest = shelf.put(leading.groupBy("token").agg(first).select("token", "e.*"))
    x, y = leading.drop("doc_id", "line").alias("x"), earliest.drop("doc_id", "line").alias("y")
    tries = x.join(y, (F.col("x.token") == F.col("y.token")) & fits("x", "y", F.col("x.n"), F.col("y.n")))
    settled = _verified(ordered(tries, "x", "y"), classes, texts, percent, shelf)

    flagged = classes.select("class", "n", "bits", "tokens").join(
        sized(settled).withColumn("settled", F.lit(1)), "class", "left"
    )
    n, settled_flag = F.col("n").cast("long"), F.coalesce("settled", F.lit(0))
    postings = flagged.select("class", "bits", n.alias("n"), settled_flag.alias("s"), F.posexplode("tokens").alias("place", "token"))
    # The shorter set of a pair has the shared token within its first n less what both must share: it is indexed there.
    indexed = (F.col("place") <= F.col("n") - required(2 * F.col("n"), percent)).cast("int")
    state = F.shiftleft("n", 32) + F.shiftleft("place", 2) + 2 * indexed + F.col("s")
    postings = postings.where("token <> 0").select("class", "bits", "token", state.alias("state"))

    def part(side: str) -> tuple[Column, Column, Column, Column]:
        """n, place, indexed and settled, packed into one number to keep the shuffle small."""
        s = F.col(f"{side}.state")
        low = s.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
        return F.shiftright(s, 32).cast("int"), F.shiftright(low, 2), F.shiftright(low, 1).bitwiseAND(1), low.bitwiseAND(1)

    (nx, px, ix, _), (ny, py, iy, sy) = part("x"), part("y")
    # Only unsettled classes look for partners, so the settled ones of a large group never meet; two unsettled ones meet in
    # one order. Cheap conditions come first.
    enough = (100 + percent) * F.least(nx - px, ny - py) >= percent * (nx + ny)
    pairs = postings.where(F.col("state").bitwiseAND(F.lit(1)) == 0).alias("x").join(
        postings.alias("y"),
        (F.col("x.token") == F.col("y.token"))
        & ((sy > 0) | (F.col("x.class") < F.col("y.class")))
        & (F.when(ny <= nx, iy).otherwise(ix) > 0)
        & fits("x", "y", nx, ny)
        & enough,
    )
    others = _verified(ordered(pairs, "x", "y"), classes, texts, percent, shelf)
    return shelf.put(settled.union(others).distinct())


def removed_lines(
    docs: DataFrame, *, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: doc_id, key (a hash of the text), n_lines, n_filled, removed.

    Lines are what line feeds separate, numbered from 0; a line's words are split at
    ASCII white space and lower-cased in A-Z. A line is `removed` (its number is in
    that array) if an earlier line, by doc_id and number, has a set of words with
    intersection at least `percent` hundredths of the union. Lines without words
    stay. A null text is one empty line. A null id comes first in the order. Rows
    that repeat id and text are one document, so neither copy removes the other's
    lines, and each gets the same answer; rows of one id with different texts are
    ordered by line number. An empty table gives an empty table; other columns are ignored.
    """
    shelf = Shelf(docs.sparkSession, **PLAIN)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    classes = line_classes(texts, shelf.broadcast(token_counts(texts)), percent, shelf)
    matched = sized(matched_classes(classes, texts, percent, shelf)).withColumn("matched", F.lit(True))
    verdicts = classes.select("class", "one", "two", "times", F.struct("doc_id", "line").alias("first")).join(matched, "class", "left")
    verdicts = saved(verdicts.where("times > 1 or matched").drop("class", "times"))
    mask = (1 << FILTER_BITS) - 1
    own = shelf.broadcast(slot_filter(verdicts, F.col("one").bitwiseAND(F.lit(mask)) + 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(1)):
                lines = Lines(data, offsets)
                one, two = lines.digests()
                filled = np.bincount(lines.row, minlength=high - low)
                kept = passes(own.value, one & mask)
                row, number, one, two = lines.row[kept], lines.number[kept], one[kept], two[kept]
                edges = np.searchsorted(row, np.arange(high - low + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        batch.column(2).slice(low, high - low),
                        pa.array(lines.lines.counts.astype(np.int64)),
                        pa.array(filled.astype(np.int64)),
                        lists(number, edges, pa.int32()),
                        lists(one, edges, pa.int64()),
                        lists(two, edges, pa.int64()),
                    ],
                    ["doc_id", "key", "n_lines", "n_filled", "line", "one", "two"],
                )
        free_memory()

    kind = texts.schema["doc_id"].dataType.simpleString()
    lined = saved(
        texts.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(
            work, f"doc_id {kind}, key long, n_lines long, n_filled long, line array<int>, one array<long>, two array<long>"
        )
    )
    shelf.clear()
    single = lined.select("doc_id", "key", F.explode(F.arrays_zip("line", "one", "two")).alias("x")).select("doc_id", "key", "x.*")
    later = F.struct("doc_id", "line") > F.col("first")
    gone = (
        single.join(verdicts, ["one", "two"])
        .where(F.col("matched").isNotNull() | later)
        .groupBy(F.col("doc_id").alias("of_doc"), F.col("key").alias("of_key"))
        .agg(F.sort_array(F.collect_set("line")).alias("removed"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("key") == F.col("of_key"))
    return lined.drop("line", "one", "two").join(gone, same, "left").select(
        "doc_id",
        "key",
        "n_lines",
        "n_filled",
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"),
    )


def without_repeated_lines(
    docs: DataFrame, *, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of `docs` with matched lines cut from their texts; rows that lose all their words go.

    All columns are kept as they are, but for the text. See removed_lines for nulls,
    ties, repeated rows and empty tables.
    """
    found = removed_lines(docs, percent=percent, id_col=id_col, text_col=text_col).where(F.size("removed") > 0)
    verdicts = saved(found.select("doc_id", "key", "n_filled", "removed").dropDuplicates(["doc_id", "key"]))
    touched_slots = docs.sparkSession.sparkContext.broadcast(slot_filter(verdicts, doc_slot(F.col("doc_id"))))

    @F.pandas_udf("boolean")
    def touched(slot: pd.Series) -> pd.Series:
        return pd.Series(passes(touched_slots.value, slot.to_numpy() - 1))

    # Only documents that lose lines, and the few that share a slot with these, go through the join.
    maybe = touched(doc_slot(docs[id_col]))
    key = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    part = docs.where(maybe).select(row_struct(docs).alias("row"), F.col(id_col).alias("ident"), key.alias("text_key"))
    same = part["ident"].eqNullSafe(verdicts["doc_id"]) & (part["text_key"] == verdicts["key"])
    lines = F.split(F.col("row").getField(text_col), "\n", -1)
    whole = F.struct(lines.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "removed").alias("kept"))
    # One pass over the lines: the split text is bound once, as the element of an array.
    left = F.transform(F.array(whole), lambda s: F.array_join(F.transform(s["kept"], lambda i: s["lines"][i]), "\n"))[0]
    cut = F.when(F.col("removed").isNotNull(), left).otherwise(F.col("row").getField(text_col))
    emptied = F.coalesce(F.size("removed") == F.col("n_filled"), F.lit(False))
    columns = [cut.alias(c) if c == text_col else own for c, own in zip(docs.columns, unpack(docs, "row", docs.columns), strict=True)]
    return docs.where(~maybe).union(part.join(verdicts, same, "left").where(~emptied).select(*columns))
