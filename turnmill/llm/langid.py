"""Language identification by prediction by partial matching (PPM).

Per language a tree of byte contexts up to `DEPTH` bytes long, with counts of
the bytes that follow. In a context with total t and d different followers, a
byte seen n times has probability n / (t + d); the escape, d / (t + d), goes to
the next shorter context with the seen bytes excluded; below the empty context
all 256 bytes are equally likely. After training the statistics are frozen. Then
an unseen byte costs what it costs in the shorter context plus a number that
depends on the context alone (its escape over what is free in the shorter one).
So a language is two sorted tables, the code lengths of what was seen and the
contexts' escapes, with no entry for what was not seen and no bound on either.

Training counts on a documented, bounded sample: about `PER_LANGUAGE` labelled
documents of each language, chosen by a hash of the id. A text is scored in
blocks, each distinct run of DEPTH + 1 bytes once; code lengths are integers (in
parts of `UNIT` of a bit), so that sums don't depend on where the blocks end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.llm.words import free_memory, reduce_rows, slices

DEPTH = 3
PER_LANGUAGE = 2000
#: What stands before the first byte of a text.
PAD = 10
UNIT = 1 << 20
#: Bytes that are scored at once.
BLOCK = 1 << 17
UNDETERMINED = "und"


@dataclass
class Tree:
    """One language, frozen: sorted keys with their code lengths. A key is a run of bytes as a number, its length above it."""

    seen: np.ndarray
    lengths: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of each run's last byte after the others."""
        total = np.zeros(len(grams), np.int64)
        open_ = np.arange(len(grams))
        for depth in range(DEPTH, -1, -1):
            keys = _key(grams[open_], depth + 1)
            at, hit = _find(self.seen, keys)
            total[open_[hit]] += self.lengths[at[hit]]
            open_ = open_[~hit]
            at, hit = _find(self.contexts, _key(grams[open_] >> 8, depth))
            total[open_[hit]] += self.escapes[at[hit]]
        total[open_] += 8 * UNIT
        return total


@dataclass
class Model:
    languages: list[str]
    trees: list[Tree]

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each row under each language, in parts of UNIT of a bit."""
        out = np.zeros((len(offsets) - 1, len(self.languages)), np.int64)
        for low in range(0, len(data), BLOCK):
            high = min(low + BLOCK, len(data))
            grams, which = np.unique(byte_runs(data, offsets, low, high), return_inverse=True)
            first = int(np.searchsorted(offsets, low, "right")) - 1
            last = int(np.searchsorted(offsets, high, "left"))
            bounds = np.clip(offsets[first : last + 1], low, high) - low
            for k, tree in enumerate(self.trees):
                out[first:last, k] += reduce_rows(np.add, tree.bits(grams)[which], bounds, 0)
        return out


def _key(runs: np.ndarray, length: int) -> np.ndarray:
    """The last `length` bytes of the runs, marked with that length."""
    return runs & ((1 << 8 * length) - 1) | length << 40


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def byte_runs(data: np.ndarray, offsets: np.ndarray, low: int, high: int) -> np.ndarray:
    """For each byte low..high-1 the DEPTH bytes before it in its row (PAD before the row's start) and itself, as one number."""
    before = data[max(low - DEPTH, 0) : high].astype(np.int64)
    before = np.concatenate([np.full(DEPTH - min(low, DEPTH), PAD), before])
    runs = np.zeros(high - low, np.int64)
    for k in range(DEPTH + 1):
        runs = runs << 8 | before[k : k + high - low]
    starts = offsets[:-1][(offsets[:-1] < high) & (offsets[:-1] > low - DEPTH)]
    for own in range(DEPTH, 0, -1):  # the byte own - 1 after a row's start sees `own` bytes of its row
        at = starts + own - 1 - low
        at = at[(at >= 0) & (at < high - low)]
        pads = sum(PAD << 8 * k for k in range(own, DEPTH + 1))
        runs[at] = runs[at] & ((1 << 8 * own) - 1) | pads
    return runs


def gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each run of DEPTH + 1 bytes occurs; the gram is a big-endian number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for low, high, data, offsets in slices(batch.column(1)):
                names, which = np.unique(langs[low:high], return_inverse=True)
                for start in range(0, len(data), BLOCK):
                    end = min(start + BLOCK, len(data))
                    rows = np.searchsorted(offsets, np.arange(start, end), "right") - 1
                    grams = byte_runs(data, offsets, start, end)
                    keys, n = np.unique(which[rows] << 8 * (DEPTH + 1) | grams, return_counts=True)
                    columns = [
                        pa.array(names[keys >> 8 * (DEPTH + 1)].tolist(), pa.string()),
                        pa.array(keys & ((1 << 8 * (DEPTH + 1)) - 1)),
                        pa.array(n.astype(np.int64)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n"])
        free_memory()

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def build_tree(grams: np.ndarray, n: np.ndarray) -> Tree:
    """Freezes one language's counts of runs of DEPTH + 1 bytes, from the shortest contexts to the longest."""
    seen, lengths, contexts, escapes = [], [], [], []
    shorter, shorter_p = np.zeros(0, np.int64), np.zeros(0)
    for depth in range(DEPTH + 1):
        keys, which = np.unique(grams & ((1 << 8 * (depth + 1)) - 1), return_inverse=True)
        freq = np.bincount(which, n)
        own, of = np.unique(keys >> 8, return_inverse=True)
        t, d = np.bincount(of, freq), np.bincount(of)
        # What the shorter context gives to the bytes seen here; all of them were seen there too.
        parent = shorter_p[np.searchsorted(shorter, keys & ((1 << 8 * depth) - 1))] if depth else np.full(len(keys), 1 / 256)
        free = np.where(d < 256, np.maximum(1 - np.bincount(of, parent), 1e-12), 1.0)
        p = freq / np.where(d < 256, t + d, t)[of]
        escape = d / ((t + d) * free)
        seen.append(_key(keys, depth + 1))
        lengths.append(-np.log2(p))
        contexts.append(_key(own, depth))
        escapes.append(-np.log2(escape))
        shorter, shorter_p = keys, p

    def units(x: list[np.ndarray]) -> np.ndarray:
        return np.rint(np.concatenate(x) * UNIT).astype(np.int64)

    return Tree(np.concatenate(seen), units(lengths), np.concatenate(contexts), units(escapes))


def train(labelled: DataFrame, *, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from `labelled` (id, lang, text); null labels and texts are left out.

    Languages with more than `per_language` documents are sampled down to about that
    number by a hash of the id; equal rows are drawn together. Only counts come to the
    driver, one for each distinct run of bytes in a language's sample.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = [(r["lang"], min(1.0, per_language / r["n"])) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]
    if not totals:
        return Model([], [])
    # From an Arrow table Spark makes a local relation, whose size it knows, so that the texts needn't be shuffled.
    chances = spark.createDataFrame(pa.table({"lang": [x for x, _ in totals], "chance": [x for _, x in totals]}))
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit("langid")), F.lit(1 << 32)) / F.lit(float(1 << 32))
    table = gram_counts(rows.select("id", "lang", "text").join(chances, "lang").where(draw < F.col("chance"))).toArrow()
    langs = table.column("lang").to_pylist()
    grams, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    languages = sorted(set(langs))
    number = {lang: i for i, lang in enumerate(languages)}
    which = np.fromiter((number[x] for x in langs), np.int64, len(langs))
    order = np.argsort(which, kind="stable")
    bounds = np.searchsorted(which[order], np.arange(len(languages) + 1))
    parts = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return Model(languages, [build_tree(grams[p], n[p].astype(np.float64)) for p in parts])


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: the struct `row` of all its columns, lang_pred, score, bits_per_byte.

    `score` is the language's share of the likelihood if all are equally likely. A
    null text, one without a letter, and any text under an empty model get `und`,
    score 0 and a null bits_per_byte. Ties go to the first language in code-point
    order. Equal texts get equal results; an empty table gives an empty table. A very
    long text is scored in blocks; repeated rows and null ids are scored like others.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c != text_col]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(2)):
                lettered = np.array(batch.column(1).slice(low, high - low).to_pylist(), bool)
                n = high - low
                names, score, rate = [UNDETERMINED] * n, np.zeros(n), [None] * n
                if own.languages:
                    bits = own.bits(data, offsets)
                    best = bits.argmin(1)
                    share = 1 / np.exp2((bits.min(1, keepdims=True) - bits) / UNIT).sum(1)
                    for i in np.flatnonzero(lettered):
                        names[i] = own.languages[best[i]]
                        score[i] = share[i]
                        rate[i] = bits[i, best[i]] / UNIT / (offsets[i + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, n),
                        batch.column(2).slice(low, n),
                        pa.array(names, pa.string()),
                        pa.array(score, pa.float64()),
                        pa.array(rate, pa.float64()),
                    ],
                    ["rest", "text", "lang_pred", "score", "bits_per_byte"],
                )
        free_memory()

    rest = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(None).cast("int").alias("_"))
    prepared = docs.select(rest.alias("rest"), has_letter(F.col(text_col)).alias("lettered"), F.col(text_col).alias("text"))
    kind = prepared.schema["rest"].dataType.simpleString()
    found = prepared.mapInArrow(predict, f"rest {kind}, text string, lang_pred string, score double, bits_per_byte double")
    row = F.struct(*[F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns])
    return found.select(row.alias("row"), "lang_pred", "score", "bits_per_byte")
