"""Best-fit packing of token sequences after a dominance reduction.

How well pieces pack depends only on how many there are of each length, so the
plan is made from that histogram: at most `capacity` numbers, whatever the size
of the corpus. First, sets that provably dominate all others with the same
piece are fixed for good (Martello and Toth); the rest is packed best-fit
decreasing, all pieces of a length in one step. The plan maps ranks within a
length to sequences and is broadcast (it is bounded by the capacity as well);
the pieces are ranked by hash bins, so that no task sees all of one length.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnmill.llm.common import cut_lineage
from turnmill.llm.words import SPACE, Spans, free_memory, gather, reduce_rows, slices, span_hashes

CAPACITY = 1024
EOS = 2
BINS = 1024
#: Distinct chunks that a worker keeps tokenised.
CACHE = 200_000
#: From so many characters on, a run of white space is encoded apart. The class is the pattern's own white space.
RUN = 20_000
_WHITE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_RUN = re.compile(f"(?<!{_WHITE}){_WHITE}{{{RUN},}}")
PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long"


# --- tokens -------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _encoding(path: str):
    """The byte-level BPE as ranks. They are the same vocabulary as the `tokenizers` file, and encode faster."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Tokeniser:
    """Token ids of whole batches of texts.

    The vocabulary's pattern never joins across the start of a run of white space,
    so a text falls into chunks (white space, then a word) with tokens of their own.
    Distinct chunks are encoded together, in one string, and repeated ones looked up.
    Texts with white space beyond ASCII are encoded whole.
    """

    def __init__(self, path: str):
        self.encoding, self.sizes = _encoding(path)
        self.line_feed = int(self._encode("\n")[0])
        self._reset()

    def _reset(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _encode(self, text: str) -> np.ndarray:
        """Ids of a text. Its longest runs of white space would exhaust the pattern's stack, so these are cut out first:
        by the pattern a run but for its last character is one piece (at the end of the text, the whole run)."""
        parts, begin = [], 0
        for run in LONG_RUN.finditer(text) if len(text) >= RUN else ():
            end = run.end() if run.end() == len(text) else run.end() - 1
            parts.append(self.encoding.encode_ordinary(text[begin : run.start()]))
            parts.append(self.encoding._encode_single_piece(text[run.start() : end]))
            begin = end
        parts.append(self.encoding.encode_ordinary(text[begin:]))
        return np.concatenate([np.asarray(p, np.uint32) for p in parts])

    @staticmethod
    def _wide_space(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that have a white-space character beyond ASCII."""
        at = np.flatnonzero(np.isin(data, (0xC2, 0xE1, 0xE2, 0xE3)))
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        one, two, three = padded[at], padded[at + 1], padded[at + 2]
        wide = (one == 0xC2) & np.isin(two, (0x85, 0xA0))
        wide |= (one == 0xE1) & (two == 0x9A) & (three == 0x80)
        wide |= (one == 0xE2) & (two == 0x80) & ((three <= 0x8A) | np.isin(three, (0xA8, 0xA9, 0xAF)))
        wide |= (one == 0xE2) & (two == 0x81) & (three == 0x9F)
        wide |= (one == 0xE3) & (two == 0x80) & (three == 0x80)
        rows = np.zeros(len(offsets) - 1, bool)
        rows[np.searchsorted(offsets, at[wide], "right") - 1] = True
        return rows

    @staticmethod
    def _chunks(data: np.ndarray, offsets: np.ndarray) -> Spans:
        starts = SPACE[data]
        starts[1:] &= ~SPACE[data[:-1]]
        some = offsets[:-1] < offsets[1:]
        starts[offsets[:-1][some]] = True
        start = np.flatnonzero(starts)
        end = np.append(start[1:], len(data))
        return Spans(start, end, np.searchsorted(start, offsets))

    def _learn(self, data: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Encodes chunks that aren't known. A chunk that ends in white space may only stand at the end of a text."""
        loose = SPACE[data[end - 1]]
        lengths, parts = np.zeros(len(start), np.int64), []
        for i in np.flatnonzero(loose):
            parts.append(self._encode(data[start[i] : end[i]].tobytes().decode()))
            lengths[i] = len(parts[-1])
        tight = np.flatnonzero(~loose)
        if len(tight):
            bare = ~SPACE[data[start[tight]]]  # at the start of a text: a line feed goes before, a token of its own
            size = end[tight] - start[tight]
            places = np.cumsum(size + bare)
            joined = np.full(int(places[-1]), 10, np.uint8)
            begin = places - size
            joined[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = gather(
                data, start[tight], size
            )
            ids = self._encode(joined.tobytes().decode())
            reach = np.cumsum(self.sizes[ids])
            last = np.searchsorted(reach, places) + 1
            count = np.diff(last, prepend=0)
            lengths[tight] = count - bare
            keep = np.ones(len(ids), bool)
            keep[(last - count)[bare]] = False
            parts.append(ids[keep])
        order = np.concatenate([np.flatnonzero(loose), tight])
        first = len(self.pool) + np.cumsum(lengths[order]) - lengths[order]
        begin = np.empty(len(start), np.int64)
        begin[order] = first
        self.pool = np.concatenate([self.pool, *parts])
        known = np.concatenate([self.known, hashes])
        sort = np.argsort(known, kind="stable")
        self.known = known[sort]
        self.start = np.concatenate([self.start, begin])[sort]
        self.length = np.concatenate([self.length, lengths])[sort]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, one row after the other, and the rows' bounds in them."""
        spans = self._chunks(data, offsets)
        distinct, first, which = np.unique(span_hashes(data, spans, fold=False), return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self._reset()
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        new = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            self._learn(data, distinct[new], spans.start[first[new]], spans.end[first[new]])
        at = np.searchsorted(self.known, distinct)
        start, length = self.start[at][which], self.length[at][which]
        ids = gather(self.pool, start, length)
        counts = reduce_rows(np.add, length, spans.bounds, 0)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        wide = np.flatnonzero(self._wide_space(data, offsets))
        if len(wide):
            rows = [ids[bounds[r] : bounds[r + 1]] for r in range(len(counts))]
            for r in wide:
                rows[r] = self._encode(data[offsets[r] : offsets[r + 1]].tobytes().decode())
            bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            ids = np.concatenate(rows)
        return ids, bounds


def piece_ranges(n_tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: all full but the first, which takes the remainder."""
    rest = n_tokens % capacity
    pieces = [(0, rest)] if rest else []
    return pieces + [(start, capacity) for start in range(rest, n_tokens, capacity)]


def token_pieces(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    eos: int = EOS,
    ranks: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """The documents' tokens (ids, then `eos`), cut to pieces of at most `capacity`.

    Returns doc_id, piece, start, length, ids_crc32 and, if asked for, the ids. A null
    text is an empty one, whose only token is `eos`. `ranks` is the vocabulary's path.
    """
    ranks = ranks or default_ranks()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenise = Tokeniser(ranks)
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(1)):
                ids, bounds = tokenise(data, offsets)
                rows, piece, start, length, crc, tokens = [], [], [], [], [], []
                for row in range(high - low):
                    own = np.append(ids[bounds[row] : bounds[row + 1]], np.uint32(eos)).astype("<u4")
                    for k, (begin, size) in enumerate(piece_ranges(len(own), capacity)):
                        rows.append(row)
                        piece.append(k)
                        start.append(begin)
                        length.append(size)
                        crc.append(zlib.crc32(own[begin : begin + size]))
                        if with_ids:
                            tokens.append(own[begin : begin + size].astype(np.int32))
                columns = [
                    batch.column(0).slice(low, high - low).take(pa.array(rows, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(tokens, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        free_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        cut, PIECES.format(kind) + (", ids array<int>" if with_ids else "")
    )


# --- plan ---------------------------------------------------------------------------------------------------------


def reduce_dominated(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Takes out of `counts` (pieces by length) the sets that dominate every other set with the same piece.

    A set with piece w dominates another if the other's pieces, w apart, can be dealt
    to pieces of the first that are at least as long as what they are dealt. So, with
    r = capacity - w the room beside w and j the longest piece that fits into r:
    {w} if nothing fits; {w, j} if j fills r, or no two pieces fit into r, or at most
    two do and no pair is longer than j; {w, j, b}, with b the longest that fits beside
    j, if at most two fit into r and of each pair that fits the shorter is at most b.
    Each stays right as pieces are taken away, so equal sets are fixed together.
    Returns (how often, set).
    """
    fixed: list[tuple[int, tuple[int, ...]]] = []

    def smallest(but: int, over: int = 0, n: int = 3) -> list[int]:
        found: list[int] = []
        for size in range(over + 1, capacity + 1):
            found += [size] * min(n - len(found), counts.get(size, 0) - (size == but))
            if len(found) == n:
                break
        return found

    def fitting(room: int, *but: int) -> int:
        return next((s for s in range(room, 0, -1) if counts.get(s, 0) > but.count(s)), 0)

    def best_pair(room: int, but: int) -> int:
        best = 0
        for long in range(room - 1, 0, -1):
            if counts.get(long, 0) > (long == but) and (short := fitting(min(long, room - long), but, long)):
                best = max(best, long + short)
        return best

    def fix(*pieces: int) -> None:
        times = min(counts[p] // pieces.count(p) for p in pieces)
        for p in pieces:
            counts[p] -= times
        fixed.append((times, pieces))

    for w in range(capacity, 0, -1):
        while counts.get(w, 0) > 0:
            room = capacity - w
            small = smallest(w)
            if not small or small[0] > room:
                fix(w)
                continue
            j = fitting(room, w)
            if j == room or sum(small[:2]) > room or len(small) < 2:
                fix(w, j)
                continue
            if len(small) == 3 and sum(small) <= room:
                break
            if best_pair(room, w) <= j:
                fix(w, j)
                continue
            b = fitting(room - j, w, j)
            longer = smallest(w, over=b, n=2)
            if b and (len(longer) < 2 or sum(longer) > room):
                fix(w, j, b)
                continue
            break
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing. Bins with equal contents are kept together, so a length takes a few steps."""
    bins: dict[int, list[list]] = defaultdict(list)  # by room left: [how many, contents]
    for size in sorted((s for s, n in counts.items() if n > 0), reverse=True):
        left = counts[size]
        while left:
            room = next((r for r in range(size, capacity + 1) if bins.get(r)), 0)
            group = bins[room][-1] if room else [left, ()]
            room = room or capacity
            each = room // size
            times = min(group[0], left // each)
            if not times:
                times, each = 1, left
            contents = (*group[1], *[size] * each)
            if group[1]:
                group[0] -= times
                if not group[0]:
                    bins[room].pop()
            bins[room - each * size].append([times, contents])
            left -= times * each
    return [(n, contents) for groups in bins.values() for n, contents in groups]


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first_rank, n_ranks, in_each, first_sequence, offset).

    Ranks first_rank .. first_rank + n_ranks - 1 of this length go, `in_each` at a time,
    to successive sequences, where the first of them stands at `offset`.
    """
    counts = dict(counts)
    sets = reduce_dominated(counts, capacity) + best_fit(counts, capacity)
    rows, used, sequence = [], defaultdict(int), 0
    for times, contents in sets:
        offset = 0
        for size in sorted(set(contents), reverse=True):
            each = contents.count(size)
            rows.append((size, used[size], times * each, each, sequence, offset))
            used[size] += times * each
            offset += each * size
        sequence += times
    return rows


def pack_pieces(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` with sequence_id and offset: where each goes. See token_pieces for the columns.

    Only the histogram of lengths (at most `capacity` rows) comes to the driver. Rows
    that repeat id and piece are placed as pieces of their own; ties in the rank's
    order are between such rows. An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    pieces = cut_lineage(pieces.withColumn("bin", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BINS)).cast("int")))
    bins = cut_lineage(pieces.groupBy("length", "bin").agg(F.count(F.lit(1)).alias("n")))
    histogram = {row["length"]: row["n"] for row in bins.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(
        packing_plan(histogram, capacity),
        "length long, first_rank long, n_ranks long, in_each long, first_sequence long, first_offset long",
    )
    before = W.partitionBy("length").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    starts = bins.select("length", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("bin_start"))
    within = W.partitionBy("length", "bin").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.join(starts, ["length", "bin"]).withColumn("rank", F.col("bin_start") + F.row_number().over(within) - 1)
    step = F.col("rank") - F.col("first_rank")
    reached = (F.col("rank") >= F.col("first_rank")) & (step < F.col("n_ranks"))
    placed = ranked.alias("p").join(F.broadcast(plan).alias("q"), (F.col("p.length") == F.col("q.length")) & reached)
    return placed.select(
        *[F.col(f"p.{c}") for c in pieces.columns if c != "bin"],
        (F.col("first_sequence") + F.floor(step / F.col("in_each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + step % F.col("in_each") * F.col("p.length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Tokenises, cuts and packs whole documents (see token_pieces and pack_pieces)."""
    pieces = token_pieces(docs, id_col=id_col, text_col=text_col, **options)
    return pack_pieces(pieces, capacity=options.get("capacity", CAPACITY))
