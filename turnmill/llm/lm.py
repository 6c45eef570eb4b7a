"""Language-model scores from a lattice of subwords.

The pieces of an existing subword vocabulary span a lattice over each word. A
word starts with a piece that marks a word's start, goes on with others and
stops; characters without a piece are spelt in byte pieces. Pieces have unigram
probabilities, which are a softmax of the vocabulary's own scores over a temperature.
That one number, and how often words go on, are fitted on the training texts, in
`ROUNDS` of forward-backward counts over all segmentations. As an option the counts
themselves become the pieces' probabilities, but for a share `OWN`. A
forward recursion in log space sums all segmentations of a word, and is divided
by the lattice's mass on words, so that all words sum to one.

With `whole_words`, a word that training texts have keeps what it has there, less a
discount, and the lattice, fitted on words that occur once, spells what the
discounts leave: seen and unseen words together sum to one.

Pieces don't cross words: a text's marginal log-probability is the sum over its
tokens, and each distinct word is worked out once, in a word table made by a
shuffle. The recursion runs over many words at once, padded to like lengths.
The most frequent words, at most `HEAD`, are broadcast; occurrences of all
others join the table.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import Shelf
from turnmill.llm.words import free_memory, lists, mix, reduce_rows, slices, span_hashes, span_strings, word_spans

#: Most words in the broadcast table: 28 bytes each.
HEAD = 400_000
#: Distinct words that a task holds before it passes its counts on.
HOLD = 300_000
#: Share of the pieces' probability that the vocabulary's own scores keep if counts re-estimate the pieces.
OWN = 0.1
#: How often the pieces' counts are worked out anew.
ROUNDS = 2
#: Words whose lattices a task works out together, and cells (positions times pieces that may end there) of one step.
GATHER, CELLS = 30_000, 1 << 20
#: Characters of a word that are worked out at once.
STRETCH = 2048
MARK = "▁"
#: What no word holds: ASCII white space, and the letters that are folded.
NOT_IN_WORDS = frozenset(" \t\n\v\f\r" + string.ascii_uppercase)
LN10 = math.log(10)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=1)
def _vocabulary(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


class Pieces:
    """Looks up many strings of code points: `find` gives each hash's place among the strings, or -1."""

    def __init__(self, names: list[str], ids: list[int]):
        hashes = np.array([self.name_hash(x) for x in names], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(ids, np.int32)[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes >> np.uint64(44)] = True

    @staticmethod
    def name_hash(name: str) -> int:
        codes = np.frombuffer(name.encode("utf-32-le"), np.uint32).astype(np.uint64)
        return int(mix((mix(codes + np.uint64(1)) * _powers(_STEP, len(codes) + 1)[:-1]).sum(keepdims=True))[0])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(hashes.shape, -1, np.int32)
        some = np.nonzero(self.maybe[hashes >> np.uint64(44)])
        wanted = hashes[some]
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        out[some] = np.where(self.hashes[at] == wanted, self.ids[at], -1)
        return out


def fitted_temperature(scores: np.ndarray, groups: list[np.ndarray], counts: np.ndarray) -> float:
    """The temperature at which softmaxes of `scores`, one for each of the `groups`, make `counts` most likely.

    With b = 1 / temperature the likelihood is concave; its slope is what was counted less what is expected.
    """
    wanted = sum(float(counts[g] @ scores[g]) for g in groups)

    def slope(b: float) -> float:
        expected = 0.0
        for g in groups:
            weight = np.exp(b * (scores[g] - scores[g].max()))
            expected += counts[g].sum() * float(weight @ scores[g]) / weight.sum()
        return wanted - expected

    low, high = 1e-3, 1e3
    for _ in range(100):
        middle = math.sqrt(low * high)
        low, high = (middle, high) if slope(middle) > 0 else (low, middle)
    return 1 / math.sqrt(low * high)


class Lattice:
    """log-probabilities of words under the pieces' unigram model. `counts` are the pieces' counts in training texts and
    `stops` the number of words there: they set the temperature of the vocabulary's scores and the chance that a word
    stops. `own` is the share of the scores in the pieces' probabilities; the rest is in proportion to the counts."""

    def __init__(self, path: str, counts: np.ndarray | None = None, stops: float = 0.0, own: float = 1.0):
        model = _vocabulary(path)
        size = model.get_piece_size()
        usable = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i))]
        names = {i: model.id_to_piece(i) for i in usable}
        starts = np.zeros(size, bool)
        starts[[i for i in usable if names[i].startswith(MARK)]] = True
        inner = np.zeros(size, bool)
        inner[usable] = True
        inner &= ~starts
        # The file's scores are merge ranks; as log-probabilities by Zipf's law, up to the temperature.
        rank = np.argsort(np.argsort([-model.get_score(i) for i in range(size)], kind="stable"), kind="stable")
        scores = -np.log(rank + 2.7)
        self.temperature = 1.0 if counts is None else fitted_temperature(scores, [np.flatnonzero(g) for g in (starts, inner)], counts)
        counts = np.zeros(size) if counts is None else counts
        going_on = counts[inner].sum()
        stop = (stops + 1) / (stops + going_on + 2)
        log = np.full(size, -np.inf)
        for group, scale in ((starts, 1.0), (inner, 1 - stop)):
            seen = counts[group].sum()
            scored = scores[group] / self.temperature  # in logs: at a low temperature the least would be 0
            scored -= scored.max() + np.log(np.exp(scored - scored.max()).sum())
            if seen and own < 1:
                with np.errstate(divide="ignore"):
                    scored = np.logaddexp(math.log(own) + scored, np.log((1 - own) * counts[group] / seen))
            log[group] = math.log(scale) + scored
        self.size, self.log, self.stop = size, log, math.log(stop)
        byte_ids = {int(names[i][1:-1], 16): i for i in usable if model.is_byte(i)}
        later = [i for i in usable if inner[i] and not model.is_byte(i)]
        self.first = {names[i][len(MARK) :]: log[i] for i in usable if starts[i]}
        self.later = {names[i]: log[i] for i in later}
        self.byte_ids = np.array([byte_ids[b] for b in range(256)])
        self.bytes = log[self.byte_ids].tolist()
        self.longest = max(map(len, [*self.first, *self.later]))
        self.bare = next((i for i in usable if names[i] == MARK), -1)
        self.first_pieces = Pieces([names[i][len(MARK) :] for i in usable if starts[i]], [i for i in usable if starts[i]])
        self.later_pieces = Pieces([names[i] for i in later], later)
        self.log_mass = self._log_mass()

    def _log_mass(self) -> float:
        """log of the share of all that the lattice generates that are words: not empty, of characters that words hold."""
        first = sum(math.exp(p) for x, p in self.first.items() if NOT_IN_WORDS.isdisjoint(x))
        later = sum(math.exp(p) for x, p in self.later.items() if NOT_IN_WORDS.isdisjoint(x))
        b, c = np.exp(self.bytes), np.arange(0x110000)
        spelt = np.select(
            [c < 0x80, c < 0x800, c < 0x10000],
            [
                b[c & 0x7F],
                b[0xC0 | c >> 6 & 0x1F] * b[0x80 | c & 0x3F],
                b[0xE0 | c >> 12 & 0xF] * b[0x80 | c >> 6 & 0x3F] * b[0x80 | c & 0x3F],
            ],
            b[0xF0 | c >> 18] * b[0x80 | c >> 12 & 0x3F] * b[0x80 | c >> 6 & 0x3F] * b[0x80 | c & 0x3F],
        )
        spelt[0xD800:0xE000] = 0  # surrogates
        spelt[[ord(x) for x in {*NOT_IN_WORDS, *self.later} if len(x) == 1]] = 0
        return self.stop + math.log(first / (1 - later - spelt.sum()) - math.exp(self.first.get("", -math.inf)))

    def log_probability(self, words: list[str], n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """The words' log-probabilities, all segmentations summed; and, if the words' frequencies `n` are given, how
        often each piece is used in them, all segmentations weighed by their probability."""
        length = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        begin = np.cumsum(length) - length
        out = np.empty(len(words))
        used = None if n is None else np.zeros(self.size)
        order = np.argsort(length, kind="stable")
        grade = np.ceil(np.log2(np.maximum(length[order], 4)) * 2)  # lengths within a factor of 1.4 go together
        edges = np.flatnonzero(np.diff(grade, prepend=-1, append=-1))
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            width = int(length[order[high - 1]])
            step = max(CELLS // (width * self.longest), 1)
            for at in range(low, high, step):
                rows = order[at : min(at + step, high)]
                padded = np.zeros((len(rows), width), np.uint32)
                inside = np.arange(width) < length[rows, None]
                padded[inside] = codes[np.repeat(begin[rows], length[rows]) + np.nonzero(inside)[1]]
                out[rows] = self._forward(padded, length[rows], None if n is None else n[rows], used)
        return out, used

    def _arcs(self, padded: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that end at the positions low + 1 .. high: by position, word and length (from the longest down), and
        those that start the word there; -1 where there is none."""
        rows, most = len(padded), self.longest
        begin = max(low - most, 0)
        sums = np.zeros((rows, high - begin + 1), np.uint64)
        sums[:, 1:] = np.cumsum(mix(padded[:, begin:high].astype(np.uint64) + np.uint64(1)) * _powers(_STEP, high - begin), axis=1)
        back = _powers(_BACK, high - begin + 1)
        later = np.full((high - low, rows, most), -1, np.int32)
        for size in range(1, min(most, high) + 1):
            start = np.arange(max(low + 1, size), high + 1) - size
            ends = sums[:, start + size - begin]
            later[start + size - 1 - low, :, most - size] = self.later_pieces.find(mix((ends - sums[:, start - begin]) * back[start - begin])).T
        first = np.full((high - low, rows), -1, np.int32)
        if low < most:
            upto = min(high, most)
            first[: upto - low] = self.first_pieces.find(mix(sums[:, low + 1 : upto + 1])).T
        return later, first

    def _spelt(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log-probability of characters spelt in bytes; and the bytes' pieces, -1 beyond the last."""
        c = codes[:, None].astype(np.int64)
        size = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        k = np.arange(4)
        tail = 0x80 | (c >> 6 * np.maximum(size - 1 - k, 0) & 0x3F)
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size] | c >> 6 * (size - 1)
        ids = np.where(k < size, self.byte_ids[np.where(k == 0, lead, tail)], -1)
        return np.where(ids < 0, 0, self.log[ids]).sum(1), ids

    def _forward(self, padded: np.ndarray, length: np.ndarray, n: np.ndarray | None, used: np.ndarray | None) -> np.ndarray:
        """Forward recursion: alpha[j] is the log of the sum over all ways to segment the first j characters."""
        rows, width = padded.shape
        most = self.longest
        log = np.append(self.log, -np.inf)  # the last one is for -1
        alpha = np.full((width + 1 + most, rows), -np.inf)  # position j is in row j + most
        alpha[most] = log[self.bare]
        kept = []
        for low in range(0, width, STRETCH):
            high = min(low + STRETCH, width)
            later, first = self._arcs(padded, low, high)
            single = later[:, :, most - 1] < 0
            spelt = np.full(single.shape, -np.inf)
            spelt[single], _ = self._spelt(padded[:, low:high].T[single])
            weight, start = log[later], log[first]
            weight[:, :, most - 1] = np.where(single, spelt, weight[:, :, most - 1])
            for j in range(low + 1, high + 1):
                arriving = weight[j - low - 1] + alpha[j : j + most].T
                top = np.maximum(arriving.max(1), start[j - low - 1])
                safe = np.where(np.isfinite(top), top, 0)
                total = np.exp(arriving - safe[:, None]).sum(1) + np.exp(start[j - low - 1] - safe)
                with np.errstate(divide="ignore"):
                    alpha[j + most] = safe + np.log(total)
            if n is not None:
                kept.append((low, high))
        whole = alpha[length + most, np.arange(rows)]
        if n is not None:
            self._backward(padded, length, n, used, alpha, whole, kept)
        return whole + self.stop

    def _backward(self, padded, length, n, used, alpha, whole, stretches) -> None:
        """Adds to `used` what each piece is used, from the end back: beta[j] sums all ways to segment what follows j."""
        rows, width = padded.shape
        most = self.longest
        log = np.append(self.log, -np.inf)
        beta = np.full((width + 1, rows), -np.inf)
        beta[length, np.arange(rows)] = 0
        share = np.log(np.maximum(n, 1e-300)) - whole
        total = np.zeros(self.size + 1)  # the last one is for -1
        for low, high in reversed(stretches):
            later, first = self._arcs(padded, low, high)
            single = later[:, :, most - 1] < 0
            weight, start = log[later], log[first]
            weight[:, :, most - 1][single], spelt_ids = self._spelt(padded[:, low:high].T[single])
            uses = np.zeros_like(weight)
            for j in range(high, low, -1):
                there = beta[j]
                arcs = weight[j - low - 1] + there[:, None]
                reach = min(most, j)  # arcs that start before the word have no weight
                own = beta[j - reach : j]
                own[:] = np.logaddexp(own, arcs[:, most - reach :].T)
                uses[j - low - 1] = np.exp(arcs + alpha[j : j + most].T + share[:, None])
            spelt = uses[:, :, most - 1][single]
            begun = np.exp(start + beta[low + 1 : high + 1] + share)
            for ids, times in ((later, uses), (first, begun), (spelt_ids, np.repeat(spelt, spelt_ids.shape[1]))):
                total += np.bincount(np.where(ids < 0, self.size, ids).ravel(), times.ravel(), self.size + 1)
        used += total[: self.size]
        if self.bare >= 0:
            used[self.bare] += np.exp(log[self.bare] + beta[0] + share).sum()


def word_table(texts: DataFrame) -> DataFrame:
    """(hash, size, word, n) of all words in `texts` (text, training): n counts those where `training` holds, so it may be 0.

    `size` is the word's length in bytes. Tasks add up their own counts before the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, pa.Array]:
            hashes, first, which = np.unique(np.concatenate([h for h, _, _ in held]), return_index=True, return_inverse=True)
            n = np.bincount(which, np.concatenate([n for _, n, _ in held])).astype(np.int64)
            return hashes, n, pa.concat_arrays([w for _, _, w in held]).take(pa.array(first))

        def out(hashes, n, names) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), names, pa.array(n)], ["hash", "word", "n"])

        for batch in batches:
            training = np.array(batch.column(1).to_pylist(), bool)
            for low, high, data, offsets in slices(batch.column(0)):
                spans = word_spans(data, offsets)
                hashes, first, which = np.unique(span_hashes(data, spans), return_index=True, return_inverse=True)
                n = np.bincount(which, np.repeat(training[low:high], spans.counts), len(hashes))
                held.append((hashes, n, span_strings(data, spans.start[first], spans.end[first])))
                if sum(len(h) for h, _, _ in held) > HOLD:
                    held = [merged()]
                    if len(held[0][0]) > HOLD // 2:
                        yield out(*held[0])
                        held = []
        if held:
            yield out(*merged())
        free_memory()

    counted = texts.select("text", "training").mapInArrow(count, "hash long, word string, n long")
    counted = counted.groupBy("hash", "word").agg(F.sum("n").alias("n"))
    return counted.select("hash", F.octet_length("word").alias("size"), "word", "n")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in larger lots, so that a step of the recursion has many words."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(len(b) for b in held) >= GATHER:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def piece_counts(table: DataFrame, lattice: Broadcast) -> np.ndarray:
    """How often the words of `table` (word, n) use each piece of the lattice, all segmentations weighed by their probability."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice.value
        total = np.zeros(own.size)
        for lot in _gathered(batches):
            total += own.log_probability(lot.column(0).to_pylist(), lot.column(1).to_numpy().astype(np.float64))[1]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["piece", "n"])
        free_memory()

    found = table.select("word", "n").mapInArrow(count, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = np.zeros(lattice.value.size)
    for row in found.collect():  # at most one row for each piece of the vocabulary
        counts[row["piece"]] = row["n"]
    return counts


def head_threshold(table: DataFrame, most: int) -> int:
    """A count that at most `most` words reach; found from a histogram of the counts' logarithms."""
    grade = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    grades = table.where("n > 0").groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least"))
    total, threshold = 0, None
    for row in sorted(grades.collect(), key=lambda r: -r["grade"]):
        total += row["words"]
        if total > most:
            break
        threshold = row["least"]
    return threshold if threshold is not None else (1 << 62)


def lattice_scores(
    docs: DataFrame,
    training: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    head: int = HEAD,
    rounds: int = ROUNDS,
    reestimate: bool = False,
    whole_words: bool = False,
) -> DataFrame:
    """Scores every text of `docs` after learning from the rows where the column `training` holds.

    Returns doc_id, training, n_tokens (words and one end), n_known (tokens that occur
    in training), train_tokens, base_score (unigrams with 0.5 added to each count) and
    score (the lattice's marginal probability of the text), both log10. A null text is an
    empty one, just an end; ids may be null or repeat and are passed on. Without training
    rows base_score is 0 and the vocabulary's own scores, at temperature 1, are the lattice's.
    `reestimate` lets the training texts' counts set the pieces' probabilities. `whole_words` gives
    each training word its count less a discount (Ney's, from how many words occur once and twice), and
    leaves the rest to the lattice, which then learns from the words that occur once. Rows that repeat
    are scored one by one; an empty table gives an empty table; other columns are ignored.
    Words are told apart by a 64-bit hash and their length.
    """
    path = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    shelf, result = Shelf(spark), Shelf(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), training.alias("training"))
    table = shelf.put(word_table(texts))
    sums = table.agg(F.coalesce(F.sum("n"), F.lit(0)), *[F.count_if(x) for x in (F.col("n") > 0, F.col("n") == 1, F.col("n") == 2)]).first()
    ends = texts.where("training").count()
    tokens, types = sums[0] + ends, sums[1] + (ends > 0)
    end_share = (ends + 1) / (tokens + 2)
    scale = tokens + 0.5 * (types + 1)
    lattice = shelf.broadcast(Lattice(path))
    once = whole_words and sums[2] > 0  # words that occur once are most like words that don't
    learnt, stops = (table.where("n = 1"), sums[2]) if once else (table.where("n > 0"), sums[0])
    for _ in range(rounds if sums[0] else 0):
        lattice = shelf.broadcast(Lattice(path, piece_counts(learnt, lattice), float(stops), OWN if reestimate else 1.0))
    discount = min(max(sums[2] / (sums[2] + 2 * sums[3]), 0.1), 0.9) if sums[2] else 0.5

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice.value
        for lot in _gathered(batches):
            spelt = (own.log_probability(lot.column(2).to_pylist())[0] - own.log_mass) / LN10
            lot = lot.combine_chunks()
            columns = [lot.column(c).combine_chunks() for c in (0, 1, 3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spelt)], ["hash", "size", "n", "spelt"])
        free_memory()

    spelt = result.put(table.mapInArrow(spell, "hash long, size int, n long, spelt double"))
    word = F.col("spelt")
    if whole_words and sums[0]:
        left = discount * sums[1] / sums[0]
        seen = F.log10((F.col("n") - discount) / F.lit(float(sums[0])) + F.pow(F.lit(10.0), word) * left)
        word = F.when(F.col("n") > 0, seen).otherwise(word + math.log10(left))
    scored = spelt.select(
        "hash",
        "size",
        "n",
        (F.col("n") > 0).alias("known"),
        F.log10((F.col("n") + 0.5) / F.lit(scale)).alias("base"),
        (word + F.lit(math.log10(1 - end_share))).alias("model"),
    )
    least = head_threshold(table, head)
    top = scored.where(F.col("n") >= least).select("hash", "size", "base", "model").toArrow()  # at most `head` rows
    keys = top.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    columns = [top.column(c).to_numpy()[order] for c in ("size", "base", "model")]
    frequent = shelf.broadcast((keys[order], *columns))
    end_base = math.log10((ends + 0.5) / scale)
    end_model = math.log10(end_share)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_size, known_base, known_model = frequent.value
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(1)):
                spans = word_spans(data, offsets)
                hashes, size = span_hashes(data, spans), (spans.end - spans.start).astype(np.int32)
                at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                hit = (known[at] == hashes) & (known_size[at] == size) if len(known) else np.zeros(len(hashes), bool)
                sums = [reduce_rows(np.add, hit.astype(np.int64), spans.bounds, 0)]
                for values in (known_base, known_model):
                    own = np.zeros(len(hashes))
                    own[hit] = values[at[hit]]
                    sums.append(reduce_rows(np.add, own, spans.bounds, 0.0))
                rows, rest, size = spans.rows[~hit], hashes[~hit], size[~hit]
                sort = np.lexsort((size, rest, rows))
                rows, rest, size = rows[sort], rest[sort], size[sort]
                fresh = np.ones(len(rest), bool)
                fresh[1:] = (rest[1:] != rest[:-1]) | (rows[1:] != rows[:-1]) | (size[1:] != size[:-1])
                first = np.flatnonzero(fresh)
                times = np.diff(first, append=len(rest))
                bounds = np.searchsorted(rows[first], np.arange(high - low + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low),
                        batch.column(2).slice(low, high - low),
                        pa.array(spans.counts.astype(np.int64)),
                        *map(pa.array, sums),
                        lists(rest[first].view(np.int64), bounds, pa.int64()),
                        lists(size[first], bounds, pa.int32()),
                        lists(times, bounds, pa.int32()),
                    ],
                    ["doc_id", "training", "words", "known", "base", "model", "rare", "sizes", "times"],
                )
        free_memory()

    kind = texts.schema["doc_id"].dataType.simpleString()
    looked_up = texts.mapInArrow(
        look_up,
        f"doc_id {kind}, training boolean, words long, known long, base double, model double, "
        "rare array<long>, sizes array<int>, times array<int>",
    )
    # The row numbers hold from here on: they are read from what is saved.
    rows = result.put(looked_up.withColumn("row", F.monotonically_increasing_id()))
    shelf.clear()
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "sizes", "times")).alias("x")).select(
        "row", F.col("x.rare").alias("hash"), F.col("x.sizes").alias("size"), F.col("x.times").alias("times")
    )
    # One row for each key, should two words ever share it.
    others = scored.where(F.col("n") < least).groupBy("hash", "size").agg(*[F.max(c).alias(c) for c in ("known", "base", "model")])
    parts = (
        rare.join(others, ["hash", "size"])
        .groupBy("row")
        .agg(
            F.sum(F.col("known").cast("long") * F.col("times")).alias("more_known"),
            F.sum(F.col("base") * F.col("times")).alias("more_base"),
            F.sum(F.col("model") * F.col("times")).alias("more_model"),
        )
    )
    zero = F.lit(0)
    return rows.drop("rare", "sizes", "times").join(parts, "row", "left").select(
        "doc_id",
        "training",
        (F.col("words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", zero) + int(ends > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero) + F.lit(end_base)).alias("base_score"),
        (F.col("model") + F.coalesce("more_model", zero) + F.lit(end_model)).alias("score"),
    )
