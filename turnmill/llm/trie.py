"""Prefix trie of conversations, by an external mergesort whose runs carry common prefix lengths.

A conversation is a string of turns, each a digest of fixed size. Tasks sort lots of
conversations into runs and note how many turns each shares with the one before
(its LCP). Runs are dealt to ranges of the order, and each range merges its stretches
of all runs with a loser tree: of two heads, the one that shares more turns with the
last output comes first, and only equal LCPs need turns to be compared, from there on.
The merged stream opens and closes nodes on a stack that holds the current path; a
node is finished when the next conversation leaves it.

Nodes on the path of a range's first or last conversation may go on in other ranges.
Their counts are sums over ranges once what two neighbours both counted is taken off,
which follows from the LCP of the one's last and the other's first conversation. So
no group of equal conversations, and no node, has to fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import Shelf, sized
from turnmill.llm.words import free_memory

#: Bytes of a turn: 16 of a digest, 4 of its text's length in code points.
WIDTH = 20
#: A run has at most so many conversations and bytes; a range is meant to have so many bytes.
RUN_ROWS, RUN_BYTES, RANGE_BYTES = 100_000, 64 << 20, 16 << 20
#: Ids in a row of text for hashing.
CHUNK = 10_000


def turn_sequences(turns: DataFrame, *, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as hex strings of a digest of role and text and the text's length.

    Null positions come first, equal ones in the order of their digests. Null roles and texts are empty; rows without
    a conversation's id are no conversation's and go.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), F.lit(32))
    symbol = F.concat(digest, F.lpad(F.lower(F.hex(F.char_length(text))), 8, "0"))
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.struct(F.col(order_col).alias("at"), symbol.alias("s")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t"))["s"].alias("turns"))


def with_shared_heads(sequences: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Conversations that begin alike: of conversation c, the first h turns (h = crc32 of c in decimals, modulo `most`) become
    those of conversation c - c % every, as far as there are any."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = sequences.withColumn("base", F.col("conv_id") - F.col("conv_id") % every)
    heads = sequences.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), h)
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def common_turns(a: bytes, b: bytes, at: int = 0) -> int:
    """How many turns both begin with; the first `at` are known to be the same."""
    n = min(len(a), len(b)) // WIDTH
    if a[at * WIDTH : n * WIDTH] == b[at * WIDTH : n * WIDTH]:
        return n
    while a[at * WIDTH : (at + 1) * WIDTH] == b[at * WIDTH : (at + 1) * WIDTH]:
        at += 1
    return at


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, seq) as runs: run, place in it, lcp with the row before, conv_id, seq."""
    task, number = TaskContext.get().partitionId(), 0
    held: list[tuple[bytes, int]] = []
    size = 0

    def run() -> Iterator[pa.RecordBatch]:
        held.sort()
        lcp = [0] + [common_turns(a[0], b[0]) for a, b in zip(held, held[1:])]
        for low in range(0, len(held), 1000):
            part = held[low : low + 1000]
            name = pa.array([task << 32 | number] * len(part), pa.int64())
            place = pa.array(range(low, low + len(part)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [name, place, pa.array(lcp[low : low + 1000], pa.int32()), pa.array([c for _, c in part], pa.int64()), pa.array([s for s, _ in part], pa.binary())],
                ["run", "place", "lcp", "conv_id", "seq"],
            )

    for batch in batches:
        held += zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True)
        size += batch.nbytes
        if len(held) >= RUN_ROWS or size >= RUN_BYTES:
            yield from run()
            held, size, number = [], 0, number + 1
    if held:
        yield from run()
    free_memory()


class LoserTree:
    """Merges sorted runs of (seq, conv_id) that carry LCPs. Each run's head has its LCP with the last output; a loser keeps
    the one with the head that beat it."""

    def __init__(self, runs: list[list[tuple[bytes, int, int]]]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.lcp = [0] * self.k
        self.losers = [-1] * self.k
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            winners[node], self.losers[node] = self._play(winners[2 * node], winners[2 * node + 1])
        self.top = winners[1] if self.k > 1 else 0

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        if self.at[a] >= len(self.runs[a]):
            return b, a
        if self.at[b] >= len(self.runs[b]):
            return a, b
        if self.lcp[a] != self.lcp[b]:
            return (a, b) if self.lcp[a] > self.lcp[b] else (b, a)
        (x, c, _), (y, d, _) = self.runs[a][self.at[a]], self.runs[b][self.at[b]]
        shared = common_turns(x, y, self.lcp[a])
        if (x[shared * WIDTH : (shared + 1) * WIDTH], c) > (y[shared * WIDTH : (shared + 1) * WIDTH], d):
            a, b = b, a
        self.lcp[b] = shared
        return a, b

    def __iter__(self) -> Iterator[tuple[bytes, int, int]]:
        """(seq, conv_id, LCP with the one before) in order."""
        while self.k and self.at[self.top] < len(self.runs[self.top]):
            top = self.top
            seq, conv, _ = self.runs[top][self.at[top]]
            yield seq, conv, self.lcp[top]
            self.at[top] += 1
            if self.at[top] < len(self.runs[top]):
                self.lcp[top] = self.runs[top][self.at[top]][2]
            node = (top + self.k) // 2
            while node:
                top, self.losers[node] = self._play(top, self.losers[node])
                node //= 2
            self.top = top


class Node:
    """An open node: what its members in this range give so far."""

    __slots__ = ("first", "size", "conv", "n", "children", "leaves", "used", "distinct", "ends", "below")

    def __init__(self, first: bool, size: int):
        self.first, self.size = first, size
        self.conv, self.n, self.children, self.leaves, self.used, self.distinct = 1 << 63, 0, 0, 0, 0, 0
        self.ends: list[int] = []
        self.below: list[int] = []


_KINDS = {
    "kind": "string", "range": "int", "key": "binary", "parent_key": "binary", "parent": "long", "conv_id": "long", "depth": "int", "n_convs": "long",
    "n_children": "long", "n_leaves": "long", "saved": "long", "before": "long", "first": "boolean", "last": "boolean", "ends": "string", "seq": "binary", "seq2": "binary",
}
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _sizes(seq: bytes) -> list[int]:
    return [int.from_bytes(seq[i - 4 : i]) for i in range(WIDTH, len(seq) + 1, WIDTH)]


def _keys(seq: bytes) -> list[bytes]:
    """A name for each of the sequence's beginnings, from the empty one on."""
    whole = hashlib.blake2b(digest_size=16)
    out = [whole.digest()]
    for i in range(0, len(seq), WIDTH):
        whole.update(seq[i : i + WIDTH])
        out.append(whole.copy().digest())
    return out


def range_nodes(merged: Iterator[tuple[bytes, int, int]], number: int) -> list[dict]:
    """Rows for a range's nodes: `done` ones, what the range adds to `open` ones (on its first or last path), `ends` of
    open ones as text, and the range's `edge` sequences."""
    rows: list[dict] = []
    path: list[Node] = []
    first: bytes | None = None
    last = b""

    def close(keys: list[bytes], before: list[int], at_end: bool) -> None:
        node = path.pop()
        depth = len(path)
        node.leaves += not node.children
        node.used += node.n * node.size
        node.distinct += node.size
        is_open = node.first or at_end
        row = {"conv_id": node.conv, "depth": depth, "n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved": node.used - node.distinct}
        for k in node.below:
            rows[k] |= {"parent_key": keys[depth]} if is_open else {"parent": node.conv}
        if is_open:
            row |= {"kind": "open", "range": number, "key": keys[depth], "parent_key": keys[depth - 1] if depth else None}
            row |= {"before": before[max(depth, 1) - 1], "first": node.first, "last": at_end}
            for low in range(0, len(node.ends), CHUNK):
                part = node.ends[low : low + CHUNK]
                rows.append({"kind": "ends", "key": keys[depth], "conv_id": part[0], "ends": ",".join(map(str, part))})
        else:
            row |= {"kind": "done", "ends": hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest()}
        rows.append(row)
        if path:
            up = path[-1]
            up.conv, up.n = min(up.conv, node.conv), up.n + node.n
            up.children, up.leaves = up.children + 1, up.leaves + node.leaves
            up.used, up.distinct = up.used + node.used, up.distinct + node.distinct
            if not is_open:
                up.below.append(len(rows) - 1)

    def running(seq: bytes) -> list[int]:
        out = [0]
        for size in _sizes(seq):
            out.append(out[-1] + size)
        return out

    keys: list[bytes] = []
    before: list[int] = []
    for seq, conv, shared in merged:
        if first is None:
            first, keys, before = seq, _keys(seq), running(seq)
            path.append(Node(True, 0))
        while len(path) > shared + 1:
            close(keys, before, False)
        for i in range(len(path) - 1, len(seq) // WIDTH):
            path.append(Node(seq is first, int.from_bytes(seq[(i + 1) * WIDTH - 4 : (i + 1) * WIDTH])))
        top = path[-1]
        top.conv, top.n = min(top.conv, conv), top.n + 1
        top.ends.append(conv)
        last = seq
    if first is not None:
        keys, before = _keys(last), running(last)
        while path:
            close(keys, before, True)
        rows.append({"kind": "edge", "range": number, "seq": first, "seq2": last})
    return rows


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's rows, run by run, as the rows that `range_nodes` gives."""
    runs: list[list[tuple[bytes, int, int]]] = []
    current = None
    for batch in batches:
        for run, lcp, conv, seq in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
            if run != current:
                runs.append([])
                current = run
            runs[-1].append((seq, conv, lcp))
    rows = range_nodes(iter(LoserTree(runs)), TaskContext.get().partitionId())
    for low in range(0, len(rows), 10_000):
        part = rows[low : low + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in part], _ARROW[k]) for c, k in _KINDS.items()], list(_KINDS))
    free_memory()


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges' edges in order, as: range, shared (turns that its first sequence shares with the last one before), upto (their
    code points), goes_on (whether the next range's first sequence begins with its last one, or is it)."""
    held: tuple[int, int, int] | None = None
    last = b""

    def out(number: int, shared: int, upto: int, goes_on: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"range": number, "shared": shared, "upto": upto, "goes_on": goes_on}], _EDGES)

    for batch in batches:
        for number, first, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            shared = common_turns(last, first) if held else -1
            if held:
                yield out(*held, shared * WIDTH == len(last))
            held, last = (number, shared, sum(_sizes(first[: max(shared, 0) * WIDTH]))), end
    if held:
        yield out(*held, False)


_EDGES = pa.schema([("range", pa.int32()), ("shared", pa.int32()), ("upto", pa.int64()), ("goes_on", pa.bool_())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends): SHA-256 of each key's texts, joined by commas; a key's rows come together and in order."""
    current, whole = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([whole.hexdigest()])], ["key", "ends"])

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key == current:
                whole.update(b",")
            else:
                if whole:
                    yield out()
                current, whole = key, hashlib.sha256()
            whole.update(text.encode())
    if whole:
        yield out()


def prefix_trie(sequences: DataFrame, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The trie of `sequences` (conv_id, turns; see turn_sequences): one row for each distinct beginning, the empty one included.

    Returns conv_id (the smallest member's), depth, parent_conv_id (the parent's conv_id, null for the root), n_convs
    (members), n_children, n_leaves (childless nodes in the subtree), saved_tokens (over the subtree, each node's members
    but one times its last text's code points) and ends_sha256 (of the ids of the members that end there, ascending,
    in decimals, joined by commas). A conversation without turns is a member of the root and ends there. Turns are
    told apart by 128 bits of a SHA-256 digest. No conversations give no nodes. A conversation's digests, 20 bytes a
    turn, lie in one row; everything else is split at any size.
    """
    spark = sequences.sparkSession
    shelf, result = Shelf(spark), Shelf(spark)
    seq = F.unhex(F.array_join("turns", "")).alias("seq")
    runs = shelf.put(sequences.select("conv_id", seq).mapInArrow(_sorted_runs, "run long, place int, lcp int, conv_id long, seq binary"))
    total = runs.agg(F.coalesce(F.sum(F.octet_length("seq") + 16), F.lit(0))).first()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes))
    dealt = runs.repartitionByRange(ranges, "seq", "conv_id").sortWithinPartitions("run", "place")
    found = result.put(dealt.mapInArrow(_merge, ", ".join(f"{c} {k}" for c, k in _KINDS.items())))
    ordered = found.where("kind = 'edge'").select("range", "seq", "seq2").repartition(1).sortWithinPartitions("range")
    edges = sized(shelf.put(ordered.mapInArrow(_neighbours, "range int, shared int, upto long, goes_on boolean")))

    def when(condition: Column, amount: Column) -> Column:
        return F.when(condition, amount).otherwise(F.lit(0))

    # What the range before has counted already; its `shared` is -1 for the first range.
    parts = found.where("kind = 'open'").join(edges, "range")
    again = F.col("first") & (F.col("depth") <= F.col("shared"))
    sums = {
        "n_convs": F.col("n_convs"),
        "n_children": F.col("n_children") - when(F.col("first") & (F.col("depth") < F.col("shared")), F.lit(1)),
        "n_leaves": F.col("n_leaves") - when(F.col("last") & F.col("goes_on"), F.lit(1)),
        "saved": F.col("saved") + when(again, F.col("upto") - F.col("before")),
    }
    open_nodes = shelf.put(
        parts.groupBy("key").agg(
            F.min("parent_key").alias("parent_key"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(v).alias(k) for k, v in sums.items()]
        )
    )
    texts = found.where("kind = 'ends'").select("key", "conv_id", "ends").repartition("key").sortWithinPartitions("key", "conv_id")
    hashes = shelf.put(texts.mapInArrow(_hashed, "key binary, ends string"))
    nodes = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    none = F.lit(hashlib.sha256(b"").hexdigest())
    over = open_nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("over"))
    joined = open_nodes.join(sized(hashes), "key", "left").withColumn("ends", F.coalesce("ends", none)).withColumn("parent", F.lit(None).cast("long"))
    rows = found.where("kind = 'done'").select("parent", "parent_key", *nodes).unionAll(joined.select("parent", "parent_key", *nodes))
    out = result.put(
        rows.join(sized(over), "parent_key", "left").select(
            "conv_id",
            F.col("depth").cast("long").alias("depth"),
            F.coalesce("parent", "over").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            F.col("saved").alias("saved_tokens"),
            F.col("ends").alias("ends_sha256"),
        )
    )
    shelf.clear()
    return out
