"""Secrets in texts, found by rules that one deterministic automaton holds.

All rules are compiled, backwards, into one automaton over bytes. One pass from a
batch's last byte to its first tells every place where a match of some rule begins.
From the first such place of a rule on, an automaton that reads forwards finds where
the match ends; the next match of that rule begins no earlier. So spans are leftmost,
longest and free of overlaps rule by rule, as a regular expression engine finds them,
while texts without secrets cost that one pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.automata import SEPARATOR, Dfa, compile_rules, longest, scan
from turnmill.llm.words import free_memory, slices


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what takes up text, and, if that isn't enough, what a match must be besides (`holds` ends where
    the match ends) and its least length."""

    kind: str
    pattern: str
    holds: str | None = None
    least: int = 0


_KEY = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_ANY_CASE = "(?i:%s)"
#: The rules that the query reports on by themselves.
BASE = (
    Rule("assign", _ANY_CASE % _KEY + r"[A-Za-z0-9+/_.=-]+", holds=_ANY_CASE % _KEY + r"[A-Za-z0-9+/_.=-]{6,}"),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further public forms: PEM headers of private keys, signed web tokens, tokens of code and chat hosts, passwords in addresses.
FURTHER = (
    Rule("private_key", r"-----BEGIN(?:\x20[A-Z]+)*\x20PRIVATE\x20KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("host_token", r"gh[opsur]_[A-Za-z0-9]+", least=40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("address", r"[a-z]+://[A-Za-z0-9._~%+-]+:[A-Za-z0-9._~%+!$-]+@"),
)
RULES = BASE + FURTHER


class Scanner:
    """`rules` compiled; `spans` finds them in many texts at once."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = list(rules)
        patterns = [r.pattern for r in self.rules]
        self.starts: Dfa = compile_rules(patterns, backwards=True, anywhere=True)
        holds = [r.holds for r in self.rules if r.holds]
        self.ends: Dfa = compile_rules(patterns + holds)
        numbers = iter(range(len(patterns), len(patterns) + len(holds)))
        self.must = [1 << next(numbers) if r.holds else 0 for r in self.rules]
        self.classes = self.ends.byte_class.tobytes()

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rule, start and end (in bytes of `data`) of all spans, by start and then by rule. Text r is offsets[r]:offsets[r+1]."""
        # Texts are set apart by a byte that none has; place p of text r then is p + r.
        apart = np.full(len(data) + len(offsets) - 1, SEPARATOR, np.uint8)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        apart[np.arange(len(data)) + row] = data
        hits = self.starts.accepts[scan(self.starts, apart[::-1])][::-1]
        some = np.flatnonzero(hits)
        found: list[tuple[int, int, int]] = []
        whole = apart.tobytes() if len(some) else b""
        for k, rule in enumerate(self.rules):
            begins = some[(hits[some] >> k & 1).astype(bool)]
            i = 0
            while i < len(begins):
                start = int(begins[i])
                end, also = longest(self.ends, whole, start, k, self.classes)
                if end - start >= rule.least and (not self.must[k] or also & self.must[k]):
                    found.append((start, k, end))
                i = max(i + 1, int(np.searchsorted(begins, end)))
        found.sort()
        start, kind, end = np.array(found, np.int64).reshape(-1, 3).T
        shift = np.searchsorted(offsets[1:] + np.arange(1, len(offsets)), start, "right")
        return kind, start - shift, end - shift


def scan_secrets(docs: DataFrame, *, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, spans (kind, start, end), by start and then in the rules' order.

    Places count code points, ends are exclusive. Spans of one kind don't overlap, those of different kinds may.
    Whole texts are read, however long; a null text has no spans. Ids may be null or repeat and are passed on;
    rows that repeat are scanned one by one. An empty table gives an empty table; other columns are ignored.
    """
    rules = list(rules)
    kind = docs.schema[id_col].dataType.simpleString()
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(rules))  # of the rules' size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner.value
        names = pa.array([r.kind for r in own.rules], pa.string())
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(1)):
                which, start, end = own.spans(data, offsets)
                row = np.searchsorted(offsets, start, "right") - 1
                if len(which):
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    start, end = points[start] - points[offsets[row]], points[end] - points[offsets[row]]
                edges = pa.array(np.searchsorted(row, np.arange(high - low + 1)).astype(np.int32))
                spans = pa.StructArray.from_arrays(
                    [names.take(pa.array(which)), pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64))], ["kind", "start", "end"]
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.ListArray.from_arrays(edges, spans)], ["doc_id", "spans"]
                )
        free_memory()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, f"doc_id {kind}, spans array<struct<kind string, start long, end long>>")
