"""Regular expressions over bytes as one deterministic automaton in arrays."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

#: No UTF-8 text has this byte; it separates texts, and no rule may take it.
SEPARATOR = 0xFF
#: Most states of an automaton, so that a state fits 16 bits.
MOST_STATES = 1 << 16
#: Bytes that a lane scans one after the other; lanes run side by side.
LANE = 512


class Nfa:
    """States with moves on sets of bytes and free moves; rules are added one by one, read forwards or backwards."""

    def __init__(self, backwards: bool = False):
        self.backwards = backwards
        self.moves: list[list[tuple[np.ndarray, int]]] = []
        self.free: list[list[int]] = []
        self.starts: list[int] = []
        self.ends: list[int] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, pattern: str) -> None:
        """Adds a rule: literals, sets, groups, alternatives and greedy repetition, over UTF-8 bytes."""
        parsed = re._parser.parse(pattern.encode())  # the standard library's reading of the pattern
        start = self.state()
        self.starts.append(start)
        self.ends.append(self._sequence(start, list(parsed), bool(parsed.state.flags & re.IGNORECASE)))

    def _sequence(self, at: int, items: list, fold: bool) -> int:
        for kind, value in reversed(items) if self.backwards else items:
            at = self._item(at, str(kind), value, fold)
        return at

    def _item(self, at: int, kind: str, value, fold: bool) -> int:
        if kind in ("LITERAL", "NOT_LITERAL", "IN", "ANY"):
            to = self.state()
            self.moves[at].append((_byte_set(kind, value, fold), to))
            return to
        if kind == "SUBPATTERN":
            return self._sequence(at, list(value[3]), fold or bool(value[1] & re.IGNORECASE))
        if kind == "BRANCH":
            to = self.state()
            for branch in value[1]:
                self.free[self._sequence(at, list(branch), fold)].append(to)
            return to
        if kind == "MAX_REPEAT":
            least, most, items = value
            for _ in range(least):
                at = self._sequence(at, list(items), fold)
            to = self.state()
            self.free[at].append(to)
            if most == re._parser.MAXREPEAT:
                self.free[self._sequence(to, list(items), fold)].append(to)
                return to
            for _ in range(most - least):
                at = self._sequence(at, list(items), fold)
                self.free[at].append(to)
            return to
        raise ValueError(f"{kind} has no place in a rule")


def _byte_set(kind: str, value, fold: bool) -> np.ndarray:
    chosen = np.zeros(256, bool)
    if kind == "ANY":
        chosen[:] = True
        chosen[10] = False
    for what, x in value if kind == "IN" else [("LITERAL", value)] if kind != "ANY" else []:
        what = str(what)
        if what == "LITERAL":
            chosen[x] = True
        elif what == "RANGE":
            chosen[x[0] : x[1] + 1] = True
        elif what != "NEGATE":
            raise ValueError(f"{what} has no place in a set of bytes")
    if fold:
        chosen[65:91] |= chosen[97:123]
        chosen[97:123] |= chosen[65:91]
    if kind == "NOT_LITERAL" or kind == "IN" and str(value[0][0]) == "NEGATE":
        chosen = ~chosen
    chosen[SEPARATOR] = False
    return chosen


@dataclass
class Dfa:
    """`table[state * width + byte_class[byte]]` is the next state; state 0 is the first. `accepts[state]` has bit k if
    rule k ends there, `alive[state]` if it still can end later or ends there."""

    byte_class: np.ndarray
    width: int
    table: np.ndarray
    accepts: np.ndarray
    alive: np.ndarray

    @property
    def states(self) -> int:
        return len(self.accepts)


def compile_rules(patterns: Iterable[str], *, backwards: bool = False, anywhere: bool = False) -> Dfa:
    """One minimal automaton for all `patterns`, by subset construction and partition refinement.

    `anywhere` lets a match begin at every byte, `backwards` reads each pattern from its end.
    """
    nfa = Nfa(backwards)
    for pattern in patterns:
        nfa.add(pattern)
    sets = np.array([chosen for moves in nfa.moves for chosen, _ in moves])
    byte_class = np.unique(sets.T, axis=0, return_inverse=True)[1].ravel().astype(np.uint8)
    width = int(byte_class.max()) + 1
    sample = np.array([np.flatnonzero(byte_class == c)[0] for c in range(width)])
    # Each state's moves by class, as lists of targets.
    goes = [[[to for chosen, to in moves if chosen[b]] for b in sample] for moves in nfa.moves]

    def closure(found: Iterable[int]) -> frozenset[int]:
        seen, todo = set(found), list(found)
        while todo:
            for to in nfa.free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)

    begin = closure(nfa.starts)
    ends = {state: 1 << k for k, state in enumerate(nfa.ends)}
    number, order, rows = {begin: 0}, [begin], []
    for subset in order:  # grows as new subsets turn up
        row = []
        for c in range(width):
            to = closure([t for s in subset for t in goes[s][c]])
            to = to | begin if anywhere else to
            if to not in number:
                number[to] = len(order)
                order.append(to)
                if len(order) > MOST_STATES:
                    raise ValueError(f"the rules need more than {MOST_STATES} states")
            row.append(number[to])
        rows.append(row)
    accepts = np.array([sum(ends[s] for s in subset if s in ends) for subset in order], np.int64)
    return _minimal(byte_class, np.array(rows, np.int64), accepts)


def _minimal(byte_class: np.ndarray, table: np.ndarray, accepts: np.ndarray) -> Dfa:
    """Merges states that no continuation tells apart: groups by accepted rules are split until all moves agree."""
    group = np.unique(accepts, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    # Groups are numbered by their first state, so that the first state stays 0.
    firsts = np.unique(group, return_index=True)[1]
    rank = np.argsort(np.argsort(firsts))
    group, firsts = rank[group], np.sort(firsts)
    table, accepts = group[table[firsts]], accepts[firsts]
    alive = accepts.copy()
    while True:
        more = alive | np.bitwise_or.reduce(alive[table], axis=1)
        if (more == alive).all():
            break
        alive = more
    return Dfa(byte_class, table.shape[1], table.ravel().astype(np.uint16), accepts, alive)


def scan(dfa: Dfa, data: np.ndarray) -> np.ndarray:
    """The automaton's state after each byte of `data`, from state 0 on.

    Bytes are dealt to lanes of LANE bytes that run side by side, each as if it began in state 0. Where the lane before
    ends in another state, a lane is run again from that one until it meets the states that it had; mostly a few bytes.
    """
    n = -(-len(data) // LANE)
    classes = np.full(n * LANE, dfa.byte_class[SEPARATOR], np.uint8)
    classes[: len(data)] = dfa.byte_class[data]
    classes = np.ascontiguousarray(classes.reshape(n, LANE).T)
    states = np.empty((LANE, n), np.uint16)
    now = np.zeros(n, np.int64)
    for j in range(LANE):
        now = dfa.table[now * dfa.width + classes[j]].astype(np.int64)
        states[j] = now
    begun = np.zeros(n, np.uint16)
    while True:
        before = np.concatenate([[0], states[-1, :-1]]).astype(np.uint16)
        lanes = np.flatnonzero(before != begun)
        if not len(lanes):
            return np.ascontiguousarray(states.T).ravel()[: len(data)]
        begun[lanes] = now = before[lanes]
        for j in range(LANE):
            now = dfa.table[now.astype(np.int64) * dfa.width + classes[j, lanes]]
            apart = now != states[j, lanes]
            lanes, now = lanes[apart], now[apart]
            if not len(lanes):
                break
            states[j, lanes] = now


def longest(dfa: Dfa, data: bytes, start: int, rule: int, classes: bytes) -> tuple[int, int]:
    """The end of the longest match of `rule` that begins at `start`, or -1, and all rules that end there too.
    `classes` maps bytes to classes."""
    state, end, found, bit = 0, -1, 0, 1 << rule
    for at in range(start, len(data)):
        state = int(dfa.table[state * dfa.width + classes[data[at]]])
        if not dfa.alive[state] & bit:
            break
        if dfa.accepts[state] & bit:
            end, found = at + 1, int(dfa.accepts[state])
    return end, found
