"""Rule regexes compiled to minimal transition arrays: Thompson's construction, subsets, partition refinement."""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as K
from re import _parser

import numpy as np

DEAD = 0


class _Nfa:
    """States with byte-set edges and empty edges."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.skips: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.skips.append([])
        return len(self.moves) - 1

    def add(self, items, start: int, fold: bool, backward: bool) -> int:
        """Append a parsed sequence after ``start``; backward reads it from its end."""
        for op, arg in reversed(list(items)) if backward else items:
            start = self._one(op, arg, start, fold, backward)
        return start

    def _one(self, op, arg, start: int, fold: bool, backward: bool) -> int:
        if op in (K.LITERAL, K.IN, K.ANY, K.NOT_LITERAL):
            end = self.state()
            self.moves[start].append((_bytes(op, arg, fold), end))
            return end
        if op is K.SUBPATTERN:
            return self.add(arg[3], start, fold, backward)
        if op is K.BRANCH:
            end = self.state()
            for items in arg[1]:
                self.skips[self.add(items, start, fold, backward)].append(end)
            return end
        if op is K.MAX_REPEAT:
            low, high, items = arg
            for _ in range(low):
                start = self.add(items, start, fold, backward)
            if high == K.MAXREPEAT:
                loop, end = self.state(), self.state()
                self.skips[start].append(loop)
                self.skips[loop].append(end)
                self.skips[self.add(items, loop, fold, backward)].append(loop)
                return end
            end = self.state()
            for _ in range(high - low):
                self.skips[start].append(end)
                start = self.add(items, start, fold, backward)
            self.skips[start].append(end)
            return end
        raise ValueError(f"{op} is not a regular operation")

    def closure(self, states) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for to in self.skips[todo.pop()]:
                if to not in found:
                    found.add(to)
                    todo.append(to)
        return frozenset(found)


def _bytes(op, arg, fold: bool) -> frozenset[int]:
    if op is K.ANY:
        return frozenset(range(256)) - {10}
    if op is K.LITERAL or op is K.NOT_LITERAL:
        found = {arg}
    else:
        found = set()
        for kind, value in arg:
            if kind is K.LITERAL:
                found.add(value)
            elif kind is K.RANGE:
                found.update(range(value[0], value[1] + 1))
            elif kind is not K.NEGATE:
                raise ValueError(f"{kind} is not a byte class")
    if max(found, default=0) > 127:
        raise ValueError("rules are ASCII")
    if fold:
        found |= {b ^ 32 for b in found if chr(b).isalpha()}
    negated = op is K.NOT_LITERAL or op is K.IN and any(kind is K.NEGATE for kind, _ in arg)
    return frozenset(range(256)) - found if negated else frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """``moves[state * width + classes[byte]]`` is the next state times ``width``. States from ``accepting`` on accept;
    ``rules[state]`` names what they accept. State 0 is dead unless the automaton searches."""

    classes: bytes
    width: int
    moves: list[int]
    start: int
    accepting: int
    rules: list[tuple[int, ...]]


def compile_rules(patterns: list[tuple[str, bool]], backward: bool = False, search: bool = False) -> Automaton:
    """One minimal automaton of all (pattern, fold case) rules; rule numbers are places in the list.

    backward reads texts from their end. search lets a match begin anywhere, so one pass over the bytes meets the
    (backward: first) byte of every match of every rule.
    """
    nfa = _Nfa()
    root, final = nfa.state(), {}
    for rule, (pattern, fold) in enumerate(patterns):
        first = nfa.state()
        nfa.skips[root].append(first)
        final[nfa.add(_parser.parse(pattern), first, fold, backward)] = rule
    # bytes that no rule tells apart share a class
    signs: dict[tuple, int] = {}
    sets = [s for moves in nfa.moves for s, _ in moves]
    classes = bytes(signs.setdefault(tuple(b in s for s in sets), len(signs)) for b in range(256))
    width = len(signs)
    member = [next(b for b in range(256) if classes[b] == c) for c in range(width)]
    begin = nfa.closure([root])
    table: dict[frozenset[int], int] = {frozenset(): 0}
    order, rows, at = [frozenset()], [], 0
    if begin not in table:
        table[begin] = 1
        order.append(begin)
    while at < len(order):
        states, row = order[at], []
        for byte in member:
            to = nfa.closure([t for s in states for chars, t in nfa.moves[s] if byte in chars])
            if search:
                to |= begin
            if to not in table:
                table[to] = len(order)
                order.append(to)
            row.append(table[to])
        rows.append(row)
        at += 1
    accepts = [tuple(sorted(final[s] for s in states if s in final)) for states in order]
    return _minimal(np.array(rows), accepts, table[begin], classes, width)


def _minimal(moves: np.ndarray, accepts: list[tuple[int, ...]], start: int, classes: bytes, width: int) -> Automaton:
    """Split groups of states until all of a group go to the same groups; accepting groups come last."""
    kinds = {a: i for i, a in enumerate(dict.fromkeys(accepts))}
    group = np.array([kinds[a] for a in accepts])
    while True:
        _, finer = np.unique(np.column_stack([group, group[moves]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    n = group.max() + 1
    first = np.array([np.flatnonzero(group == g)[0] for g in range(n)])
    dead = group[0]
    rank = sorted(range(n), key=lambda g: (bool(accepts[first[g]]), g != dead, g))
    place = {g: i for i, g in enumerate(rank)}
    flat = [place[group[t]] * width for g in rank for t in moves[first[g]]]
    rules = [accepts[first[g]] for g in rank]
    accepting = next((i for i, r in enumerate(rules) if r), n)
    return Automaton(classes, width, flat, place[group[start]] * width, accepting * width, rules)
