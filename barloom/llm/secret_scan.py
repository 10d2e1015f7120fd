"""Secrets in texts: all rules as one automaton, one pass over the bytes of a text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.automaton import Automaton, compile_rules
from barloom.llm.shingles import small_batches, utf8


@dataclass(frozen=True)
class Rule:
    """A regex, and what a leftmost-longest match must have to count; failing matches are dropped, not retried."""

    kind: str
    pattern: str
    fold: bool = False
    keep: Callable[[bytes], bool] | None = None


_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_VALUE = re.compile(_ASSIGN.encode(), re.IGNORECASE)

# The contract's three rules first, then public key formats. A run of 24 is written into the hex rule:
# shorter runs are matches that fail and hold no match, so the same spans come out.
RULES: tuple[Rule, ...] = (
    Rule("assign", _ASSIGN, True, lambda m: len(_VALUE.fullmatch(m)[2]) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", False, lambda m: len(m) >= 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", False, lambda m: len(m) >= 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", False, lambda m: len(m) >= 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", False, lambda m: len(m) >= 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
BASE_KINDS = ("assign", "access", "hex")


class Scanner:
    """Scans for all rules at once.

    The combined automaton of the reversed rules runs over the bytes from the end: where it accepts, a match of the
    named rules begins. From the leftmost begin on, each rule's own automaton finds the longest end, and begins inside
    that match are passed over.
    """

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.begins: Automaton = compile_rules([(r.pattern, r.fold) for r in rules], backward=True, search=True)
        self.ends = [compile_rules([(r.pattern, r.fold)]) for r in rules]

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """(offset, state) for offsets where matches begin, from the end of the data."""
        a = self.begins
        moves, state, limit, found = a.moves, a.start, a.accepting, []
        for i, c in enumerate(data.translate(a.classes)[::-1], 1):
            state = moves[state + c]
            if state >= limit:
                found.append((i, state))
        return [(len(data) - i, s) for i, s in found]

    def _end(self, rule: int, data: bytes, at: int) -> int:
        a = self.ends[rule]
        moves, classes, state, limit, end = a.moves, a.classes, a.start, a.accepting, at
        for i in range(at, len(data)):
            state = moves[state + classes[data[i]]]
            if not state:
                break
            if state >= limit:
                end = i + 1
        return end

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, ordered; per rule leftmost and without overlap."""
        found, free = [], [0] * len(self.rules)
        for at, state in reversed(self.starts(data)):
            for rule in self.begins.rules[state // self.begins.width]:
                if at < free[rule]:
                    continue
                free[rule] = self._end(rule, data, at)
                keep = self.rules[rule].keep
                if keep is None or keep(data[at : free[rule]]):
                    found.append((at, rule, free[rule]))
        return sorted(found)


@cache
def scanner() -> Scanner:
    return Scanner(RULES)


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans counted in characters; every stretch of the text is decoded once."""
    marks = sorted({x for s, _, e in spans for x in (s, e)})
    places, at, n = {}, 0, 0
    for mark in marks:
        n += len(data[at:mark].decode("utf-8", "replace"))
        places[mark], at = n, mark
    return [(places[s], r, places[e]) for s, r, e in spans]


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (the columns of ``docs`` but the text) and spans (struct<kind, start, end>, ordered by start and rule).

    Positions are code points, ends exclusive. Null and empty texts have no spans; equal rows keep theirs; texts are
    scanned whole and alone, so nothing is shuffled. The automaton is
    compiled on the driver and travels with the function.
    """
    small_batches(docs.sparkSession)
    scan = scanner()
    others = [c for c in docs.columns if c != text]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), utf8(F.col(f"`{text}`")).alias("t"))
    schema = packed.select("row", F.lit(None).cast(SPANS).alias("spans")).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column(1).to_pylist():
                spans = scan.spans(data)
                spans = in_code_points(data, spans) if spans else spans
                found.append([{"kind": scan.rules[r].kind, "start": s, "end": e} for s, r, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["row", "spans"])

    return packed.mapInArrow(run, schema)
