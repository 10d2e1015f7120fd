"""Window frames over one trading session.

A session is one (symbol, session) group ordered by bar time. It is bounded by the calendar and the
bar width, never by the size of the table. Every frame
below shares the same partitioning and ordering, so any number of them costs one exchange and one sort.

``past(n)`` and ``hist`` stop at the row *before* the current one: features at minute t see only
earlier bars.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

SESSION_KEYS = ("symbol", "session")
#: Values whose weights of a recursive average share one origin, for weights that fade at a usual pace.
BLOCK = 640
#: Bars of a session that ranks among earlier values are planned for, unless a caller asks for more.
SESSION_BARS = 65_536
_NEAR = 64  # positions whose values are compared one by one
_BASE = 32  # of the digits of the position before them
_FIELD = 21  # bits of a counter; three share a number


class SessionFrames:
    def __init__(self, keys=SESSION_KEYS, order: str = "ts"):
        self.keys = tuple(keys)
        self.order = order
        self.spec: WindowSpec = Window.partitionBy(*self.keys).orderBy(order)
        self.whole: WindowSpec = Window.partitionBy(*self.keys)

    @property
    def hist(self) -> WindowSpec:
        return self.spec.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def upto(self) -> WindowSpec:
        return self.spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def past(self, n: int) -> WindowSpec:
        return self.rows(-n, -1)

    def rows(self, first: int, last: int) -> WindowSpec:
        return self.spec.rowsBetween(first, last)

    def lag(self, col: str | Column, n: int = 1) -> Column:
        return F.lag(col, n).over(self.spec)

    def index(self) -> Column:
        """0-based position in the session, which is also the number of earlier bars."""
        return F.row_number().over(self.spec) - F.lit(1)


class FrameText(SessionFrames):
    """The same frames as OVER clauses for SQL expression text."""

    def over(self, first: str, last: str) -> str:
        keys = ", ".join(self.keys)
        return f"OVER (PARTITION BY {keys} ORDER BY {self.order} ROWS BETWEEN {first} AND {last})"

    @property
    def hist(self) -> str:
        return self.over("UNBOUNDED PRECEDING", "1 PRECEDING")

    @property
    def upto(self) -> str:
        return self.over("UNBOUNDED PRECEDING", "CURRENT ROW")

    def rows(self, first: int, last: int) -> str:
        def edge(n: int) -> str:
            return f"{-n} PRECEDING" if n < 0 else f"{n} FOLLOWING" if n else "CURRENT ROW"

        return self.over(edge(first), edge(last))

    @property
    def ordered(self) -> str:
        return f"OVER (PARTITION BY {', '.join(self.keys)} ORDER BY {self.order})"

    def lag(self, name: str, n: int = 1) -> str:
        return f"lag({name}, {n}) {self.ordered}"

    def index(self) -> str:
        return f"row_number() {self.ordered} - 1"

    def ema_sums(self, x: str, k: str, alpha: float) -> tuple[str, str]:
        """Weighted sums of a recursive average, over the current block of values and over the block before.

        ``k`` numbers the values from 0 within the session. Exponents count from the start of a block, so they stay
        below its length whatever the length of the session; what lies two blocks back has a weight below 1e-20.
        """
        block, q = ema_block(alpha), 1.0 - alpha
        weight = f"CASE WHEN {k} = 0 THEN 1D ELSE {alpha!r}D END"
        term = f"{weight} * {x} * power({q!r}D, -pmod({k}, {block}))"
        keys = ", ".join(self.keys)
        inside = (
            f"sum({term}) OVER (PARTITION BY {keys}, ({k}) div {block} ORDER BY {self.order} "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        )
        before = f"sum({term}) OVER (PARTITION BY {keys} ORDER BY ({k}) div {block} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"
        return inside, before

    def ema_of(self, sums: str, k: str, alpha: float) -> str:
        """The average e_k = alpha * x_k + (1 - alpha) * e_(k-1), e_0 = x_0, from columns <sums>_in and <sums>_old."""
        block, q = ema_block(alpha), 1.0 - alpha
        return f"power({q!r}D, pmod({k}, {block})) * ({sums}_in + power({q!r}D, {block}D) * coalesce({sums}_old, 0D))"

    def rank_digits(self, k: str, bars: int = SESSION_BARS) -> dict[str, str]:
        """The digits of a row's position ``k`` in the session, and the segment of positions that share the higher ones.
        The last 64 positions are no digit: see `rank_before`."""
        out = {}
        for i in range(_digits(bars)):
            out[f"_digit{i}"] = f"shiftright({k}, {6 + 5 * i}) & {_BASE - 1}"
            out[f"_segment{i}"] = f"shiftright({k}, {6 + 5 * (i + 1)})"
        return out

    def rank_sums(self, value: str, counted: str, bars: int = SESSION_BARS) -> dict[str, str]:
        """For each digit: how many rows of the segment, by their digit, have at most the row's value.

        Counters for the digits below 31 lie in eleven numbers. With `rank_before` they give the rank of a value among
        the rows before it without a list of those rows: an earlier position, but for the nearest, differs from the
        row's first in one digit, where it shares the row's segment and has a smaller digit.
        """
        out = {}
        for i in range(_digits(bars)):
            over = f"OVER (PARTITION BY {', '.join(self.keys)}, _segment{i} ORDER BY {value})"
            for g in range(0, _BASE - 1, 3):
                field = f"CASE WHEN {counted} AND _digit{i} BETWEEN {g} AND {g + 2} THEN shiftleft(1L, {_FIELD} * (_digit{i} - {g})) ELSE 0L END"
                out[f"_below{i}_{g}"] = f"sum({field}) {over}"
        return out

    def rank_near(self, value: str) -> str:
        """The values of the nearest earlier rows; those of the row's own 64 positions are its last ``k`` mod 64."""
        return f"collect_list(named_struct('x', {value})) {self.past(_NEAR - 1)}"

    def rank_before(self, k: str, value: str, near: str, bars: int = SESSION_BARS) -> str:
        """Number of counted earlier rows with at most the row's value, from the columns of `rank_sums` and `rank_near`."""
        mask, last = (1 << _FIELD) - 1, f"({k} & {_NEAR - 1})"
        parts = []
        near_ones = f"size(filter(slice({near}, greatest(size({near}) - {last} + 1, 1), {last}), v -> v.x <= {value}))"
        for i in range(_digits(bars)):
            # a digit of 3 or more counts the first number whole, one of 6 or more the second as well, and so on
            for g in range(0, _BASE - 1, 3):
                n, x = f"_digit{i} - {g}", f"_below{i}_{g}"
                parts.append(f"CASE WHEN {n} <= 0 THEN 0L WHEN {n} >= 3 THEN {x} ELSE {x} & (shiftleft(1L, {_FIELD} * ({n})) - 1) END")
        added = f"a + (p & {mask}) + (shiftright(p, {_FIELD}) & {mask}) + shiftright(p, {2 * _FIELD})"
        count = f"aggregate(array({', '.join(parts)}), CAST({near_ones} AS BIGINT), (a, p) -> {added})" if parts else f"CAST({near_ones} AS BIGINT)"
        most = _NEAR * _BASE ** _digits(bars)
        return f"CASE WHEN {k} >= {most} THEN CAST(raise_error('a session of more than {most} rows: state its session_bars') AS BIGINT) ELSE {count} END"


def _digits(bars: int) -> int:
    n = 0
    while _NEAR * _BASE**n < bars:
        n += 1
    return n


def ema_block(alpha: float) -> int:
    """Values in a block, such that weights fade by 1e-20 to 1e-260 within it: none overflows, and two blocks suffice."""
    if not 0 < alpha <= 1:
        raise ValueError(f"alpha={alpha} is not in (0, 1]")
    fade = -math.log(1.0 - alpha) if alpha < 1 else math.inf
    return BLOCK if 46 <= BLOCK * fade <= 600 else max(math.ceil(46 / fade), 1)


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)


def clip(x: Column, lo: float, hi: float) -> Column:
    """Bound x to [lo, hi]; infinities are bounded too, NaN and NULL give NULL."""
    return F.when(x <= float("inf"), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x)))


def no_nan(x: Column) -> Column:
    """NaN and infinities become NULL, so comparisons on them are never true."""
    return F.when(F.abs(x) < float("inf"), x)


def ratio(n: Column, d: Column) -> Column:
    """n / d, NULL when d is zero or either side is NULL."""
    return F.when(d != 0, n / d)


def gated(gate: Column, value: Column, default) -> Column:
    """value where the gate holds and it is defined, else the default."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.when(gate, value), fallback)
