"""Averages and ranks over sessions of any length: a session is cut into ranges of rows, and no task holds one whole.

The window forms in `functions.frames` keep a session together, as its bars are bounded by the calendar. Here a session
may be the whole table: ranges are computed alone, and what a range needs of the others is a number per range.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.order_stats import with_slices
from barloom.session import written_table


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def _sorted(table: pa.Table, order: str) -> pa.Table:
    return table.sort_by(order, null_placement="at_start")  # as Spark's ranges


def decayed(x: np.ndarray, alpha: float) -> np.ndarray:
    """e_k = alpha * x_k + (1 - alpha) * e_(k-1) from e_(-1) = 0.

    Each step doubles the number of values that are summed, until all are or the weights have faded.
    """
    e = alpha * x
    step, q = 1, 1.0 - alpha
    while step < len(e) and q > 1e-40:
        e[step:] += q * e[:-step]  # the right side is taken whole before it is added
        step, q = 2 * step, q * q
    return e


def averages(df: DataFrame, keys: list[str], order: str, value: str, weights: dict[str, float]) -> DataFrame:
    """keys, k (position in the session from 0) and the recursive averages of ``value`` by name and weight of the newest.

    ``order`` has no equal values in a session. A missing value counts as 0. The first average is the first value: as if
    the averages had stood there before it. A range hands on its size, its first value and its last averages.
    """
    rows = df.select(*keys, F.col(order).alias("_at"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_x"))
    rows, _ = with_slices(rows, *keys, "_at")
    groups, names, alphas = [*keys, "_slice"], list(weights), [float(a) for a in weights.values()]

    def local(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        x = _sorted(table, "_at").column("_x").to_numpy()
        return x, [decayed(x, a) for a in alphas]

    def last(table: pa.Table) -> pa.Table:
        x, found = local(table)
        ends = pa.array([[float(e[-1]) for e in found]], pa.list_(pa.float64()))
        one = {c: table.column(c).slice(0, 1) for c in groups}
        return pa.table({**one, "size": pa.array([len(x)], pa.int64()), "first": pa.array(x[:1]), "ends": ends})

    def carried(table: pa.Table) -> pa.Table:
        table = table.sort_by("_slice")
        before, held, n = [], [], 0
        now = table.column("first").to_pylist()[:1] * len(alphas)
        for size, ends in zip(table.column("size").to_pylist(), table.column("ends").to_pylist()):
            before.append(n)
            held.append(now)
            now = [e + (1.0 - a) ** size * h for e, a, h in zip(ends, alphas, now)]
            n += size
        return pa.table({**{c: table.column(c) for c in groups}, "before": pa.array(before, pa.int64()), "held": pa.array(held, pa.list_(pa.float64()))})

    def now(_key: tuple, table: pa.Table, carry: pa.Table) -> pa.Table:
        _, found = local(table)
        held = carry.column("held")[0].as_py()
        at = np.arange(table.num_rows)
        out = {n: pa.array(e + (1.0 - a) ** (at + 1.0) * h) for n, e, a, h in zip(names, found, alphas, held)}
        return pa.table({**{c: table.column(c) for c in keys}, "k": pa.array(at + carry.column("before")[0].as_py(), pa.int64()), **out})

    kinds = _kinds(rows, groups)
    ends = rows.groupBy(*groups).applyInArrow(last, f"{kinds}, size long, first double, ends array<double>")
    # a row for each range of the session
    carry = written_table(ends.groupBy(*keys).applyInArrow(carried, f"{kinds}, before long, held array<double>"), "carried")
    doubles = ", ".join(f"`{n}` double" for n in names)
    return rows.groupBy(*groups).cogroup(carry.groupBy(*groups)).applyInArrow(now, f"{_kinds(rows, keys)}, k long, {doubles}")


def smaller_before(sequence: np.ndarray) -> np.ndarray:
    """For each number of a permutation of 0, 1, ...: how many smaller ones stand before it in the sequence.

    Numbers are told apart bit by bit from the highest: among those that share the higher bits, one with a set bit has
    all before it without that bit below it.
    """
    n = len(sequence)
    bits = max(math.ceil(math.log2(n)), 0) if n else 0
    seq = np.concatenate([sequence, np.arange(n, 1 << bits)]).astype(np.int64)
    count = np.zeros(1 << bits, np.int64)
    for b in range(bits - 1, -1, -1):
        rows = seq.reshape(-1, 2 << b)
        one = (rows >> b) & 1 == 1
        lower, upper = rows[~one], rows[one]
        count[upper] += np.cumsum(~one, axis=1)[one]
        seq = np.concatenate([lower.reshape(-1, 1 << b), upper.reshape(-1, 1 << b)], axis=1).ravel()
    return count[:n]


def ranks_before(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, k (position in the session from 0) and earlier_at_most: how many earlier rows have at most the row's value.

    ``order`` has no equal values in a session. A missing value has the rank 0 and counts for no other; NaN is above all.
    Earlier rows of the row's own range of positions are counted there; the others in ranges of values: those of the
    row's own by a second count, those of lower ranges from a table of rows per range of values and of positions.
    """
    rows = df.select(*keys, F.col(order).alias("_at"), F.col(value).cast("double").alias("_v"))
    rows, _ = with_slices(rows, *keys, "_at")
    rows = rows.withColumnRenamed("_slice", "_p")
    sizes = rows.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_p", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))  # a row for each range

    def by_position(_key: tuple, table: pa.Table, start: pa.Table) -> pa.Table:
        table = _sorted(table, "_at")
        v = table.column("_v")
        known = np.flatnonzero(v.is_valid().to_numpy())
        found = np.zeros(table.num_rows, np.int64)
        found[known] = smaller_before(np.argsort(v.drop_null().to_numpy(), kind="stable"))
        k = np.arange(table.num_rows) + start.column("_before")[0].as_py()
        return pa.table({**{c: table.column(c) for c in [*keys, "_p", "_v"]}, "k": pa.array(k, pa.int64()), "_own": pa.array(found)})

    groups = [*keys, "_p"]
    kinds = _kinds(rows, groups)
    own = rows.groupBy(*groups).cogroup(starts.groupBy(*groups)).applyInArrow(by_position, f"{kinds}, _v double, k long, _own long")
    own = written_table(own, "ranked-by-position")
    missing = own.filter("_v IS NULL").select(*keys, "k", F.lit(0).cast("long").alias("earlier_at_most"))
    rows, _ = with_slices(own.filter("_v IS NOT NULL"), *keys, "_v", "k")

    cells = rows.groupBy(*keys, "_slice", "_p").agg(F.count(F.lit(1)).alias("_n"))

    def lower_ranges(table: pa.Table) -> pa.Table:
        (qs, q), (ps, p) = (np.unique(table.column(c).to_numpy(), return_inverse=True) for c in ("_slice", "_p"))
        rows = np.zeros((len(qs) + 1, len(ps) + 1), np.int64)
        rows[q + 1, p + 1] = table.column("_n").to_numpy()
        lower = rows.cumsum(axis=0).cumsum(axis=1)[:-1, :-1].ravel()
        same = {c: table.column(c).take(pa.array(np.zeros(len(lower), np.int64))) for c in keys}
        return pa.table({**same, "_slice": pa.array(np.repeat(qs, len(ps))), "_p": pa.array(np.tile(ps, len(qs))), "_lower": pa.array(lower)})

    # a number for each pair of ranges
    grid = cells.groupBy(*keys).applyInArrow(lower_ranges, f"{_kinds(rows, [*keys, '_slice', '_p'])}, _lower long")

    def by_value(_key: tuple, table: pa.Table, lower: pa.Table) -> pa.Table:
        table = table.sort_by([("_v", "ascending"), ("k", "ascending")])  # NaN comes last
        p, n = table.column("_p").to_numpy(), table.num_rows
        place = np.empty(n, np.int64)
        place[np.lexsort((-np.arange(n), p))] = np.arange(n)  # of one range the later first, which then counts none of it
        ranges, at = lower.column("_p").to_numpy(), np.argsort(lower.column("_p").to_numpy())
        below = lower.column("_lower").to_numpy()[at][np.searchsorted(ranges[at], p)]
        found = table.column("_own").to_numpy() + smaller_before(place)[place] + below
        return pa.table({**{c: table.column(c) for c in [*keys, "k"]}, "earlier_at_most": pa.array(found, pa.int64())})

    groups = [*keys, "_slice"]
    ranked = rows.groupBy(*groups).cogroup(grid.groupBy(*groups)).applyInArrow(by_value, f"{_kinds(rows, keys)}, k long, earlier_at_most long")
    return ranked.unionByName(missing)
