"""Exact order statistics and exact hash samples without sorting a whole column in one task."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import written_table

BRACKET_ROWS = 200_000  # distinct values one column may leave for the final exact ranking


@dataclass(frozen=True)
class _Search:
    """Where one wanted rank may lie: values in [lo, hi] (None is open), ``below`` smaller values before it."""

    lo: float | None
    hi: float | None
    below: int
    size: int


def _inside(c: str, s: _Search) -> Column:
    x = F.col(c)
    keep = x.isNotNull()
    if s.lo is not None:
        keep = keep & (x >= s.lo)
    if s.hi is not None:
        keep = keep & (x <= s.hi)
    return keep


def _kind(df: DataFrame, c: str) -> str:
    """The type in which a column is ranked: doubles hold every smaller number type, others keep their own."""
    kind = df.schema[c].dataType.simpleString()
    return "double" if kind in ("tinyint", "smallint", "int", "float", "double") else kind


def exact_ranks(
    df: DataFrame, targets: dict[str, list[int]], counts: dict[str, int] | None = None, accuracy: int = 10_000
) -> dict[str, dict[int, float]]:
    """Exact k-th smallest non-null values (1-based ranks) for several numeric columns.

    A wanted rank is bracketed by two approximate quantiles. Brackets expected to hold few values are
    ranked exactly in one job; larger ones are counted and bracketed again, each round shrinking them by
    about ``accuracy``. So nothing is collected or sorted whole, and equal values collapse before they are
    ranked. Only counts, brackets and results reach the driver.
    """
    out: dict[str, dict[int, float]] = {c: {} for c in targets}
    if len(kinds := {_kind(df, c) for c in targets}) > 1:
        for kind in sorted(kinds):
            out |= exact_ranks(df, {c: r for c, r in targets.items() if _kind(df, c) == kind}, counts, accuracy)
        return out
    wanted = [(c, r) for c, ranks in targets.items() for r in sorted(set(ranks))]
    if not wanted:
        return out
    if counts is None:
        cols = sorted({c for c, _ in wanted})
        counts = df.agg(*[F.count(c).alias(c) for c in cols]).first().asDict()
    searches = {(c, r): _Search(None, None, 0, counts[c]) for c, r in wanted if 1 <= r <= counts[c]}
    step = 2.0 / accuracy
    while searches:
        wide = {k: s for k, s in searches.items() if s.size > BRACKET_ROWS}
        ready = {k: s for k, s in searches.items() if k not in wide}
        if wide:
            tried = _bracket(df, wide, step, accuracy)
            stuck = {k for k in wide if (tried[k].lo, tried[k].hi) == (wide[k].lo, wide[k].hi)}
            small = {k for k in wide if wide[k].size * 2 * step <= BRACKET_ROWS or k in stuck}
            ready |= {k: tried[k] for k in small}
            searches |= _recount(df, {k: wide[k] for k in wide if k not in small}, tried)
        for (c, r), value in _rank_inside(df, ready).items():
            out[c][r] = value
            del searches[(c, r)]
        step *= 8  # a rank the quantiles missed is looked for in a wider bracket
    return out


def _bracket(df: DataFrame, searches: dict, step: float, accuracy: int) -> dict:
    aggs = []
    for i, ((c, r), s) in enumerate(searches.items()):
        share = (r - s.below) / s.size
        inside = F.when(_inside(c, s), F.col(c).cast(_kind(df, c)))
        shares = [max(share - step, 0.0), min(share + step, 1.0)]
        aggs.append(F.percentile_approx(inside, shares, accuracy).alias(f"q_{i}"))
    row = df.agg(*aggs).first()
    return {
        k: _Search(row[f"q_{i}"][0], row[f"q_{i}"][1], s.below, s.size) for i, (k, s) in enumerate(searches.items())
    }


def _recount(df: DataFrame, searches: dict, tried: dict) -> dict:
    """The part of each search that holds its rank, with exact counts: before, inside or behind the try."""
    if not searches:
        return {}
    aggs = []
    for i, ((c, r), s) in enumerate(searches.items()):
        t = tried[(c, r)]
        aggs.append(F.count(F.when(F.col(c) < t.lo, 1)).alias(f"lo_{i}"))
        aggs.append(F.count(F.when(F.col(c) <= t.hi, 1)).alias(f"hi_{i}"))
        aggs.append(F.count(F.when(F.col(c) < t.hi, 1)).alias(f"to_{i}"))
    row = df.agg(*aggs).first()
    found = {}
    for i, ((c, r), s) in enumerate(searches.items()):
        t, lo, hi, to = tried[(c, r)], row[f"lo_{i}"], row[f"hi_{i}"], row[f"to_{i}"]
        if r <= lo:
            found[(c, r)] = _Search(s.lo, t.lo, s.below, lo - s.below)
        elif r <= hi:
            found[(c, r)] = _Search(t.lo, t.hi, lo, hi - lo)
        else:
            found[(c, r)] = _Search(t.hi, s.hi, to, s.below + s.size - to)
    return found


def _rank_inside(df: DataFrame, searches: dict) -> dict:
    """One job: values below a bracket collapse to one counted row, those inside are counted per value."""
    if not searches:
        return {}
    keys = list(searches)
    items = []
    for i, (c, r) in enumerate(keys):
        s, x = searches[(c, r)], F.col(c).cast(_kind(df, c))
        value = F.when(_inside(c, s), x)
        reach = x.isNotNull() if s.hi is None else (F.col(c) <= s.hi)
        items.append(F.when(reach, F.struct(F.lit(i).alias("i"), F.lit(r).cast("long").alias("r"), value.alias("x"))))
    values = (
        df.select(F.explode(F.array_compact(F.array(*items))).alias("t"))
        .groupBy("t.i", "t.r", "t.x").agg(F.count("*").alias("n"))
    )
    order = Window.partitionBy("i").orderBy(F.asc_nulls_first("x"))
    ranked = values.withColumn("upto", F.sum("n").over(order))
    hit = ranked.filter((F.col("upto") >= F.col("r")) & (F.col("upto") - F.col("n") < F.col("r")) & F.col("x").isNotNull())
    return {keys[row["i"]]: row["x"] for row in hit.collect()}


def exact_medians(
    df: DataFrame, cols: list[str], accuracy: int = 10_000, counts: dict[str, int] | None = None
) -> dict[str, float | None]:
    """Medians with the two middle values averaged, ignoring NULLs; None for an empty column."""
    if not cols:
        return {}
    if counts is None:
        counts = df.agg(*[F.count(c).alias(c) for c in cols]).first().asDict()
    ranks = {c: [(counts[c] + 1) // 2, counts[c] // 2 + 1] for c in cols if counts[c]}
    values = exact_ranks(df, ranks, counts, accuracy)
    return {
        c: float(values[c][ranks[c][0]] + values[c][ranks[c][1]]) / 2 if c in ranks else None for c in cols
    }


def hash_rank_key(keys: list[str], seed: int = 42) -> Column:
    """Repeatable 60-bit number per key tuple, the same in any engine that has MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


HASH_SPACE = float(1 << 60)


#: Groups whose cuts are held as literals of one expression: classes of a label, not keys of a table.
MOST_GROUPS = 1000


def hash_cuts(df: DataFrame, group: str | None, wanted: Callable[[object, int], list[int]], key: Column) -> dict:
    """Per group, for every number in ``wanted(group, rows)``, the largest hash among so many smallest ones.

    None keeps no row, inf keeps all. Hashes spread evenly, so each rank lies in a narrow known interval: one job
    counts the groups, a second counts below all intervals and ranks inside them. An interval is widened if the
    count shows a miss.
    """
    tagged = df.select((F.col(group) if group else F.lit(0)).alias("_g"), key.alias("_h"))
    counted = tagged.groupBy("_g").agg(F.count("*").alias("n")).limit(MOST_GROUPS + 1).collect()
    if len(counted) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} classes in {group}")
    limits: dict = {}
    open_cuts = {}
    for g, total in counted:
        limits[g] = [None] * len(ranks := wanted(g, total))
        for j, n in enumerate(ranks):
            if n >= total:
                limits[g][j] = float("inf")
            elif n > 0:
                open_cuts[(g, j)] = (n, total)
    width = 6.0
    while open_cuts:
        spans = []
        for (g, j), (n, total) in open_cuts.items():
            share = n / total
            slack = width * (share * (1 - share) / total) ** 0.5 + 2.0 / total
            spans.append((g, j, n, int(max(share - slack, 0) * HASH_SPACE), int(min(share + slack, 1) * HASH_SPACE)))
        mine = F.array().cast("array<struct<i:int,lo:bigint,hi:bigint,n:bigint>>")
        for value in {g: None for g, *_ in spans}:
            cuts = [F.struct(F.lit(i).alias("i"), F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"), F.lit(n).cast("long").alias("n"))
                    for i, (g, _, n, lo, hi) in enumerate(spans) if g == value]
            mine = F.when(F.col("_g").eqNullSafe(F.lit(value)), F.array(*cuts)).otherwise(mine)
        near = tagged.select("_h", F.inline(mine)).filter(F.col("_h") <= F.col("hi"))
        merged = near.select("i", "n", F.when(F.col("_h") < F.col("lo"), F.lit(-1)).otherwise(F.col("_h")).alias("_h"))
        ranked = merged.groupBy("i", "n", "_h").agg(F.count("*").alias("rows"))
        upto = ranked.withColumn("upto", F.sum("rows").over(Window.partitionBy("i").orderBy("_h")))
        hits = upto.filter((F.col("upto") >= F.col("n")) & (F.col("upto") - F.col("rows") < F.col("n"))).collect()
        for row in hits:
            if row["_h"] >= 0:
                g, j, *_ = spans[row["i"]]
                limits[g][j] = row["_h"]
                open_cuts.pop((g, j))
        width *= 4
    return limits


def hash_thresholds(df: DataFrame, group: str | None, take: Callable[[object, int], int], key: Column) -> dict:
    """Per group the largest hash among the ``take(group, rows)`` smallest."""
    cuts = hash_cuts(df, group, lambda g, n: [take(g, n)], key)
    return {g: c[0] for g, c in cuts.items()}


def within_thresholds(group: str | None, limits: dict, key: Column) -> Column:
    """True for the rows whose hash is within their group's threshold."""
    g = F.col(group) if group else F.lit(0)
    keep = F.lit(False)
    for value, limit in limits.items():
        if limit is None:
            continue
        same = g.eqNullSafe(F.lit(value))
        keep = keep | (same if limit == float("inf") else (same & (key <= F.lit(limit))))
    return keep


def one_row(df: DataFrame) -> Column:
    """A one-row table as a struct column: a scalar subquery, evaluated once and shared by its uses."""
    return df.select(F.struct(*df.columns)).scalar()


ROWS_PER_SLICE = 1_000_000


def with_slices(values: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """Adds _slice, consecutive ranges of roughly equal size in the order of the columns, and their number.

    Running sums over a whole table are taken slice by slice. Spark's range partitioning cuts by all order
    columns, so equal leading values part on the later ones; NULL comes first and NaN last, as in a window. The
    number of slices follows the rows without a bound. Cut tables are written, so that every use sees one cut.
    """
    slices = max(math.ceil(values.count() / ROWS_PER_SLICE), 1)
    if slices == 1:
        return values.withColumn("_slice", F.lit(0)), 1
    cut = values.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id())
    return written_table(cut, "slices"), slices


def with_row_number(df: DataFrame, order: str, tiebreak: str, name: str = "row_number") -> DataFrame:
    """Adds the 1-based position by (order, tiebreak), NULL first, over the whole table without a global window.

    Only a table that fits one slice (ROWS_PER_SLICE rows) is numbered in one piece. Every row is kept.
    """
    sliced, slices = with_slices(df, order, tiebreak)
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy(order, tiebreak))
    if slices == 1:
        return sliced.withColumn(name, inside).drop("_slice")
    sizes = sliced.groupBy("_slice").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    offsets = sizes.select("_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return sliced.join(offsets, "_slice").withColumn(name, inside + F.col("_before")).drop("_slice", "_before")
