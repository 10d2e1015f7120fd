"""Bracket exits: the first bar at or after an entry that hits the stop, the target or the close buffer."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import is_near_close
from barloom.session import written_table

# fixed values: trading costs and default brackets
SLIPPAGE = 0.001
COMMISSION = 1.0
LATENCY_SECONDS = 2
DEFAULT_STOP = 0.98
DEFAULT_TARGET = 1.04


def _or_null(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")


def open_positions(entries: DataFrame, slippage: float = SLIPPAGE, commission: float = COMMISSION) -> DataFrame:
    """Buy side: whole shares the budget affords at the slipped price; unaffordable entries drop out."""
    buy = F.col("current_price") * (1 + slippage)
    df = entries.withColumn("buy_price", buy)
    df = df.withColumns(
        {
            "quantity": F.floor(F.col("budget") / F.col("buy_price")).cast("long"),
            "stop_loss_price": F.coalesce(_or_null(entries, "stop_loss_price"), F.col("buy_price") * DEFAULT_STOP),
            "take_profit_price": F.coalesce(
                _or_null(entries, "take_profit_price"), F.col("buy_price") * DEFAULT_TARGET
            ),
            "buy_timestamp": F.col("ts") + F.expr(f"INTERVAL {LATENCY_SECONDS} SECONDS"),
        }
    )
    df = df.filter(F.col("quantity") > 0)
    return df.withColumn("total_cost", F.col("quantity") * F.col("buy_price") + commission)


#: Probes of one group that are looked up together; more are dealt into parts, each with the group's series.
PROBES_TOGETHER = 50_000


class ExtremeTree:
    """Minima and maxima of a series over all aligned blocks of 1, 2, 4, ... values, as one heap."""

    def __init__(self, low: np.ndarray, high: np.ndarray, always: np.ndarray):
        """``always`` marks values that end any search. NaN never does."""
        self.size = 1 << max(len(low) - 1, 0).bit_length()
        self.low = np.full(2 * self.size, np.inf)
        self.high = np.full(2 * self.size, -np.inf)
        leaves = slice(self.size, self.size + len(low))
        self.low[leaves] = np.where(always, -np.inf, np.where(np.isnan(low), np.inf, low))
        self.high[leaves] = np.where(always, np.inf, np.where(np.isnan(high), -np.inf, high))
        at = self.size
        while at > 1:
            self.low[at // 2 : at] = np.minimum(self.low[at : 2 * at : 2], self.low[at + 1 : 2 * at : 2])
            self.high[at // 2 : at] = np.maximum(self.high[at : 2 * at : 2], self.high[at + 1 : 2 * at : 2])
            at //= 2

    def first(self, start: np.ndarray, stop: np.ndarray, target: np.ndarray) -> np.ndarray:
        """For each search the first position from ``start`` on with low <= stop or high >= target, or -1.

        All searches climb and descend together, so there are as many steps as the tree has levels, twice.
        """
        found = np.full(len(start), -1, np.int64)
        who = np.flatnonzero(start < self.size)
        node = start[who].astype(np.int64) + self.size
        node //= node & -node  # the largest block that begins here
        while len(who):
            hit = (self.low[node] <= stop[who]) | (self.high[node] >= target[who])
            found[who[hit]] = node[hit]
            node, who = node[~hit] + 1, who[~hit]
            inside = node & (node - 1) != 0  # past the last block of a level the number is a power of two
            node, who = node[inside], who[inside]
            node //= node & -node
        who = np.flatnonzero((found > 0) & (found < self.size))
        while len(who):
            node = 2 * found[who]
            left = (self.low[node] <= stop[who]) | (self.high[node] >= target[who])
            found[who] = np.where(left, node, node + 1)
            who = who[found[who] < self.size]
        return np.where(found > 0, found - self.size, -1)


def _doubles(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).cast(pa.float64()).to_numpy()


_FOUND = "entry_id string, at long, price double, closing boolean"
#: Rows of small groups that a task takes together, so that a group costs no call of its own.
ROWS_TOGETHER = 200_000


def group_numbers(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The number of each row's group, from 0, in a table whose groups lie together."""
    new = np.zeros(table.num_rows, bool)
    for c in keys:
        codes = pc.dictionary_encode(table.column(c), null_encoding="encode").combine_chunks().indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and the number of each row's group, from batches in which groups lie together."""
    held: list[pa.Table] = []
    rows, enough = 0, ROWS_TOGETHER
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < enough:
            continue
        table = pa.concat_tables(held)
        numbers = group_numbers(table, keys)
        cut = int(np.searchsorted(numbers, numbers[-1]))  # the last group may go on
        if cut:
            yield table.slice(0, cut), numbers[:cut]
        held, rows = [table.slice(cut)], table.num_rows - cut
        enough = max(ROWS_TOGETHER, 2 * rows)
    if rows:
        table = pa.concat_tables(held)
        yield table, group_numbers(table, keys)


def _look_up(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, keys):
            listed = table.column("listed").to_numpy()
            low, high = _doubles(table, "low"), _doubles(table, "high")
            # one tree holds the series of all groups, each closed by a value that ends every search of its group
            before = np.cumsum(listed) - listed
            rows = np.flatnonzero(listed)
            place, size = before[rows] + group[rows], len(rows) + group[-1] + 1
            ended, lows, highs = np.ones(size, bool), np.full(size, np.nan), np.full(size, np.nan)
            lows[place], highs[place] = low[rows], high[rows]
            ended[place] = pc.fill_null(table.column("closing"), False).to_numpy()[rows]
            at = np.full(size, -1, np.int64)
            at[place] = rows
            probes = np.flatnonzero(~listed)
            found = at[ExtremeTree(lows, highs, ended).first(before[probes] + group[probes], low[probes], high[probes])]
            probes, found = probes[found >= 0], found[found >= 0]
            hits = table.select(["at", "low", "closing"]).take(pa.array(found, pa.int64()))
            names = table.column("entry_id").take(pa.array(probes, pa.int64()))
            out = pa.table({"entry_id": names, "at": hits.column("at"), "price": hits.column("low"), "closing": hits.column("closing")})
            yield from out.to_batches()

    return run


def first_in_series(probes: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of its key's series, at or after ``after``, that ends each probe; probes without one have no row.

    probes: keys, entry_id, after, stop, target. series: keys, at, low, high, closing (ends every probe). Only series
    of keys that are probed leave the JVM, once for every PROBES_TOGETHER probes of the key, so a key that most
    probes share is dealt to many tasks. A probe reads the blocks on its way through a tree, not the rows between.
    """
    counts = probes.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PROBES_TOGETHER).cast("int").alias("parts"))
    dealt = probes.join(counts, keys).withColumn("part", F.pmod(F.xxhash64("entry_id"), F.col("parts")).cast("int")).drop("parts")
    copies = series.join(counts, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    groups = [*keys, "part"]
    none = F.lit(None)
    asked = dealt.select(*groups, F.col("after").alias("at"), F.col("stop").alias("low"), F.col("target").alias("high"), none.cast("boolean").alias("closing"), "entry_id", F.lit(False).alias("listed"))
    both = asked.unionByName(copies.select(*groups, "at", "low", "high", "closing", none.cast("string").alias("entry_id"), F.lit(True).alias("listed")))
    together = both.repartition(*groups).sortWithinPartitions(*groups, "at", "listed", F.asc_nulls_last("low"), "closing")
    return together.mapInArrow(_look_up(groups), _FOUND)


def first_exits(entries: DataFrame, bars: DataFrame) -> DataFrame:
    """Entries with exit_ts, exit_price and exit_reason, all NULL where no exit is found.

    Entries look for an exit among the bars of their own (symbol, day). Those that find none there look among the later
    days of their symbol, each one row of its lowest and highest price and whether it has a close buffer, and then among
    the bars of the day they found. Bars of other days are never met.
    """
    entries = written_table(entries, "entries")
    close = F.col("close").cast("double")
    closing = F.coalesce(is_near_close("ts"), F.lit(False))
    series = bars.select("symbol", F.to_date("ts").alias("day"), F.unix_micros("ts").alias("at"), close.alias("low"), close.alias("high"), closing.alias("closing"))
    series = series.filter("at IS NOT NULL")
    name = F.col("entry_id").cast("string").alias("entry_id")
    probes = entries.select(
        "symbol", F.to_date("ts").alias("day"), name, F.unix_micros("ts").alias("after"),
        F.col("stop_loss_price").alias("stop"), F.col("take_profit_price").alias("target"),
    )
    own = written_table(first_in_series(probes, series, ["symbol", "day"]), "exits-of-the-day")

    days = series.groupBy("symbol", "day").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or("closing").alias("closing"))
    days = days.withColumn("at", F.unix_date("day").cast("long")).drop("day")
    left = probes.join(own.select("entry_id"), "entry_id", "left_anti").withColumn("after", F.unix_date("day").cast("long") + 1)
    day_found = first_in_series(left, days, ["symbol"]).select("entry_id", F.date_from_unix_date(F.col("at").cast("int")).alias("found"))
    left = left.drop("day").join(day_found, "entry_id").withColumnRenamed("found", "day").withColumn("after", F.lit(-(2**63)))
    later = first_in_series(left, series, ["symbol", "day"])

    exits = own.unionByName(later).select(F.col("entry_id").alias("_entry"), F.timestamp_micros("at").alias("exit_ts"), F.col("price").alias("exit_price"), "closing")
    stop, target = F.col("exit_price") <= F.col("stop_loss_price"), F.col("exit_price") >= F.col("take_profit_price")
    reason = F.when(stop, "STOP_LOSS").when(target, "TAKE_PROFIT").when(F.col("closing"), "MARKET_CLOSE")
    found = entries.join(exits, F.col("entry_id").cast("string") == F.col("_entry"), "left")
    return found.withColumn("exit_reason", reason).drop("_entry", "closing")


def bracket_exits(
    entries: DataFrame, bars: DataFrame, slippage: float = SLIPPAGE, commission: float = COMMISSION,
) -> DataFrame:
    """Trades table: positions opened by ``entries`` with their exits, costs and result.

    entries: entry_id (unique), symbol, ts, current_price, budget and optionally stop_loss_price and
    take_profit_price. Positions that meet no exit stay OPEN.
    """
    held = open_positions(entries, slippage, commission)
    df = first_exits(held, bars)
    sell = F.col("exit_price") * (1 - slippage)
    df = df.withColumns(
        {
            "actual_sell_price": sell,
            "sell_timestamp": F.col("exit_ts") + F.expr(f"INTERVAL {LATENCY_SECONDS} SECONDS"),
            "total_proceeds": F.col("quantity") * sell - commission,
            "commission_paid": F.when(F.col("exit_ts").isNull(), commission).otherwise(2 * commission),
            "status": F.when(F.col("exit_ts").isNull(), "OPEN").otherwise("CLOSED"),
        }
    )
    minutes = (F.unix_micros("sell_timestamp") - F.unix_micros("buy_timestamp")) / 60e6
    return df.withColumns(
        {"net_pnl": F.col("total_proceeds") - F.col("total_cost"), "buy_sell_duration_minutes": minutes}
    )


_OPEN = 2**62


def kept_trades(starts: list[int], ends: list[int], until: int) -> tuple[list[bool], int]:
    """Which trades, in order of their start, begin when no kept one is open; and until when the last kept one is."""
    keep = []
    for start, end in zip(starts, ends):
        keep.append(start >= until)
        until = end if keep[-1] else until
    return keep, until


def _chains(table: pa.Table) -> pa.Table:
    """For each start of a day, when the chain of trades kept from there on ends; equal ends meet in the latest start."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("start", "entry_id", "end"))))
    starts = [r[0] for r in rows]
    out: list[int] = [0] * len(rows)
    for i in range(len(rows) - 1, -1, -1):
        following = max(bisect.bisect_left(starts, rows[i][2]), i + 1)
        out[i] = out[following] if following < len(rows) else rows[i][2]
    last = [i for i in range(len(rows)) if i + 1 == len(rows) or out[i + 1] != out[i]]
    return pa.table({
        "symbol": table.column("symbol").slice(0, 1).take([0] * len(last)), "day": table.column("day").slice(0, 1).take([0] * len(last)),
        "start": pa.array([starts[i] for i in last], pa.int64()), "out": pa.array([out[i] for i in last], pa.int64()),
    })


def _carried(table: pa.Table) -> pa.Table:
    """Along the days of a symbol: until when a position is held as each day begins."""
    table = table.sort_by([("day", "ascending"), ("start", "ascending")])
    days, until, now = [], [], -_OPEN
    for day, chains in groupby(zip(*(table.column(c).to_pylist() for c in ("day", "start", "out"))), key=lambda r: r[0]):
        days.append(day)
        until.append(now)
        now = next((out for _, start, out in chains if start >= now), now)
    return pa.table({"symbol": table.column("symbol").slice(0, 1).take([0] * len(days)), "day": pa.array(days, pa.date32()), "until": pa.array(until, pa.int64())})


def _kept_of_day(_key: tuple, trades: pa.Table, held: pa.Table) -> pa.Table:
    order = sorted(range(trades.num_rows), key=lambda i: (trades.column("start")[i].as_py(), trades.column("entry_id")[i].as_py()))
    trades = trades.take(pa.array(order, pa.int64()))
    keep, _ = kept_trades(trades.column("start").to_pylist(), trades.column("end").to_pylist(), held.column("until")[0].as_py())
    return trades.select(["entry_id"]).filter(pa.array(keep, pa.bool_()))


def one_position_at_a_time(trades: DataFrame) -> DataFrame:
    """Drop entries made while an earlier kept trade of the symbol is still open, on whatever day that began.

    Per (symbol, day) the trades are reduced to chains: for each start, when the chain of trades kept from there on
    ends. Chains meet soon, so a day leaves few. Along the days of a symbol only the time until which a position is
    held is carried; with it every day keeps its own trades. Entries of a day are bounded by its bars, days by the
    calendar. With equal times the smaller entry_id comes first. Work is linear but for sorting.
    """
    trades = written_table(trades, "trades")
    narrow = trades.select(
        "symbol", F.to_date("ts").alias("day"), F.col("entry_id"), F.unix_micros("ts").alias("start"),
        F.coalesce(F.unix_micros("exit_ts"), F.lit(_OPEN)).alias("end"),
    )
    days = ["symbol", "day"]
    chains = narrow.groupBy(*days).applyInArrow(_chains, "symbol string, day date, start long, out long")
    held = chains.groupBy("symbol").applyInArrow(_carried, "symbol string, day date, until long")
    kind = trades.schema["entry_id"].dataType.simpleString()
    kept = narrow.groupBy(*days).cogroup(held.groupBy(*days)).applyInArrow(_kept_of_day, f"entry_id {kind}")
    return trades.join(kept, "entry_id", "left_semi")
