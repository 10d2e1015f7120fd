"""Streams that keep a little of every symbol: its last bars for the screen, and its open position.

State lives in the RocksDB store of the query's checkpoint, one small value a symbol, so a trigger reads neither a bar
store nor symbols without news, and a restarted query goes on where it stopped.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barloom.functions.scalars import is_near_close
from barloom.operators.reports import last_n_per_key
from barloom.plans.features import feature_table
from barloom.streaming.live import LIVE_BARS, assess, write_batch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
_PARTITIONS = "spark.sql.shuffle.partitions"
#: Rows that a task looks over at once for the newest of every symbol.
HELD_ROWS = 200_000


def state_partitions(spark: SparkSession) -> int:
    """Parts of the state: two a core, at most the session's shuffle partitions. Every part is a store that each trigger
    opens and commits, however few symbols it has, and a stream's plans are not adaptive."""
    return min(int(spark.conf.get(_PARTITIONS)), max(16, 2 * spark.sparkContext.defaultParallelism))


@contextmanager
def state_store(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """The store that these operators need, for queries started within; the session's own settings are put back.

    ``partitions`` are the parts of the state, by default `state_partitions`; a query that is started again keeps those
    of its checkpoint. A commit writes what has changed, not the whole store.
    """
    wanted = {_PROVIDER: _ROCKSDB, _CHANGELOG: "true", _PARTITIONS: str(partitions or state_partitions(spark))}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class LastBars(StatefulProcessor):
    """The last ``n`` bars of a symbol by time, of any age; emitted whenever the symbol has news."""

    def __init__(self, schema: T.StructType, n: int):
        self.schema, self.n = schema, n
        self.time = schema.fieldNames().index("ts")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("bars", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # of bars of one time the first to arrive stays
        bars = {}
        for r in [*self.kept.get(), *sorted(rows, key=lambda r: str(tuple(r)))]:
            if r[self.time] is not None:
                bars.setdefault(r[self.time], tuple(r))
        last = [bars[t] for t in sorted(bars)[-self.n :]]
        if last:
            self.kept.put(last)
        for r in last:
            yield Row(**dict(zip(self.schema.fieldNames(), r)))

    def close(self) -> None:
        pass


def newest(rows: pa.Table, n: int) -> pa.Table:
    """The rows of every symbol's ``n`` newest times; all rows of a time stay, those without a time do not."""
    rows = rows.filter(pc.is_valid(rows["ts"]))
    if not len(rows):
        return rows
    symbol = pa.concat_arrays(rows["symbol"].chunks).dictionary_encode(null_encoding="encode").indices.to_numpy()
    at = pc.rank(rows["ts"], sort_keys="descending", tiebreaker="dense").to_numpy()
    order = np.lexsort((at, symbol))
    symbol, at = symbol[order], at[order]
    first = np.append(True, symbol[1:] != symbol[:-1])
    place = np.cumsum(first | np.append(True, at[1:] != at[:-1]))
    place -= np.maximum.accumulate(np.where(first, place, 0))
    return rows.take(order[place < n])


def newest_of_task(n: int, most: int = HELD_ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What of a task's bars can be among the last ``n`` of a symbol, with at most ``most`` rows and a batch held at once."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= most:
                rows = newest(pa.Table.from_batches(held), n)
                if len(rows) > most // 2:  # many symbols: little would be gained by holding them
                    yield from rows.to_batches()
                    rows = rows.slice(0, 0)
                held, count = rows.combine_chunks().to_batches(), len(rows)
        if held:
            yield from newest(pa.Table.from_batches(held), n).to_batches()

    return of_task


def last_bars(bars: DataFrame, n: int = LIVE_BARS) -> DataFrame:
    """Stream of the last ``n`` bars of every symbol that a trigger has bars of. Late bars find their place by their time;
    a repeated bar changes nothing. Rows without a time are left out. Times travel as numbers, free of time zones.

    Tasks that read bars pass on only those that can be among a symbol's last, so a symbol's rows in a trigger do not
    grow with its bars but with the tasks."""
    plain, back = [], []
    for f in bars.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            plain.append(F.unix_micros(c).alias(f.name))
            back.append(F.timestamp_micros(c).alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            plain.append(F.unix_date(c).alias(f.name))
            back.append(F.date_from_unix_date(c).alias(f.name))
        else:
            plain.append(c)
            back.append(c)
    numbers = bars.select(*plain)
    few = numbers.mapInArrow(newest_of_task(n), numbers.schema)
    kept = few.groupBy("symbol").transformWithState(LastBars(numbers.schema, n), numbers.schema, outputMode="Update", timeMode="None")
    return kept.select(*back)


def run_screen(
    bars: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None, out: str, checkpoint: str, daily: DataFrame | None = None, last: int = LIVE_BARS, **trigger
):
    """Start the live screen: each trigger's newest bars with their features, screening and score, written by batch."""

    def on_batch(recent: DataFrame, batch_id: int) -> None:
        # a symbol's rows of one trigger are its last bars: all that its features need
        rows = feature_table(recent.withColumn("session", F.lit("live")), daily)
        write_batch(assess(last_n_per_key(rows, ["symbol"], "ts", 1), scorer), batch_id, out)

    with state_store(bars.sparkSession):
        return (
            last_bars(bars, last).writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
            .outputMode("update").trigger(**(trigger or {"processingTime": "30 seconds"})).start()
        )


_EVENT = "symbol string, at long, price double, closing boolean, entry_id string, stop double, target double"
_CLOSED = "symbol string, entry_id string, entry_at long, exit_at long, exit_price double, exit_reason string"


class OnePosition(StatefulProcessor):
    """At most one open position of a symbol: entries open it, bars close it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "entry_id string, entry_at long, stop double, target double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = tuple(self.held.get()) if self.held.exists() else None
        at_once: dict[int, tuple[list, list]] = {}
        for r in rows:
            at_once.setdefault(r["at"], ([], []))[r["entry_id"] is not None].append(r)
        for at in sorted(at_once):
            bars = sorted(at_once[at][0], key=lambda b: (b["price"] is None, b["price"], b["closing"]))
            # a bar may end what is open and what an entry of the same time opens
            for entry in [None, *sorted(at_once[at][1], key=lambda e: e["entry_id"])]:
                if entry is not None:
                    if held is not None:
                        continue
                    held = (entry["entry_id"], at, entry["stop"], entry["target"])
                for bar in bars if held is not None else []:
                    why = _reason(bar, held)
                    if why:
                        yield Row(symbol=key[0], entry_id=held[0], entry_at=held[1], exit_at=at, exit_price=bar["price"], exit_reason=why)
                        held = None
                        break
        if held is not None:
            self.held.update(held)
        elif self.held.exists():
            self.held.clear()

    def close(self) -> None:
        pass


def _reason(bar: Row, held: tuple) -> str | None:
    price = bar["price"]
    if price is not None and held[2] is not None and price <= held[2]:
        return "STOP_LOSS"
    if price is not None and held[3] is not None and price >= held[3]:
        return "TAKE_PROFIT"
    return "MARKET_CLOSE" if bar["closing"] else None


def position_events(bars: DataFrame, entries: DataFrame) -> DataFrame:
    """Bars and entries (entry_id, symbol, ts, stop_loss_price, take_profit_price) as one stream of events."""
    none = F.lit(None)
    of_bars = bars.select(
        F.col("symbol").cast("string").alias("symbol"), F.unix_micros("ts").alias("at"), F.col("close").cast("double").alias("price"),
        F.coalesce(is_near_close("ts"), F.lit(False)).alias("closing"), none.cast("string").alias("entry_id"), none.cast("double").alias("stop"), none.cast("double").alias("target"),
    )
    of_entries = entries.select(
        F.col("symbol").cast("string").alias("symbol"), F.unix_micros("ts").alias("at"), none.cast("double").alias("price"), F.lit(False).alias("closing"),
        F.col("entry_id").cast("string").alias("entry_id"), F.col("stop_loss_price").alias("stop"), F.col("take_profit_price").alias("target"),
    )
    return of_bars.unionByName(of_entries).filter("at IS NOT NULL AND symbol IS NOT NULL")


def closed_positions(events: DataFrame) -> DataFrame:
    """Stream of the positions that the events close, by the rules of `exits`: the stop before the target before the close
    buffer, from the entry's own bar on, and no entry while a position of the symbol is open.

    Triggers must follow each other in time: the events of a trigger are put in order, those of earlier triggers are
    done. A position that is open when a trigger ends stays in the state, over any number of triggers and restarts.
    """
    return events.groupBy("symbol").transformWithState(OnePosition(), _CLOSED, outputMode="Append", timeMode="None").select(
        "symbol", "entry_id", F.timestamp_micros("entry_at").alias("ts"), F.timestamp_micros("exit_at").alias("exit_ts"), "exit_price", "exit_reason"
    )
