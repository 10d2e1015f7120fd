"""Stateful streams against the batch operators, over several triggers and a restart."""

import datetime as dt
import random
from collections import defaultdict

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from barloom.operators import exits, models
from barloom.operators.clean import optimize_features
from barloom.plans.features import feature_table
from barloom.streaming import live, quotes, stateful

T0 = dt.datetime(2024, 3, 6, 14, 30)
BARS = "symbol string, session date, trade_date date, ts timestamp, open double, high double, low double, close double, volume double"


def bars_of(rng, symbols, n):
    rows = []
    for s in symbols:
        price = 100.0
        for i in range(n):
            price *= 1 + rng.gauss(0, 0.004)
            ts = T0 + dt.timedelta(minutes=13 * i)
            rows.append((s, ts.date(), ts.date(), ts, price, price * 1.002, price * 0.998, price, float(rng.randint(1, 999)) if rng.random() > 0.1 else None))
    return rows


def fed(spark, tmp_path, cuts, schema):
    """A folder with a file for each cut, and the stream that reads one file a trigger."""
    path = str(tmp_path / "in")
    for rows in cuts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return path, lambda: quotes.stream_table(spark, path, spark.read.parquet(path).schema, max_files=1)


def test_screen_over_batches_equals_the_batch_screen(spark, tmp_path):
    """Old, late and repeated bars, in several triggers with a restart between them."""
    rng = random.Random(4)
    rows = bars_of(rng, ["a", "b"], 150) + [(*r[:3], r[3] - dt.timedelta(days=60), *r[4:]) for r in bars_of(rng, ["old"], 40)]
    rng.shuffle(rows)
    cuts = [rows[:90], rows[90:200] + rows[10:20], rows[200:]]
    path, stream = fed(spark, tmp_path, cuts[:2], BARS)
    scorer = lambda df: df.withColumns({"probability": F.lit(0.9), "prediction": F.lit(1)})
    out, at = str(tmp_path / "out"), str(tmp_path / "at")
    for more in (None, cuts[2]):
        if more:
            spark.createDataFrame(more, BARS).coalesce(1).write.mode("append").parquet(path)
        stateful.run_screen(stream(), scorer, out, at, availableNow=True).awaitTermination()
    done = spark.read.parquet(out)
    assert done.select("batch_id").distinct().count() == 3
    last = done.groupBy("symbol").agg(F.max("batch_id").alias("batch_id"))
    columns = ["symbol", "ts", "close", "screen_pass", "screen_reason", "prediction", "probability"]
    got = done.join(last, ["symbol", "batch_id"]).select(columns).collect()
    want = live.assess(live.latest_feature_rows(spark.createDataFrame(rows, BARS)), scorer).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 3
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != stateful._ROCKSDB


def test_state_gets_few_rows_of_many_bars(spark, tmp_path):
    """However many bars a symbol has in a trigger, its state gets the last of every task, and all rows of their times."""
    rng = random.Random(8)
    rows = [(s, rng.choice([None, *range(400)]), float(i)) for s in ("a", "b", None) for i in range(3000)]
    rng.shuffle(rows)
    times = defaultdict(set)
    for s, t, _ in rows:
        times[s] |= {t} - {None}
    want = sorted((r for r in rows if r[1] is not None and r[1] in sorted(times[r[0]])[-7:]), key=str)
    kinds = pa.schema([("symbol", pa.string()), ("ts", pa.int64()), ("close", pa.float64())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in rows[i : i + 500]], kinds) for i in range(0, len(rows), 500)]
    for most in (10, 1500, 100_000):
        got = [tuple(r.values()) for b in stateful.newest_of_task(7, most)(iter(batches)) for r in b.to_pylist()]
        # where little is held, more may be passed on, but nothing is lost and nothing comes twice
        assert set(want) <= set(got) and len(got) == len(set(got)) < len(rows) / 2
    assert sorted(got, key=str) == want
    assert not list(stateful.newest_of_task(7)(iter(batches[:0])))

    _, stream = fed(spark, tmp_path, [bars_of(rng, ["a", "b"], 2000)], BARS)
    with stateful.state_store(spark):
        q = stateful.last_bars(stream(), 7).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "at")).outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination()
    plan = q._jsq.explainInternal(False)
    assert plan.index("TransformWithState") < plan.index("MapInArrow") < plan.index("FileScan")


def test_parts_of_the_state_go_with_the_cores(spark, tmp_path):
    """Not with the session's shuffle partitions, each of which would be a store to commit in each trigger."""
    names = [stateful._PROVIDER, stateful._PARTITIONS, stateful._CHANGELOG]
    spark.conf.set(stateful._PARTITIONS, "150")
    try:
        before = [spark.conf.get(n, None) for n in names]
        rows = bars_of(random.Random(3), ["a", "b", "c"], 80)
        path, stream = fed(spark, tmp_path, [rows[:100]], BARS)
        out, at = str(tmp_path / "out"), str(tmp_path / "at")
        for more, parts in ((None, 16), (rows[100:], 16)):
            if more:
                spark.createDataFrame(more, BARS).coalesce(1).write.mode("append").parquet(path)
            q = stateful.run_screen(stream(), None, out, at, availableNow=True)
            q.awaitTermination()
            assert q.lastProgress["stateOperators"][0]["numShufflePartitions"] == parts
        assert [spark.conf.get(n, None) for n in names] == before
        spark.conf.set(stateful._PARTITIONS, "6")
        assert stateful.state_partitions(spark) == 6
    finally:
        spark.conf.set(stateful._PARTITIONS, "4")
    columns = ["symbol", "ts", "close", "screen_pass", "screen_reason"]
    done = spark.read.parquet(out)
    last = done.groupBy("symbol").agg(F.max("batch_id").alias("batch_id"))
    want = live.assess(live.latest_feature_rows(spark.createDataFrame(rows, BARS))).select(columns).collect()
    assert sorted(map(tuple, done.join(last, ["symbol", "batch_id"]).select(columns).collect())) == sorted(map(tuple, want)) and len(want) == 3


def test_a_fitted_pipeline_scores_the_stream_as_the_batch(spark, tmp_path):
    """Saved and loaded; rows that do not pass the screen have probability 0."""
    rng = random.Random(9)
    rows = bars_of(rng, ["a", "b", "c"], 120)
    names = ["RSI_14", "Return_5min", "Position_In_Day_Range"]
    bars = spark.createDataFrame(rows, BARS)
    known = optimize_features(feature_table(bars)).withColumn("buy", (F.col("close") > F.col("open") * (1 + F.rand(3) / 500 - 0.001)).cast("int"))
    models.save_model(models.train_models(known, names, "buy", {"m": GBTClassifier(maxIter=2, maxDepth=2, seed=1)})["m"], str(tmp_path / "model"))
    scorer = models.scorer(models.load_model(str(tmp_path / "model")), names)
    rng.shuffle(rows)
    _, stream = fed(spark, tmp_path, [rows[:200], rows[200:]], BARS)
    out = str(tmp_path / "out")
    stateful.run_screen(stream(), scorer, out, str(tmp_path / "at"), availableNow=True).awaitTermination()
    columns = ["symbol", "ts", "screen_pass", "prediction", "probability"]
    got = spark.read.parquet(out).filter("batch_id = 1").select(columns).collect()
    want = live.assess(live.latest_feature_rows(bars), scorer).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 3
    assert all((r["probability"] > 0) == r["screen_pass"] for r in got)


def test_positions_over_batches_equal_the_batch_rule(spark, tmp_path):
    rng = random.Random(6)
    bars = [(r[0], r[3], r[7]) for r in bars_of(rng, ["a", "b"], 300)]
    entries = []
    for i, (s, ts, close) in enumerate(bars):
        if rng.random() < 0.4:
            width = rng.choice([0.003, 0.01, 0.3])
            entries.append((f"{i:04d}", s, ts, close, 10_000.0, close * (1 - width), close * (1 + width)))
    bdf = spark.createDataFrame(bars, "symbol string, ts timestamp, close double")
    edf = spark.createDataFrame(entries, "entry_id string, symbol string, ts timestamp, current_price double, budget double, stop_loss_price double, take_profit_price double")
    trades = exits.one_position_at_a_time(exits.bracket_exits(edf, bdf))
    columns = ["symbol", "entry_id", "ts", "exit_ts", "exit_price", "exit_reason"]
    want = sorted(map(tuple, trades.filter("exit_ts IS NOT NULL").select(columns).collect()))
    assert len({w[5] for w in want}) == 3

    events = stateful.position_events(bdf, edf)
    marks = sorted(rng.sample(range(300), 3))
    bounds = [-(2**62), *[int((T0 + dt.timedelta(minutes=13 * m)).timestamp() * 1e6) for m in marks], 2**62]
    path = str(tmp_path / "in")
    for lo, hi in zip(bounds, bounds[1:]):
        events.filter((F.col("at") > lo) & (F.col("at") <= hi)).coalesce(1).write.mode("append").parquet(path)
        # one run a cut: each goes on from the state of the run before
        stream = quotes.stream_table(spark, path, spark.read.parquet(path).schema)
        with stateful.state_store(spark):
            q = stateful.closed_positions(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
            q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(columns).collect())) == want
