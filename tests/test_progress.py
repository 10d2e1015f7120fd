import datetime as dt

from barloom.streaming.live import replay_many
from barloom.streaming.progress import ProgressTable, progress_row

T0 = dt.datetime(2024, 3, 6, 9, 30)


def test_reports_with_and_without_a_watermark():
    report = {
        "id": "q", "runId": "r", "name": None, "batchId": 3, "timestamp": "2024-03-06T09:30:00.000Z", "numInputRows": 7, "batchDuration": 12,
        "processedRowsPerSecond": 5.5, "stateOperators": [{"numRowsTotal": 4}, {"numRowsTotal": 2}], "eventTime": {},
    }
    row = progress_row(report)
    assert row[3] == 3 and row[5:8] == (7, 5.5, 12) and row[8:] == (None, None, None, 6)
    report["eventTime"] = {"max": "2024-03-06T09:29:00.000Z", "watermark": "2024-03-06T09:20:30.000Z"}
    assert progress_row(report)[10] == 510.0


def test_progress_of_a_query_becomes_a_table(spark, tmp_path):
    path = str(tmp_path / "in")
    for i in range(3):
        spark.range(10 * i, 10 * i + 5).coalesce(1).write.mode("append").parquet(path)
    table = ProgressTable(spark, str(tmp_path / "progress"), every=2)
    spark.streams.addListener(table)
    try:
        q = (
            spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(path).writeStream.format("noop").queryName("three")
            .option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        )
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(table)
    rows = table.table().filter("input_rows > 0").orderBy("batch_id").collect()
    assert [(r["name"], r["batch_id"], r["input_rows"]) for r in rows] == [("three", i, 5) for i in range(3)]


def test_replay_times_equal_a_loop(spark):
    bars = [("a", (T0 + dt.timedelta(minutes=17 * i)).date(), T0 + dt.timedelta(minutes=17 * i), i) for i in range(200)]
    bars += [("late", dt.date(2024, 3, 6), dt.datetime(2024, 3, 7, 0, 5), -1), ("none", None, T0, -2), ("none", dt.date(2024, 3, 6), None, -3)]
    times = [T0, T0 + dt.timedelta(minutes=1), T0 + dt.timedelta(hours=9, seconds=30), dt.datetime(2024, 3, 7, 0, 0, 30), dt.datetime(2024, 3, 7, 0, 1), dt.datetime(2024, 3, 7, 23, 59), T0, None]
    bdf = spark.createDataFrame(bars, "symbol string, trade_date date, ts timestamp, n int")
    tdf = spark.createDataFrame([(t,) for t in times], "replay_at timestamp")
    got = sorted((r["replay_at"], r["n"]) for r in replay_many(bdf, tdf).collect())
    want = sorted(
        (t, n) for t in set(times) if t for _, day, ts, n in bars
        if ts and day == t.date() and ts.date() == day and ts <= t - dt.timedelta(minutes=1)
    )
    assert got == want
