"""Progress of running queries as a table: rows, pace, delay and watermark lag of every trigger."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

PROGRESS = (
    "query_id string, run_id string, name string, batch_id long, triggered_at timestamp, input_rows long, rows_per_second double, "
    "batch_ms long, newest_event timestamp, watermark timestamp, watermark_lag_seconds double, state_rows long"
)


def _time(text: str | None) -> datetime | None:
    return datetime.fromisoformat(text) if text else None


def progress_row(report: dict) -> tuple:
    """One trigger's report as a row of PROGRESS. Without an event-time watermark its columns are NULL."""
    event = report.get("eventTime") or {}
    newest, mark = _time(event.get("max")), _time(event.get("watermark"))
    lag = (newest - mark).total_seconds() if newest and mark else None
    return (
        report["id"], report["runId"], report.get("name"), report["batchId"], _time(report["timestamp"]), report["numInputRows"],
        float(report.get("processedRowsPerSecond") or 0.0), int(report.get("batchDuration") or 0), newest, mark, lag,
        sum(s.get("numRowsTotal", 0) for s in report.get("stateOperators", [])),
    )


class ProgressTable(StreamingQueryListener):
    """Appends the progress of every trigger to a Parquet folder, a file for each ``every`` triggers and at a query's end.

    Rows come from the reports that Spark sends to the driver: a few numbers a trigger, whatever the data.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 20):
        self.spark, self.path, self.every = spark, path, every
        self.held: list[tuple] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.held.append(progress_row(json.loads(event.progress.json)))
        if len(self.held) >= self.every:
            self.flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.flush()

    def flush(self) -> None:
        rows, self.held = self.held, []
        if rows:
            self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        """All rows so far."""
        self.flush()
        return self.spark.read.schema(PROGRESS).parquet(self.path)
