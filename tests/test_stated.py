"""Queries against their SQL on small tables made for one difference each."""

from __future__ import annotations

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from barloom.catalog import QUERIES, SQL, load_all
from tools.check_catalog import compare


def difference(spark, folder, name: str, **tables: dict) -> str | None:
    """What the query and its SQL differ in over the tables, None where they agree."""
    load_all()
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    df = QUERIES[name](spark, str(folder))
    cur = con.execute(SQL[name])
    return compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), [d[0] for d in cur.description])


def test_freshness_of_a_tick_late_in_its_second(spark, tmp_path):
    ts = [dt.datetime(2024, 1, 3, 10, 0, 0), dt.datetime(2024, 1, 3, 10, 5, 7, 750_000)]
    events = {"event_id": [0, 1], "ts": pa.array(ts, pa.timestamp("us")), "user_id": [1, 2], "event_type": ["a", "a"], "value": [1.0, 2.0]}
    assert difference(spark, tmp_path, "freshness", events=events) is None


def test_narrow_types_of_part_keys_beyond_two_bytes(spark, tmp_path):
    lines = {"l_orderkey": [0, 5_000_000_000], "l_partkey": [1, 120_000], "l_linenumber": pa.array([1, 7], pa.int32()), "l_tax": [0.02, 0.07]}
    assert difference(spark, tmp_path, "narrow_types", lineitem=lines) is None


def test_scores_that_are_just_below_a_half(spark, tmp_path):
    prices = [123_145.0, 7_145.0, 5_545.0, 9_000.0, 8_250.0, 4_700.3]
    orders = {"o_orderkey": list(range(6)), "o_totalprice": prices, "o_orderstatus": ["F", "O", "F", "O", "F", "O"]}
    for name in ("threshold_sweep", "auc_rank", "roc_curve"):
        assert difference(spark, tmp_path, name, orders=orders) is None
