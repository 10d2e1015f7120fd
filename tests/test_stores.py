"""Picks per key without a sort."""

from __future__ import annotations

from barloom.operators.reports import first_per_key, latest_per_key


def test_picks_of_numbers_need_no_sort_and_keep_rows_whole(spark):
    rows = [("a", 1, None, 5.0), ("a", 2, 7, None), ("a", 1, 8, 6.0), ("b", None, 3, 1.0)]
    df = spark.createDataFrame(rows, "k string, o long, v long, w double")
    for pick, wanted in ((first_per_key, {("a", 1, None, 5.0), ("a", 1, 8, 6.0)}), (latest_per_key, {("a", 2, 7, None)})):
        out = pick(df, ["k"], "o")
        assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
        got = {tuple(r) for r in out.collect()}
        assert {r for r in got if r[0] == "a"} <= wanted and len(got) == 2
