"""Run registered queries against their SQL on the checking tables and report differences.

usage: python tools/check_catalog.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barloom.catalog import QUERIES, SQL, load_all  # noqa: E402
from barloom.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def key(row):
    return tuple(("" if v is None else repr(v)) for v in row)


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(spark_cols)} <> {sorted(duck_cols)}"
    order = sorted(spark_cols)
    a = sorted((tuple(norm(r[spark_cols.index(c)]) for c in order) for r in spark_rows), key=key)
    b = sorted((tuple(norm(r[duck_cols.index(c)]) for c in order) for r in duck_rows), key=key)
    if len(a) != len(b):
        return f"rows {len(a)} <> {len(b)}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    types = [
        (c, type(x).__name__, type(y).__name__)
        for x, y in zip(a[:50], b[:50], strict=True)
        for c, x, y in zip(order, x, y, strict=True)
        if x is not None and y is not None and type(x) is not type(y)
    ]
    if bad:
        c = sum(any(p != q for p, q in zip(x, y, strict=True)) for x, y in bad)
        return f"{c} of {len(a)} rows differ, e.g. {order}\n     spark {bad[0][0]}\n     sql   {bad[0][1]}"
    return f"types {sorted(set(types))}" if types else None


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    load_all()
    names = args[1:] or list(QUERIES)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    failed = 0
    for name in names:
        began = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - began
            if name not in SQL:
                verdict = None if rows else "no rows"
                mark = "rows-only"
            else:
                began = time.time()
                cur = con.execute(SQL[name])
                cols = [d[0] for d in cur.description]
                verdict = compare(rows, df.columns, cur.fetchall(), cols)
                mark = f"sql {time.time() - began:.1f}s"
        except Exception as e:  # noqa: BLE001
            verdict, took, mark, rows = f"{type(e).__name__}: {str(e)[:600]}", time.time() - began, "", []
        failed += verdict is not None
        print(f"{'FAIL' if verdict else 'ok  '} {name:32s} {len(rows):7d} rows {took:6.1f}s {mark} {verdict or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main())
