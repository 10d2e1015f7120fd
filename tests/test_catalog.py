import duckdb
import pytest

from barloom.catalog import QUERIES, SQL, load_all
from tools.check_catalog import TABLES, compare

SF = "/root/testdata/sf0.001"
load_all()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize(
    "name", ["minimum_slice", "label_barriers", "bracket_exits", "swing_candidates", "clean_features", "auc_rank", "stratified_split"]
)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), names) is None
