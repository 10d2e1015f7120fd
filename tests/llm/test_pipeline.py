"""The pipeline against a brute-force version, and the registered queries against their SQL."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from barloom.llm import decontaminate, oracles, pii, queries
from barloom.llm.pieces import Codec, load_pieces
from barloom.llm.text import written
from tests.llm.test_native import base, counts
from tests.llm.test_python_side import brute_components
from tools.check_catalog import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(oracles.SQL[name])
    names = [d[0] for d in cur.description]
    assert compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), names) is None


def test_names_of_queries():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


def redacted(text: str) -> str:
    """Base spans labelled; this table has no terms that reveal a value."""
    spans = sorted((int(s), int(e), pii.LABELS[k]) for k, s, e in (x.split(":") for x in base(text).split(",") if x))
    out, at = "", 0
    for s, e, label in spans:
        if s >= at:
            out += text[at:s] + label
        at = max(at, e)
    return out + text[at:]


def test_pipeline_equals_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")
    # quality rules; no host here comes near the limit
    kept = {}
    failed = Counter()
    for i, text in docs.text.items():
        n, *_, repeats = counts(text)
        if n < 20 or 100 * repeats > 30 * n:
            failed[docs.source[i]] += 1
        else:
            kept[i] = text
    assert all(n < 0.8 * (docs.source == s).sum() for s, n in failed.items())
    # near copies
    first = {i: c for i, (_, c) in brute_components(kept).items()}
    kept = {i: t for i, t in kept.items() if first[i] == i}
    # benchmark: every item against every window
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    items = [decontaminate.Item(t.encode()) for t in bench.text]
    clean = {}
    for i, text in kept.items():
        words = decontaminate.tokens(text.encode())
        if not any(x.found(words[max(0, s - len(x.words)) : s + 48 + len(x.words)])[1] for x in items for s in range(0, max(1, len(words)), 24)):
            clean[i] = text
    # personal data, then pieces
    codec = Codec(load_pieces(queries.piece_model()))
    expected = {i: [p for c in codec.chunks(t) for p in codec.best(c)] for i, t in ((i, redacted(t)) for i, t in clean.items())}
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: list(r.ids) for r in found} == expected
    assert all(r.n_tokens == len(r.ids) and r.exact for r in found)


def test_stages_keep_the_columns(spark, awkward, nothing):
    """Each stage but the last gives the columns it got, also from an empty table."""
    for docs in (awkward, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            out.count()
    assert [re.sub(r"\W", "", n) for n, _ in corpus_pipeline.STAGES] == ["qualityrules", "ngramjoin", "decontamination", "pii", "sentencepiece"]


def test_a_written_table_is_read_without_a_job(spark):
    df = spark.range(3).selectExpr("id", "named_struct('a', array(id)) s", "cast(id as string) t")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    table = written(df, "plain")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before
    assert jobs == 1  # the write; none to find the columns' kinds
    assert table.dtypes == df.dtypes and table.exceptAll(df).count() == 0
