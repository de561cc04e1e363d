"""Registered queries against their SQL in DuckDB."""

import os
from collections import Counter

import duckdb
import pytest

from mosaicveil.plans.queries import QUERIES, SQL


def cells(df):
    df = df[sorted(df.columns)]

    def one(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        return "null" if x is None or isinstance(x, float) and x != x else str(x)

    return sorted(tuple(one(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and cells(got) == cells(want)


def test_queries_without_sql_against_finders(spark, sf):
    """Spans lie where they say, don't overlap, and are counted, replaced and reported alike."""
    assert set(QUERIES) - set(SQL) == {"detect_documents", "entity_counts_rollup", "redact_documents"}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    spans = QUERIES["detect_documents"](spark, sf).collect()
    by = {}
    for r in spans:
        assert texts[r.doc_id][r.start : r.end] == r.text
        by.setdefault(r.doc_id, []).append((r.start, r.end))
    assert all(a[1] <= b[0] for own in by.values() for a, b in zip(sorted(own), sorted(own)[1:]))
    counted = {r["type"]: r.n for r in QUERIES["entity_counts_rollup"](spark, sf).collect() if r["type"]}
    assert counted == dict(Counter(r.type for r in spans)) and len(spans) > 50
    done = {r.doc_id: r for r in QUERIES["redact_documents"](spark, sf).collect()}
    assert done.keys() == texts.keys()
    assert all((done[k].n_replaced == 0) == (done[k].text == t) for k, t in texts.items())
    ids = [r for r in spans if r.type in ("PAN", "EMAIL", "IP_ADDRESS", "SSN")]
    assert ids and all(r.text not in done[r.doc_id].text for r in ids)
