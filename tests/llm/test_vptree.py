import numpy as np
from pyspark.sql import functions as F

from mosaicveil.llm import vptree


def brute(rows, asks, k):
    by_id = {}
    for i, v in rows:
        by_id.setdefault(i, set()).add(tuple(v))
    out = set()
    for q in asks:
        near = sorted((min(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum()) for a in by_id[q] for b in by_id[i]), i) for i in by_id if i != q)
        out |= {(q, n + 1, i, round(float(d), 9)) for n, (d, i) in enumerate(near[:k])}
    return out


def test_repeated_rows_take_one_place(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)]
    rows = rows * 2 + [rows[7]] * 30  # all twice, and a hot one
    rows += [(i, rng.normal(size=4).tolist()) for i in range(40) for _ in range(3)]  # and ids of several vectors
    asks = list(range(10))
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = vptree.nearest(docs, F.col("vec_id") < 10, k=10).collect()
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got} == brute(rows, asks, 10) and len(got) == 100


def test_many_groups_and_shards_equal_one(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(600)], "vec_id long, embedding array<double>")
    whole = sorted(tuple(r) for r in vptree.nearest(df, F.col("vec_id") % 20 == 0).collect())
    monkeypatch.setattr(vptree, "SHARD_ROWS", 50)
    monkeypatch.setattr(vptree, "BLOCK_ROWS", 3)
    monkeypatch.setattr(vptree, "QUERY_BYTES", 200)
    assert sorted(tuple(r) for r in vptree.nearest(df, F.col("vec_id") % 20 == 0).collect()) == whole and len(whole) == 300
