import numpy as np

from mosaicveil.llm import quality
from mosaicveil.llm.queries import queries


def test_held_out_accuracy(spark, sf):
    sf = sf.replace("sf0.01", "sf0.1")
    got = queries()["op2_quality_classifier"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    kept = np.mean([r.predicted for r in rows if r.quality == 1])
    assert right > 0.95 and kept > 0.97, (right, kept)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "words here", 0.5), (3, "x" * 200_000, 0.5), (3, "twice", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, None), (2, 0), (None, 1), (3, 0)], "doc_id long, quality int")
    rows = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)
    none = quality.fit(docs, labels.where("false"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.where("false"), none).count() == 0


def test_learns_from_no_held_out_row(spark):
    docs = spark.createDataFrame([(k, "good words" if k % 2 else "BAD!!") for k in range(400)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 2) as quality")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality")
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]
