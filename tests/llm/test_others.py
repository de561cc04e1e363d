import duckdb
import numpy as np
from pyspark.sql import functions as F

from mosaicveil.llm import licenses, urlfilter, vptree
from mosaicveil.llm.queries import oracle_sql, queries


def same_as_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = queries()[name](spark, sf).toPandas(), c.sql(oracle_sql()[name]).df()
    rows = lambda df: sorted(tuple("" if x is None or x != x else str(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    return rows(got) == rows(want)


def test_queries_equal_sql(spark, sf):
    for name in oracle_sql():
        assert same_as_sql(spark, sf, name), name


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [2.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in vptree.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 7, 1.0), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 7, 1.0)]
    assert vptree.nearest(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_pruned_search_is_exact_at_factor_one():
    rng = np.random.default_rng(5)
    data = np.round(rng.normal(size=(3000, 3)), 1)
    ids = rng.permutation(3000)
    tree = vptree.Tree(ids, data)
    q = rng.normal(size=(40, 3))
    d, who = vptree.nowhere(40, 10)
    tree.search(np.arange(-40, 0), q, d, who)
    full = vptree.distances(q, data)
    for k in range(40):
        want = sorted(zip(full[k], ids))[:10]
        assert [(x, y) for x, y in zip(d[k], who[k])] == want
    near, some = vptree.nowhere(40, 10)
    tree.search(np.arange(-40, 0), q, near, some, 0.5)
    assert np.mean(near <= d[:, -1:]) > 0.9


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/7x?q#f", "https://x.com/en/", "https://b.example.net/de/81", "http://y.net/de/1", "http://z.org/es/", "http://z.org/es", "no scheme", None, "http://", "http://com/en/1", "http://xcom/en/1", "ftp://q.fr/a/index.html"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(99, "http://q.fr/a", "h")], "page_id long, url string, host string")
    listed = spark.createDataFrame([("q.fr/a",), ("q.fr/a",), (None,)], "canonical string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, listed).collect()}
    assert got[0] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") and got[1][2:] == ("com/en/", "block")
    assert got[2][2:] == ("example.net/de/8", "block") and got[3][2:] == ("net/de/", "allow") and got[4][2:] == ("org/es/", "block")
    assert got[5][2:] == (None, "allow") and got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow") and got[8][0] == ""
    assert got[9][2] == "com/en/" and got[10][2] is None and got[11][3] == got[99][3] == "block"
    assert urlfilter.judge(pages.where("false"), listed).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages.where("page_id = 99"), listed.where("false")).collect()} == {"allow"}


def test_filter_has_no_false_negative(spark):
    listed = spark.range(5000).select(F.concat(F.lit("h.org/"), "id").alias("canonical"))
    seen = urlfilter.probe(spark.range(10000).select(F.concat(F.lit("h.org/"), "id").alias("canonical"), "id"), urlfilter.bloom(listed))
    rows = {r.id: r.possible for r in seen.collect()}
    assert all(rows[k] for k in range(5000)) and sum(rows[k] for k in range(5000, 10000)) < 500


def test_licences(spark):
    mit = next(t for i, t in licenses.KNOWN if i == "MIT")
    texts = [None, "", mit, "Copyright (c) 2020 Jane\n" + mit.upper().replace("LICENSE", "LICENCE"), mit + " more", "words\nReleased under the MIT licence\nAll Rights Reserved!", "© 2001 x", "x" * 100_000]
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)] + [(None, mit, "z")], "doc_id long, text string, known string")
    got = {r.doc_id: r for r in licenses.scan(spark, df).collect()}
    assert len(got) == len(texts) + 1 and got[2].license_id == got[3].license_id == got[None].license_id == "MIT"
    assert all(got[k].license_id is None for k in (0, 1, 4, 5, 6, 7)) and got[0].digest == got[1].digest == got[6].digest
    assert got[5].notices == "MIT,proprietary" and got[1].notices == ""
    assert licenses.scan(spark, df.where("false")).count() == 0


def test_licence_table_of_the_callers_own(spark):
    known = spark.createDataFrame([("X-1", "The X Terms\nhold here."), ("Y-1", "Under Y terms"), ("empty", "")], "license_id string, text string")
    docs = spark.createDataFrame([(1, "the x terms HOLD here", "k"), (2, "first\nUnder Y terms.\nlast", "k"), (3, "", "k"), (4, None, "k")], "doc_id long, text string, known string")
    got = {r.doc_id: (r.license_id, r.notices) for r in licenses.scan(spark, docs, known, gate="").collect()}
    assert got == {1: ("X-1", "X-1"), 2: (None, "Y-1"), 3: (None, ""), 4: (None, "")}
