from collections import Counter

import corpus_pipeline as P
from mosaicveil.llm import decontaminate, secrets

from .test_minhash import brute
from .test_packing import check


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert len(P.STAGES) == 5
    steps = dict(P.STAGES)
    columns = docs.columns
    a = steps[names[0]](spark, docs, sf).cache()
    b = steps[names[1]](spark, a, sf).cache()
    c = steps[names[2]](spark, b, sf).cache()
    d = steps[names[3]](spark, c, sf).cache()
    assert all(x.columns == columns for x in (a, b, c, d))
    groups = brute([(r.doc_id, r.text) for r in a.collect()])
    assert {r.doc_id for r in b.collect()} == {i for i, (_, top) in groups.items() if i == top}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaky = {r.doc_id for r in b.collect() if any(t in r.text for t in items)}
    gone = {r.doc_id for r in b.collect()} - {r.doc_id for r in c.collect()}
    assert leaky <= gone and len(gone) <= len(leaky) + 2
    assert d.count() == c.count() and not any(secrets.fixed_spans(r.text) for r in d.collect())
    assert all(r.n_chars == len(r.text) for r in d.collect())
    rows = [(r.doc_id, r.text) for r in d.collect()]
    check(rows, steps[names[4]](spark, d, sf).collect())
    assert P.run(spark, sf).count() >= len(rows)


def test_leaks(spark):
    items = [(1, "what is the colour of the sky on a clear day in june? it is a very deep blue"), (2, "short one"), (3, None), (None, "a b c d e f g h")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pad = " ".join(f"w{k}" for k in range(500))
    texts = [f"{pad} {items[0][1].upper()} {pad}", pad, None, "", items[0][1], items[0][1].replace("june?", "july?"), "it is a very deep blue", "the sky on a clear day is it a colour of june"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, item_ids int")
    got = {r.doc_id: r.contaminated for r in decontaminate.leaks(docs, bench).collect()}
    assert [k for k, v in got.items() if v] == [0, 4] or [k for k, v in sorted(got.items()) if v] == [0, 4]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [1, 2, 3, 5, 6, 7]
    assert decontaminate.leaks(docs, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.leaks(docs.where("false"), bench).count() == 0
    # groups of a few items, repeated rows: as many rows, the same verdicts
    twice, more = docs.unionByName(docs), bench.unionByName(spark.createDataFrame([(9, "one two three four five six")], bench.schema))
    rows = sorted((r.doc_id, r.contaminated, list(r.item_ids), r.n_passages) for r in decontaminate.leaks(twice, more, most_bytes=40).collect())
    assert len(rows) == 16 and rows[::2] == rows[1::2] and [k for k, v, *_ in rows[::2] if v] == [0, 4]


def test_leaks_equal_brute_force(spark, sf):
    import re

    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    items = [(r.item_id, words(r.text)) for r in bench.collect()]
    index = decontaminate.Index.build([(r.item_id, r.text) for r in bench.collect()])
    want = {}
    for r in docs.collect():
        w = words(r.text)
        spans = [grams(w[k : k + decontaminate.WINDOW * index.span]) for k in range(0, max(1, len(w)), index.span)]
        want[r.doc_id] = sorted(
            i for i, x in items
            if any(
                len(grams(x) & s) >= 0.75 * len(grams(x))
                and all(not g or len(g & s) >= 0.5 * len(g) for g in (grams(x[: len(x) - max(5, -(-len(x) // 4))]), grams(x[len(x) - max(5, -(-len(x) // 4)) :])))
                for s in spans
            )
        )
    got = {r.doc_id: list(r.item_ids) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == want and sum(map(bool, want.values())) > 5


def test_traversal_finds_what_scoring_all_items_finds():
    import numpy as np

    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(5, 40)))) for i in range(200)]
    index = decontaminate.Index.build(items)
    found = 0
    for k in range(150):
        base = items[int(rng.integers(200))][1].split()
        words = set(base[: int(rng.integers(len(base)) + 1)]) | set(rng.choice(vocabulary, 40))
        hashes = np.unique(decontaminate._words(" ".join(sorted(words))))
        terms = np.searchsorted(index.terms, hashes)
        terms = terms[(terms < len(index.terms)) & (index.terms[np.minimum(terms, len(index.terms) - 1)] == hashes)]
        total = np.zeros(200)
        for t in terms:
            total[index.items[index.first[t] : index.first[t + 1]]] += index.impacts[index.first[t] : index.first[t + 1]]
        want = np.flatnonzero(total >= 1).tolist()
        bound = np.zeros(-(-200 // index.block))
        for t in terms:
            bound[index.blocks[index.b_first[t] : index.b_first[t + 1]]] += index.maxima[index.b_first[t] : index.b_first[t + 1]]
        assert index.traversed(terms, bound) == want
        assert index.candidates(np.zeros(len(terms), np.int64), terms, 1)[1].tolist() == want
        found += len(want)
    assert found > 30  # not an empty comparison


def test_copy_with_foreign_words_in_it_is_a_leak(spark):
    item = " ".join(f"q{k}" for k in range(59))
    words = item.split()
    docs = spark.createDataFrame([(k, " ".join([f"a{j}" for j in range(k)] + words[:44] + [f"x{j}" for j in range(40)] + words[44:] + ["z"] * 90)) for k in (0, 20, 38, 58)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert all(r.contaminated for r in decontaminate.leaks(docs, bench).collect())


ODD = "doc_id long, text string, lang string, source string, n_chars long, quality int, _place int"


def odd(spark):
    long = " ".join(f"w{k % 97}" for k in range(30_000))
    rows = [(1, "plain words of a text", "en", "s", 21, 1, 0), (1, "plain words of a text", "en", "s", 21, 1, 0), (2, None, None, None, None, None, None), (None, "no id here at all", "en", "s", 17, 1, 0), (3, "", "en", "s", 0, 0, 0), (4, long, "en", "s", len(long), 1, 0)]
    return spark.createDataFrame(rows, ODD)


def test_filtering_stages_on_odd_rows(spark, tmp_path):
    """Nulls, repeats, empty and long texts, extra columns of clashing names, empty tables: rows come out as they went in, or not at all."""
    from mosaicveil.llm import quality

    docs = odd(spark)
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (2, None)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "something quite different from all the other texts"), (None, "plain words of a text"), (2, None)], "item_id long, text string")
    given = Counter(map(tuple, docs.collect()))
    for kept in (quality.accept(docs, labels), decontaminate.clean(docs, bench), decontaminate.clean(docs, bench.where("false"))):
        assert kept.columns == docs.columns
        assert not Counter(map(tuple, kept.collect())) - given
    assert Counter(map(tuple, decontaminate.clean(docs, bench).collect())) == given
    gone = decontaminate.clean(docs, spark.createDataFrame([(1, "plain words of a text")], "item_id long, text string"))
    assert sorted((r.doc_id or 0) for r in gone.collect()) == [0, 2, 3, 4]
    none = docs.where("false")
    assert quality.accept(none, labels).count() == decontaminate.clean(none, bench).count() == 0
    assert quality.accept(docs, labels.where("false")).columns == docs.columns


def test_pipeline_on_odd_rows(spark, tmp_path):
    docs = odd(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (4, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "an item of five words or more")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {1, 2, 3, 4, None} and sum(r.doc_id == 1 and r.start == 0 for r in got) <= 1
