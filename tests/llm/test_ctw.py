import glob
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from mosaicveil.llm import common, ctw
from mosaicveil.llm.textops import buffers


def brute(train, text, depth):
    """log10 probability by the plain recursion over a dictionary of nodes; every context is kept."""
    tree = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)

    def symbols(t):
        data = [0xFE] * depth + list(t.encode()) + [0xFF]
        return [(data[k - depth : k], data[k]) for k in range(depth, len(data))]

    for t in train:
        for before, s in symbols(t):
            for d in range(depth + 1):
                own = tuple(before[len(before) - d :])
                for level in range(8):
                    tree[own, (1 << level) | (s >> (8 - level))][(s >> (7 - level)) & 1] += 1
                if d:
                    kids[own[1:]].add(own)
    weighed = {}

    def pw(own, node):
        if (own, node) not in weighed:
            z, o = tree.get((own, node), (0, 0))
            kt = math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
            if len(own) == depth:
                weighed[own, node] = kt
            else:
                below = sum(pw(k, node) for k in kids[own])
                weighed[own, node] = np.logaddexp(kt, below) - math.log(2)
        return weighed[own, node]

    def p_one(before, d, node):
        own = tuple(before[len(before) - d :])
        z, o = tree.get((own, node), (0, 0))
        if z + o == 0:
            return 0.5
        kt = (o + 0.5) / (z + o + 1)
        if d == depth:
            return kt
        log_kt = math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
        sigma = 1 / (1 + math.exp(min(500, sum(pw(k, node) for k in kids[own]) - log_kt)))
        return sigma * kt + (1 - sigma) * p_one(before, d + 1, node)

    total = 0.0
    for before, s in symbols(text):
        for level in range(8):
            p = p_one(before, 0, (1 << level) | (s >> (8 - level)))
            total += math.log10(p if (s >> (7 - level)) & 1 else 1 - p)
    return total


def test_scores_equal_plain_recursion(spark):
    train = ["abracadabra abracad", "the cat and the hat", "", "café cab"]
    rows = [k for k in range(100) if zlib.crc32(str(k).encode()) % 10][: len(train)]
    docs = spark.createDataFrame(list(zip(rows, train)), "doc_id long, text string")
    model, _ = ctw.fit(docs, depth=3)
    for text in ["abra", "the car", "", "zzz é", "tha\n"]:
        keys, _ = ctw.grams(*buffers(pa.array([text])), 3)
        assert math.isclose(model.log2(keys).sum() * math.log10(2), brute(train, text, 3), rel_tol=1e-4)


def test_probabilities_add_up_to_one(spark):
    docs = spark.createDataFrame([(k, "some words here and there %d" % k) for k in range(300)], "doc_id long, text string")
    model, _ = ctw.fit(docs, depth=4, capacity=200)
    for before in (b"word", b"zqxj", b"e an"):
        context = sum(c << (8 * (k + 1)) for k, c in enumerate(reversed(before)))
        keys = np.arange(256, dtype=np.uint64) | np.uint64(context)
        assert abs((2 ** model.log2(keys)).sum() - 1) < 1e-4


def test_base_and_rows(spark):
    texts = ["The cat the dog", "dog\x0bDOG é É", None, "", "x" * 100_000, "the end", "cat cat", "new words", "the the", "one", "two", "zebra the"]
    docs = spark.createDataFrame([(k, t, "a") for k, t in enumerate(texts)] + [(None, "the", "a"), (3, "twice", "a")], "doc_id long, text string, score string")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    all_rows = [(r.doc_id, r.text) for r in docs.collect()]
    c = Counter(w for i, t in all_rows if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(tok(t)), sum(w in c for w in tok(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok(t)), 6)) for i, t in all_rows)
    for frequent in (ctw.FREQUENT, 2):
        got = ctw.score(docs, frequent).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert ctw.score(docs.where("false")).count() == 0


def test_every_context_counts(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(97, 123, 500))) for _ in range(600)] + ["", "é", "unlike 1234"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 10]
    entries = []
    for d in range(ctw.DEPTH + 1):
        keys, n = np.unique(ctw.grams(*buffers(pa.array(train)), d)[0], return_counts=True)
        entries.append((keys, n))
    assert sum(len(k) for k, _ in entries) > 1 << 19  # what a tree could hold when it had a capacity
    model = ctw.Model(entries)
    got = {r.doc_id: r.score for r in ctw.score(docs).select("doc_id", "score").collect()}
    for k, t in enumerate(texts):
        want = model.log2(ctw.grams(*buffers(pa.array([t])))[0]).sum() * math.log10(2)
        assert math.isclose(got[k], want, rel_tol=1e-4)


def test_scored_rows_equal_plain_recursion(spark):
    texts = ["abracadabra abracad", "the cat and the hat", "", "café cab", "tha\n", "abra the car", "zzz é"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = [t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 10]
    for r in ctw.score(docs, slice_bytes=40).collect():
        assert math.isclose(r.score, brute(train, texts[r.doc_id], ctw.DEPTH), rel_tol=1e-4)


def test_shards_follow_the_text(spark, monkeypatch):
    """More text makes more shards, whatever the number of shuffle partitions, and the same scores."""
    docs = spark.createDataFrame([(k, f"text {k} of words {k * 7} " * 20) for k in range(60)], "doc_id long, text string")
    dealt, whole = [], ctw.answers
    monkeypatch.setattr(ctw, "answers", lambda packed, shards: dealt.append(shards) or whole(packed, shards))
    scores = []
    for size in (ctw.TASK, 2000):
        monkeypatch.setattr(ctw, "TASK", size)
        scores.append({r.doc_id: r.score for r in ctw.score(docs, slice_bytes=3000).collect()})
    least = ctw.SHARDS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt[0] == least < dealt[1]
    assert all(abs(scores[1][k] - v) < 1e-3 for k, v in scores[0].items()) and len(scores[1]) == 60


def test_slices_reach_python_one_by_one(spark, monkeypatch):
    asker = ctw._asker

    def alone(shards):
        run = asker(shards)

        def seen(batches):
            for b in batches:
                assert len(b) == 1, len(b)
                yield from run(iter([b]))

        return seen

    monkeypatch.setattr(ctw, "_asker", alone)
    docs = spark.createDataFrame([(k, f"some words {k * k} " * 40) for k in range(200)], "doc_id long, text string").coalesce(1)
    assert ctw.score(docs, slice_bytes=1 << 12).count() == 200
    assert spark.conf.get(common._BATCH, None) is None


def test_large_rows_are_kept_in_small_row_groups(spark):
    kept = common.keep(spark.range(0, 24, 1, 1).selectExpr("id", "array_join(transform(sequence(1, 30000), k -> sha2(concat(id, ' ', k), 256)), '') AS x"), "large", large=True)
    (part,) = glob.glob(kept.kept_at.removeprefix("file://") + "/part-*")
    told = pq.read_metadata(part)
    assert max(told.row_group(k).total_byte_size for k in range(told.num_row_groups)) < 16 << 20 and kept.count() == 24
