import hashlib
import random

import numpy as np
import pytest

from mosaicveil.llm import suffixdedup as S
from mosaicveil.llm.queries import queries

L = S.LENGTH


def brute(rows):
    """rows: (id, text) in the order that counts; every window against all earlier ones."""
    seen, out = set(), []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - L + 1):
            w = hashlib.md5(data[at : at + L]).digest()
            if w in seen:
                gone[at : at + L] = b"\1" * L
            else:
                seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


def test_query_equals_brute_force(spark, sf):
    got = [tuple(r) for r in queries()["op9_suffix_array_dedup"](spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    assert sorted(got) == sorted(brute(rows))


@pytest.mark.parametrize("shard", [S.SHARD, 2000])
def test_planted_repeats(spark, shard):
    rng = random.Random(shard)
    passage = "".join(rng.choice("abcdé \n") for _ in range(400))
    rows = [(5, None), (6, ""), (9, "x" * 5000), (10, "ab" * 700), (11, passage), (12, "q" + passage), (3, "\0" * 150), (4, "\0" * 99)]
    rows += [(100 + k, "".join(rng.choice("efgh") for _ in range(rng.randrange(120))) + passage[rng.randrange(100) : rng.randrange(200, 400)] + str(k)) for k in range(60)]
    df = spark.createDataFrame([(i, t, "y") for i, t in rows], "doc_id long, text string, doc string").repartition(5)
    got = [tuple(r) for r in S.remove_repeats(df, shard).collect()]
    assert sorted(got) == sorted(brute(sorted(rows)))
    assert S.remove_repeats(df.where("false")).count() == 0


def test_repeated_and_null_ids(spark):
    text = "".join(chr(97 + (k * k) % 23) for k in range(300))
    rows = [(None, text), (1, text), (1, text), (2, "z" * 50)]
    got = sorted((tuple(r) for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=key)
    assert got == sorted(brute([(None, text), (1, text), (1, text), (2, "z" * 50)]), key=key)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    text = rng.integers(97, 99, 600).astype(np.uint8)
    text[300:500] = text[50:250]
    sa = S.suffix_array(text, 600)
    raw = text.tobytes()
    assert sa.tolist() == sorted(range(600), key=lambda i: raw[i:])
    lcp = S.common_prefixes(text, sa, np.arange(0, 600, 100), 400)
    for k in range(1, 600):
        a, b = raw[sa[k - 1] :], raw[sa[k] :]
        assert lcp[k] == next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_binary_search_finds_windows():
    rng = np.random.default_rng(4)
    text = rng.integers(0, 3, 2000).astype(np.uint8)
    sa = S.suffix_array(text)
    sa = sa[sa <= 1900]
    queries_ = np.array([text[k : k + 100] for k in (0, 17, 1900)] + [rng.integers(0, 3, 100).astype(np.uint8)])
    hit = S.find(text, sa, queries_)
    assert sa[hit[:3]].tolist() == [0, 17, 1900] and hit[3] == -1
