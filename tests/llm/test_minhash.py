import re
from collections import defaultdict

import numpy as np

from mosaicveil.llm import minhash
from mosaicveil.llm.queries import queries


def brute(rows):
    """Components by comparing every two sets that share a shingle."""
    sets = {}
    for i, text in rows:
        low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    having, up = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for x in s:
            having[x].append(i)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for j in having[x]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_query_equals_brute_force(spark, sf):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries()["op1_minhash_near_dedup"](spark, sf).collect()}
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
    assert got == want


def test_edge_rows(spark):
    long = " ".join(f"w{k}" for k in range(400))
    near = long.replace("w7 ", "other ").upper()
    rows = [(5, None, "x"), (4, "", "x"), (3, " \t\n", "x"), (9, "One two", "x"), (7, "one\x0btwo", "x"), (20, long, "x"), (21, near, "x"), (22, long, "x"), (None, long, "x"), (30, "é É", "x"), (31, "É é", "x"), (40, "v" * 300_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got[5] == (0, 5, True) and got[4] == (0, 4, True) and got[3] == (0, 3, True)
    assert got[7] == (1, 7, True) and got[9] == (1, 7, False)
    assert got[20] == (396, 20, True) and got[21][1] == got[22][1] == 20
    assert got[30][1] == 30 and got[31][1] == 31 and got[40] == (1, 40, True)
    assert got[None][1] is None
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_repeated_rows_share_a_vertex(spark):
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    df = spark.createDataFrame([(1, a), (1, a), (2, b), (2, a)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect()} == {(1, 1), (2, 1)}


def test_each_text_of_a_repeated_id_is_compared(spark):
    a, b = " ".join(f"a{k}" for k in range(50)), " ".join(f"b{k}" for k in range(50))
    df = spark.createDataFrame([(1, a), (1, b), (5, b + " more"), (6, a + " more"), (9, "alone")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == {(1, 1), (5, 1), (6, 1), (9, 9)}
    assert sorted((r.doc_id, r.text) for r in minhash.one_of_each(df).collect()) == [(1, a), (1, b), (9, "alone")]


def test_long_words_hash_alike_in_pieces(monkeypatch):
    from mosaicveil.llm import textops

    buf = np.frombuffer(b"Ab" * 500 + b" x " + b"yZ" * 40, np.uint8)
    starts, ends, _ = textops.word_bounds(buf, np.array([0, len(buf)]))
    whole = textops.word_hashes(buf, starts, ends)
    monkeypatch.setattr(textops, "_PIECE", 64)
    assert (textops.word_hashes(buf, starts, ends) == whole).all() and len(whole) == 3


def test_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in minhash.components(edges).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, 100: 100, 101: 100}


def test_one_stays_of_each_group(spark):
    text = " ".join(f"w{k}" for k in range(80))
    df = spark.createDataFrame([(2, text, "x"), (1, text + " more", "y"), (3, "alone", "z")], "doc_id long, text string, note string")
    assert sorted(r.doc_id for r in minhash.one_of_each(df).collect()) == [1, 3]
    twice = df.unionByName(df).unionByName(spark.createDataFrame([(1, "another text", "w"), (None, text, "v"), (7, "", "u"), (7, "", "u"), (8, None, "u")], df.schema))
    got = sorted((r.doc_id or 0, r.text) for r in minhash.one_of_each(twice).collect() if r.doc_id != 8)
    assert got == [(0, text), (1, "another text"), (1, text + " more"), (3, "alone"), (7, "")]


def test_groups_of_loosely_like_texts_equal_brute_force(spark):
    """Variants of a few texts: within a bucket many are unlike its smallest id, and chains join them."""
    rng = np.random.default_rng(7)
    rows = []
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(120)]
        for k in range(60):
            words = list(base)
            for place in rng.choice(120, rng.integers(1, 7), replace=False):
                words[place] = f"x{rng.integers(1 << 40)}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == brute([(int(i), t) for i, t in rows])


def test_every_size_of_blocks_finds_every_link(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base, rows = [f"w{k}" for k in range(80)], []
    for k in range(120):
        words = list(base)
        for place in rng.choice(80, rng.integers(0, 5), replace=False):
            words[place] = f"x{rng.integers(1 << 40)}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (3, 2048):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
        assert got == brute(rows)


def test_bitmaps_never_refuse_a_like_pair(spark):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for k in range(256):
        n, cut = int(rng.integers(1, 90)), int(rng.integers(0, 30))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.r_[a[min(cut, n - 1) :], rng.integers(0, 2**63, int(rng.integers(0, 20)), dtype=np.uint64)]
        size, _, _, bits = minhash.sketch(np.r_[a, b], np.r_[np.zeros(len(a), int), np.ones(len(b), int)], 2)
        both = len(np.intersect1d(a, b))
        want.append(100 * both >= 75 * (len(a) + len(b) - both))
        rows.append((k, int(size[0]), bits[0].tolist(), int(size[1]), bits[1].tolist()))
    df = spark.createDataFrame(rows, "k long, n long, bits array<long>, c_n long, c_bits array<long>")
    df = df.select("k", "n", *minhash.marks("bits"), "c_n", *minhash.marks("c_bits", "c_"))
    passed = {r.k for r in df.where(minhash._possible(75)).collect()}
    like = {k for k, w in enumerate(want) if w}
    assert like and like <= passed and len(passed) < len(like) + 60


def test_densified_bins_agree_with_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 60, dtype=np.uint64)
    rows = np.r_[np.zeros(60, int), np.ones(60, int)]
    size, digest, band, _ = minhash.sketch(np.r_[a, a], rows, 2)
    assert size.tolist() == [60, 60] and (digest[:, 0] == digest[:, 1]).all() and (band[0] == band[1]).all()
