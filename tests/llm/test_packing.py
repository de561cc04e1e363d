import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from mosaicveil.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, pieces, capacity=2048):
    t = Tokenizer.from_file(PATH)
    want = [(i, t.encode(x or "", add_special_tokens=False).ids + [1]) for i, x in rows]
    by = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
    for i, ids in want:
        at = 0
        for p in sorted(by[i], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    used = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == used.get(p.sequence_id, 0)
        used[p.sequence_id] = p.offset + p.length
    assert max(used.values(), default=0) <= capacity
    return sum(capacity - u for u in used.values()), len(used)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    pad, n = check(rows, packing.pack(docs, PATH).collect())
    assert pad < 2048 * docs.rdd.getNumPartitions() + 1 and pad / (n * 2048) < 0.02


def test_odd_texts(spark):
    texts = [None, "", "it's THE 'sun' don't 've", "<|endoftext|> a <|startoftext|>", "ΟΔΟΣ Σ ς", "é é İ ß ſ K", "x\x1cy\x85z w", "漢字 кириллица 12½ ²³ a1b2", "…—“”€ $$$ ### a_b_c __", "퟿", "a" * 30_000, "hello " * 9000, "'''ll 'd're", "ño İI", "🙂 ok"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, sequence_id string").coalesce(1)
    check(rows, packing.pack(df, PATH).collect())
    assert packing.pack(df.where("false"), PATH).count() == 0


def test_encoder_equals_tokenizer_on_all_documents(spark):
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 3 = 0").select("text").collect()]
    t, e = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(rows)] == [x.ids + [1] for x in t.encode_batch(rows, add_special_tokens=False)]


def test_heavier_rows_go_to_lighter_sequences():
    sizes = np.array([900, 900, 700, 700, 300, 300])
    got = packing.assign(sizes, 2000)
    cost = {}
    for _, _, n, b, _ in got:
        cost[b] = cost.get(b, 0) + n + n * n / 1024
    assert len(cost) == 2 and abs(cost[0] - cost[1]) < 1
