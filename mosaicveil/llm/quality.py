"""Document quality by supervised subword embeddings.

Features of a text are hashed into one table: its words (as written), the 3-grams and 4-grams of characters of each word with a mark
before and behind it, and one end mark, so an empty or null text has a feature too. A document is the mean of its features' vectors;
a linear layer and softmax give the two labels' probabilities. Vectors and layer are learned by stochastic gradient descent in numpy,
on at most TRAIN_ROWS labelled documents (those with the smallest xxhash64 of the id) of at most TRAIN_BYTES of text; rows whose
crc32(id as text) mod 4 is 2 are held out and never learned from. Labels, lang, source and ids are inputs to no score. Scores of whole
texts, of any length, follow from one scalar a feature, a table of BUCKETS floats.

Rows with a null id are scored; null labels are ignored and of repeated labels the greatest counts; of several texts of a labelled id
the smallest is learned from. With no labelled rows, or rows of one label only, the model is the label's smoothed share. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc
from .textops import U64, mix, slices, trim, word_bounds, word_hashes

BUCKETS, DIMS, EPOCHS, RATE, TRAIN_ROWS, TRAIN_BYTES, THRESHOLD = 1 << 17, 16, 8, 0.5, 4096, 1 << 16, 0.7
#: Bytes of text that a worker holds features of at a time.
SLICE = 1 << 19
_SEED = 20_240_601


def characters(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 characters, each as its bytes in one number, and the place of each row's first."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    out, wide, after = buf[at].astype(np.uint32), np.r_[buf, np.zeros(3, np.uint8)], np.r_[at[1:], len(buf)]
    for k in (1, 2, 3):
        long = np.flatnonzero(after - at > k)
        out[long] |= wide[at[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out, np.searchsorted(at, offs)


def _features(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, start of each row's) for words and for the 3-grams and 4-grams of their characters."""
    mask = U64(BUCKETS - 1)
    starts, ends, rows = word_bounds(buf, offs)
    yield (word_hashes(buf, starts, ends, lower=False) & mask).astype(np.int64), np.searchsorted(rows, np.arange(len(offs)))
    chars, cut = characters(buf, offs)
    # one space stands for all; one more comes before each row and after the last
    chars, cut = np.r_[np.insert(chars, cut[:-1], np.uint32(32)), np.uint32(32)], cut + np.arange(len(cut))
    solid = (chars != 32) & ((chars < 9) | (chars > 13))
    codes = mix(np.where(solid, chars, np.uint32(32)).astype(U64) + U64(7))
    for n in (3, 4):
        m = max(0, len(codes) - n + 1)
        with np.errstate(over="ignore"):
            total = sum((codes[j : j + m] * U64((2 * (j + 3 * n) + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for j in range(n)), np.zeros(m, U64))
        inside = np.ones(m, bool)  # at most the first and the last are spaces: a gram stays in its word
        for j in range(1, n - 1):
            inside &= solid[j : j + m]
        place = np.r_[0, np.cumsum(inside)]
        yield (mix(total[inside]) & mask).astype(np.int64), place[np.minimum(cut, m)]


END_FEATURE = 0


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each training text as its distinct buckets and their counts, BUCKETS of them at most."""
    for batch in batches:
        for a, b, buf, offs in slices(batch.column(1), SLICE, 64):
            parts = list(_features(buf, offs))
            ids, counts = [], []
            for r in range(b - a):
                got = np.bincount(np.concatenate([f[s[r] : s[r + 1]] for f, s in parts]), minlength=BUCKETS)
                got[END_FEATURE] += 1
                ids.append(np.flatnonzero(got).astype(np.int32))
                counts.append(got[ids[-1]].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.tobytes() for x in counts], pa.binary())], ["quality", "buckets", "counts"])
    trim()


def train(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """(scalar of each bucket, bias): a document's logit is the mean of its features' scalars plus the bias."""
    share = (sum(y for y, *_ in rows) + 1) / (len(rows) + 2)
    if len({y for y, *_ in rows}) < 2:
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(_SEED)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    layer = np.zeros((2, DIMS), np.float32)
    bias = np.zeros(2, np.float32)
    weighed = [(y, f, (c / c.sum()).astype(np.float32)) for y, f, c in rows]
    steps, step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(weighed)):
            y, f, w = weighed[i]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            mean = w @ vectors[f]
            z = layer @ mean + bias
            e = np.exp(z - z.max())
            slope = e / e.sum()
            slope[y] -= 1
            back = slope @ layer
            layer -= rate * np.outer(slope, mean)
            bias -= rate * slope
            vectors[f] -= (rate * w)[:, None] * back[None, :]
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def _scores(buf: np.ndarray, offs: np.ndarray, scalars: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 for each text."""
    total, n = np.full(len(offs) - 1, float(scalars[END_FEATURE])), np.ones(len(offs) - 1)
    for f, cut in _features(buf, offs):
        summed = np.r_[0.0, np.cumsum(scalars[f], dtype=np.float64)]
        total += summed[cut[1:]] - summed[cut[:-1]]
        n += np.diff(cut)
    return 1 / (1 + np.exp(-np.clip(total / n + bias, -700, 700)))


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scalars, bias = shared.value
        for batch in batches:
            for a, b, buf, offs in slices(batch.column(1), SLICE):
                kept = [j for j in range(batch.num_columns) if j != 1]
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(a, b - a) for j in kept), pa.array(_scores(buf, offs, scalars, bias))], [*(batch.schema.names[j] for j in kept), "score"])
            trim()

    return run


def fit(docs: DataFrame, labels: DataFrame, held_out: int | None = 2, most_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Learn from a bounded sample of labelled rows; held_out: the remainder mod 4 to leave out."""
    spark = docs.sparkSession
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    if held_out is not None:
        marked = marked.where(F.pmod(id_crc(), F.lit(4)) != held_out)
    marked = marked.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= TRAIN_BYTES).join(F.broadcast(marked), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("quality", "text")
    got = rows.mapInArrow(_counts, "quality int, buckets binary, counts binary").toArrow()
    rows = sorted(zip(got["quality"].to_pylist(), got["buckets"].to_pylist(), got["counts"].to_pylist()))
    del got
    model = train([(y, np.frombuffer(f, np.int32), np.frombuffer(c, np.int32)) for y, f, c in rows])
    del rows
    trim()
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text", (F.pmod(id_crc(), F.lit(4)) == 2).alias("held_out"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    out = rows.mapInArrow(_scorer(shared), f"{kinds}, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Stage: documents predicted good stay, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in slices(batch.column(place), SLICE):
                yield batch.slice(a, b - a).filter(pa.array(_scores(buf, offs, *shared.value) >= THRESHOLD))
            trim()

    return docs.mapInArrow(run, docs.schema)
