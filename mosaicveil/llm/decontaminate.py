"""Benchmark leaks by a BM25 inverted index of the test items and block-max WAND.

Items of five words and more are indexed by word: a posting's impact is its BM25 weight, divided by what the item must at least
score, so every item's threshold is 1. That least score loses nothing: a passage with 0.75 of an item's five-word shingles lacks at
most a quarter of them, so as many words at most, and the threshold leaves out the impacts of just the heaviest so many words.
Items lie in blocks; each term has its greatest impact in each block where it occurs, and its greatest of all. Every training passage (a
window of three times the longest item's words, moving by the longest item's words, so an occurrence lies whole in a window, also one
with as many foreign words put in as the longest item has) queries the index. Passages for which no block's maxima add up to 1 go at
once, for many passages together; the others traverse the postings: cursors in order of items, a pivot where the terms' maxima reach 1,
the pivot's block and those after it passed over up to the next one whose maxima do, the pivot scored once all cursors have come up to
it. Items that reach 1 are verified: at least 0.75 of the item's five-word shingles occur in the passage, and half of those of its question (all
words but the answer's) and of its answer (its last quarter, five words at least).

The index is broadcast in groups of about GROUP_BYTES of item text; all it holds is in proportion to that. Null and empty texts are
never contaminated; repeated ids are judged row by row, items with a null id or under five words are left out; an empty benchmark
leaves every row clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import _STEP, U64, mix, slices, trim, word_bounds, word_hashes

K1, B, BLOCK, MOST_BLOCKS, SHARE, PART, GROUP_BYTES = 1.2, 0.75, 8, 256, 0.75, 0.5, 4 << 20
#: Passages that are bounded at a time; what sums of floats may be short of.
STEP, SLACK = 4096, 1e-6
#: Length of a passage, in words of the longest item.
WINDOW = 3


def _words(text: str) -> np.ndarray:
    buf = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends, _ = word_bounds(buf, np.array([0, len(buf)]))
    return word_hashes(buf, starts, ends)


def _grams(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of the k words from each place on, one value shorter by k - 1 than words."""
    n = max(0, len(words) - k + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n, U64)
        for j in range(k):
            total += words[j : j + n] * _STEP[j]
        return mix(total)


@dataclass
class Index:
    ids: np.ndarray  # of the items
    terms: np.ndarray  # sorted word hashes
    first: np.ndarray  # of each term's postings
    items: np.ndarray  # postings by term, then item
    places: np.ndarray  # the same as numbers: term in the upper 32 bits, item in the lower
    impacts: np.ndarray
    block: int  # items of a block
    top: np.ndarray  # each term's greatest impact
    b_first: np.ndarray  # of each term's blocks
    blocks: np.ndarray  # blocks where the term occurs, ascending
    maxima: np.ndarray  # the term's greatest impact there
    whole: list[np.ndarray]  # distinct shingles of each item
    question: list[np.ndarray]
    answer: list[np.ndarray]
    span: int  # words of the longest item

    @staticmethod
    def build(rows: list[tuple[int, str]]) -> "Index | None":
        docs = [(i, w) for i, w in ((i, _words(t)) for i, t in sorted(rows, key=lambda r: (r[0], r[1] or ""))) if len(w) >= 5]
        if not docs:
            return None
        mean = np.mean([len(w) for _, w in docs])
        counted = [np.unique(w, return_counts=True) for _, w in docs]
        terms, df = np.unique(np.concatenate([t for t, _ in counted]), return_counts=True)
        idf = np.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
        posts, whole = [], []
        for n, ((_, w), (t, tf)) in enumerate(zip(docs, counted)):
            at = np.searchsorted(terms, t)
            weight = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            shingles = np.unique(_grams(w))
            whole.append(shingles)
            lost = int((1 - SHARE) * len(shingles))
            least = weight.sum() - np.sort(weight)[::-1][:lost].sum()
            posts.append((at, np.full(len(at), n), weight / max(least, 1e-9) * (1 + 1e-9)))
        at, item, impact = (np.concatenate(x) for x in zip(*posts))
        order = np.lexsort((item, at))
        at, item, impact = at[order], item[order], impact[order]
        block = max(BLOCK, -(-len(docs) // MOST_BLOCKS))
        place = at * (1 << 32) + item // block
        new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        maxima, own = np.maximum.reduceat(impact, new), at[new]
        b_first = np.searchsorted(own, np.arange(len(terms) + 1))
        top = np.maximum.reduceat(maxima, b_first[:-1])
        cut = [max(5, -(-len(w) // 4)) for _, w in docs]
        question = [np.unique(_grams(w[: len(w) - c])) for (_, w), c in zip(docs, cut)]
        answer = [np.unique(_grams(w[len(w) - c :])) for (_, w), c in zip(docs, cut)]
        return Index(np.array([i for i, _ in docs], np.int64), terms, np.searchsorted(at, np.arange(len(terms) + 1)), item, at.astype(np.int64) << 32 | item, impact, block, top, b_first, item[new] // block, maxima, whole, question, answer, max(len(w) for _, w in docs))

    def candidates(self, passage: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) that reach the threshold, from the distinct (passage, term) pairs in order of passage, of n passages."""
        out_p, out_i, n_blocks = [], [], -(-len(self.ids) // self.block)
        for low in range(0, n, STEP):  # a bounded table of passages and blocks at a time
            x, y = np.searchsorted(passage, (low, low + STEP))
            t, size = term[x:y], self.b_first[term[x:y] + 1] - self.b_first[term[x:y]]
            flat = np.repeat(self.b_first[t] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            cell = np.repeat(passage[x:y] - low, size) * n_blocks + self.blocks[flat]
            bound = np.bincount(cell, self.maxima[flat], min(STEP, n - low) * n_blocks).reshape(-1, n_blocks)
            for q in (np.flatnonzero(bound.max(1) >= 1 - SLACK) + low).tolist():
                a, b = x + np.searchsorted(passage[x:y], (q, q + 1))
                hits = self.traversed(term[a:b], bound[q - low])
                out_p += [q] * len(hits)
                out_i += hits
        return np.array(out_p, np.int64), np.array(out_i, np.int64)

    def traversed(self, terms: np.ndarray, bound: np.ndarray) -> list[int]:
        """Items of which a passage's distinct terms add up to 1, by block-max WAND; bound: what the terms' maxima add up to in each block."""
        open_, done, hits = np.flatnonzero(bound >= 1 - SLACK), len(self.ids), []
        stop, top, base = self.first[terms + 1], self.top[terms], terms.astype(np.int64) << 32

        def moved(to: int) -> tuple[np.ndarray, np.ndarray]:
            """All cursors at that item or the first one after it; where each then stands."""
            at = np.searchsorted(self.places, base + to)
            return at, np.where(at < stop, self.items[np.minimum(at, len(self.items) - 1)], done)

        to = int(open_[0]) * self.block if len(open_) else done
        while to < done:
            at, now = moved(to)
            order = np.argsort(now, kind="stable")
            reach = int(np.searchsorted(np.cumsum(top[order]), 1 - SLACK))
            if reach == len(order) or now[order[reach]] == done:
                break
            pivot = int(now[order[reach]])  # no item before it can reach 1: cursors there move up to it at once
            k = int(np.searchsorted(open_, pivot // self.block))
            if k == len(open_):
                break
            if open_[k] != pivot // self.block:  # its block's maxima don't reach 1, nor do those of the blocks up to the next open one
                to = int(open_[k]) * self.block
                continue
            if pivot != to:
                at, now = moved(pivot)
            here = now == pivot
            if self.impacts[at[here]].sum() >= 1 - SLACK:
                hits.append(pivot)
            to = pivot + 1
        return hits

    def verified(self, grams: np.ndarray, item: int) -> float:
        """Share of the item's shingles in the passage; 0 if question or answer is missing."""
        has = lambda x: 1.0 if not len(x) else float(np.isin(x, grams).mean())
        share = has(self.whole[item])
        return share if share >= SHARE and has(self.question[item]) >= PART and has(self.answer[item]) >= PART else 0.0


def _search(index: Index, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[dict[int, float]]]:
    """Passages of each row, and the items found in it with their overlap."""
    n, step = len(offs) - 1, index.span
    starts, ends, rows = word_bounds(buf, offs)
    words = word_hashes(buf, starts, ends)
    term = np.searchsorted(index.terms, words)
    term[term == len(index.terms)] = 0
    known = index.terms[term] == words if len(words) else np.zeros(0, bool)
    count = np.bincount(rows, minlength=n)
    begin = np.cumsum(count) - count
    chunks = -(-count // step)  # passages of a row; the last may be short
    base = np.cumsum(chunks) - chunks
    at = np.flatnonzero(known)
    chunk = (at - begin[rows[at]]) // step
    one = base[rows[at]] + chunk
    back = [chunk >= j for j in range(WINDOW)]  # a word lies in so many windows
    key = np.concatenate([(one[b] - j) * (1 << 32) + term[at][b] for j, b in enumerate(back)])
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    p, item = index.candidates(key >> 32, key & ((1 << 32) - 1), int(chunks.sum()))
    found: list[dict[int, float]] = [{} for _ in range(n)]
    of = np.searchsorted(base + chunks, p, "right")
    for q in np.unique(p).tolist():
        r = int(of[p == q][0])
        x = begin[r] + (q - base[r]) * step
        grams = _grams(words[x : min(x + WINDOW * step, begin[r] + count[r])])
        for i in item[p == q].tolist():
            share = index.verified(grams, i)
            if share:
                found[r][int(index.ids[i])] = max(share, found[r].get(int(index.ids[i]), 0.0))
    return chunks, found


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in slices(batch.column(1), 1 << 20):
                chunks, found = _search(shared.value, buf, offs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(chunks.astype(np.int64)), pa.array([sorted(f) for f in found], pa.list_(pa.int64())), pa.array([max(f.values(), default=0.0) for f in found], pa.float64()), batch.column(2).slice(a, b - a)],
                    ["doc_id", "n_passages", "item_ids", "overlap", "digest"],
                )
        trim()

    return run


def _groups(items: DataFrame, most_bytes: int | None = None) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """How many groups of bounded text size the benchmark has, and the groups, one at a time on the driver."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // (most_bytes or GROUP_BYTES)))
    return n, ([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == g).collect()] for g in range(n))


def leaks(docs: DataFrame, items: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """doc_id, contaminated, item_ids, overlap, n_passages for each row of docs (doc_id, text)."""
    rows, parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), []
    n, groups = _groups(items, most_bytes)
    # only needed to bring the results of several groups together, row by row
    rows = rows.withColumn("digest", F.sha2("text", 256) if n > 1 else F.lit(None).cast("string"))
    for group in groups:
        index = Index.build(group)
        if index is not None:
            parts.append(rows.mapInArrow(_finder(docs.sparkSession.sparkContext.broadcast(index)), "doc_id long, n_passages long, item_ids array<long>, overlap double, digest string"))
    if not parts:
        out = rows.select("doc_id", F.lit(0).cast("long").alias("n_passages"), F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("overlap"))
    elif len(parts) == 1:
        out = parts[0]
    else:
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        found = F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids"))))
        out = out.groupBy("doc_id", "digest").agg(F.max("n_passages").alias("n_passages"), found.alias("item_ids"), F.max("overlap").alias("overlap"), (F.count("*") / len(parts)).cast("int").alias("rows"))
        out = out.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "overlap", "n_passages")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Stage: rows without a leaked item stay, as they are."""
    place = docs.columns.index("text")
    for group in _groups(items)[1]:
        index = Index.build(group)
        if index is not None:
            docs = docs.mapInArrow(_keeper(docs.sparkSession.sparkContext.broadcast(index), place), docs.schema)
    return docs


def _keeper(shared, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in slices(batch.column(place), 1 << 20):
                yield batch.slice(a, b - a).filter(pa.array([not f for f in _search(shared.value, buf, offs)[1]], pa.bool_()))
        trim()

    return run
