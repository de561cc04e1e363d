"""Removal of repeated passages by suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document of smaller id, or earlier in its own.
Strings are judged on the input and do not cross documents. Five steps, each one shuffle of packed arrays:

1. Every window of LENGTH bytes has an anchor, the GRAM-byte string in it with the least hash, leftmost of equals. Equal windows
   have equal anchors at equal places, so only an anchor's 64-bit hash and place travel, one for some 35 bytes of text.
2. Anchors seen once in the corpus are dropped. A hash that a slice of text has twice is sent once, so a passage that a third of all
   rows hold costs a row per slice here.
3. For the rest, the stretch of text with all windows of that anchor (168 bytes at most) goes to a shard chosen by the anchor's hash;
   equal stretches of a slice are sent once, and a shard
   keeps the earliest of equal ones.
4. A shard (SHARD bytes at most) sorts its suffixes by Larsson-Sadakane refinement, the rank of place i + h splitting the groups
   that agree on h bytes; common prefixes follow by Kasai's lemma. Windows of a class, that is with common prefixes of LENGTH and
   more between them, all go but the earliest. A group larger than a shard is cut into several; each finds its windows in the suffix
   arrays of the earlier ones by binary search.
5. The runs of windows to go meet their document, which is hashed without the bytes they cover.

Nulls and texts shorter than LENGTH lose nothing. A null id sorts before all others; rows of one id sort by text and are judged as
separate documents (equal rows: all but one go). Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions
from .textops import _BYTE, U64, mix, slices, trim

LENGTH, GRAM, SHARD, SPREAD, CHUNK, SEND = 100, 32, 3 << 19, 2, 1 << 13, 1 << 19
#: Bytes of text for each task at most, on average.
BUCKET = 32 << 20
_STEPS = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0xD6E8FEB86659FD93), U64(0xFF51AFD7ED558CCD)]
_SENT = "bucket long, kind int, fp binary, doc binary, seq binary, at binary, data binary"
_NAMES = [x.split()[0] for x in _SENT.split(", ")]


# --- suffix arrays -------------------------------------------------------------------------------------------------------------


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes in order of their first `depth` bytes at least (a shorter one first among equals)."""
    n = len(text)
    padded = np.r_[text, np.zeros(8, np.uint8)]
    key = np.zeros(n, U64)
    for j in range(8):
        key = (key << U64(8)) | padded[j : j + n].astype(U64)
    sa = np.argsort(key).astype(np.int64)
    key = key[sa]
    place = np.arange(n)
    new = np.r_[True, key[1:] != key[:-1]] if n else np.zeros(0, bool)
    rank = np.zeros(n + 1, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, place, 0)) + 1 if n else 0
    rank[n] = 0
    alone = new & np.r_[new[1:], True] if n else new
    open_ = place[~alone]
    h = 8
    while h < depth and len(open_):
        s = sa[open_]
        pair = (rank[s].astype(U64) << U64(32)) | rank[np.minimum(s + h, n)].astype(U64)
        order = np.argsort(pair)
        s, pair = s[order], pair[order]
        sa[open_] = s
        new = np.r_[True, pair[1:] != pair[:-1]]
        rank[s] = np.maximum.accumulate(np.where(new, open_, 0)) + 1
        open_ = open_[~(new & np.r_[new[1:], True])]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in sa, exact up to most minus the longest distance between starts.

    Kasai's lemma: where the bytes before both suffixes agree, the prefix is one shorter than that of the place before. So only the
    other places, and those in starts, are compared, eight bytes a step.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    prior = before > 0
    prior[0] = False
    same = np.zeros(n, bool)
    at = np.flatnonzero(prior)
    same[at] = (text[at - 1] == text[before[at] - 1]) & (before[at - 1] == before[at] - 1)
    own = ~same
    own[starts] = True
    todo = np.flatnonzero(own & (before >= 0))
    length = np.zeros(n, np.int64)
    padded = np.r_[text, np.zeros(8, np.uint8)]
    word = np.zeros(n + 1, U64)
    for j in range(8):
        word[:n] = (word[:n] << U64(8)) | padded[j : j + n].astype(U64)
    done = 0
    while len(todo) and done < most:
        a, b = np.minimum(todo + done, n), np.minimum(before[todo] + done, n)
        gap = word[a] ^ word[b]
        full = gap == 0
        part = gap[~full]
        equal = np.zeros(len(part), np.int64)
        for shift in (32, 16, 8):
            high = (part >> U64(64 - shift)) == 0
            equal += np.where(high, shift // 8, 0)
            part = np.where(high, part << U64(shift), part)
        length[todo[~full]] = done + equal
        todo = todo[full]
        done += 8
        length[todo] = done
    length = np.minimum(length, n - np.maximum(place, before))
    source = np.maximum.accumulate(np.where(own, place, 0))
    return np.maximum(length[source] - (place - source), 0)[sa]


def find(text: np.ndarray, sa: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Place in sa of a suffix that starts with each query (rows of equal length), or -1: binary search. sa holds full windows only."""
    low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(sa), np.int64)
    width = np.arange(queries.shape[1])
    while (low < high).any():
        live = np.flatnonzero(low < high)
        mid = (low[live] + high[live]) // 2
        gap = text[sa[mid][:, None] + width] != queries[live]
        at = gap.argmax(1)
        row = np.arange(len(live))
        less = gap[row, at] & (text[sa[mid] + at] < queries[live, at])
        low[live[less]] = mid[less] + 1
        high[live[~less]] = mid[~less]
    ok = np.flatnonzero(low < len(sa))
    out = np.full(len(queries), -1, np.int64)
    hit = (text[sa[low[ok]][:, None] + width] == queries[ok]).all(1) if len(ok) else np.zeros(0, bool)
    out[ok[hit]] = low[ok[hit]]
    return out


class Shard:
    """Stretches of text with windows at their first places, their suffix array and the classes of equal windows."""

    def __init__(self, text, starts, windows, doc, seq, first):
        self.text = text
        count = np.repeat(np.arange(len(starts)), windows)
        inner = np.arange(len(count)) - np.repeat(np.cumsum(windows) - windows, windows)
        place = starts[count] + inner
        sa = suffix_array(text)
        size = np.diff(np.r_[starts, len(text)])
        lcp = common_prefixes(text, sa, starts, LENGTH + int(size.max(initial=0)) + 8)
        group = np.zeros(len(text), np.int64)
        group[sa] = np.cumsum(lcp < LENGTH)
        mark = np.full(len(text), -1, np.int64)
        mark[place] = np.arange(len(place))
        self.place, self.group = place, group[place]
        self.doc, self.seq, self.at = doc[count], seq[count], first[count] + inner
        order = np.lexsort((self.at, self.seq, self.doc, self.group))
        lead = np.r_[True, self.group[order][1:] != self.group[order][:-1]] if len(order) else np.zeros(0, bool)
        self.gone = np.ones(len(place), bool)
        self.gone[order[lead]] = False
        in_sa = mark[sa]
        in_sa = in_sa[in_sa >= 0]
        self.sorted = in_sa[~self.gone[in_sa]]  # the earliest of each class, in order of their bytes

    def meet(self, other: "Shard") -> None:
        """Of a window that both have, the later goes."""
        mine = self.sorted[~self.gone[self.sorted]]
        for at in range(0, len(mine), 100_000):
            own = mine[at : at + 100_000]
            hit = find(other.text, other.place[other.sorted], self.text[self.place[own][:, None] + np.arange(LENGTH)])
            own, theirs = own[hit >= 0], other.sorted[hit[hit >= 0]]
            key = lambda s, r: (s.doc[r], s.seq[r], s.at[r])
            a, b = key(self, own), key(other, theirs)
            later = (a[0] > b[0]) | (a[0] == b[0]) & ((a[1] > b[1]) | (a[1] == b[1]) & (a[2] > b[2]))
            self.gone[own[later]] = True
            other.gone[theirs[~later]] = True

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc, seq, first window, windows) of the runs of windows to go."""
        doc, seq, at = self.doc[self.gone], self.seq[self.gone], self.at[self.gone]
        return join_runs(doc, seq, at, np.ones(len(at), np.int64))


def join_runs(doc, seq, at, n):
    order = np.lexsort((at, seq, doc))
    doc, seq, at, n = doc[order], seq[order], at[order], n[order]
    if not len(doc):
        return doc, seq, at, n
    new = np.r_[True, (doc[1:] != doc[:-1]) | (seq[1:] != seq[:-1]) | (at[1:] != at[:-1] + n[:-1])]
    first = np.flatnonzero(new)
    return doc[first], seq[first], at[first], np.add.reduceat(n, first)


# --- anchors -------------------------------------------------------------------------------------------------------------------


def anchors(buf: np.ndarray, offs: np.ndarray):
    """(row, hash, first window, windows) of each anchor of the rows' windows; places count within the row."""
    n = len(buf)
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return empty, np.zeros(0, U64), empty, empty
    with np.errstate(over="ignore"):
        h = _BYTE[buf]
        for level, step in enumerate(_STEPS):
            w = 1 << level
            h = h[:-w] * step + h[w:]
        h = mix(h)
    low = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
    w, span = 1, LENGTH - GRAM + 1
    while 2 * w <= span:
        low = np.minimum(low[:-w], low[w:])
        w *= 2
    low = np.minimum(low[: len(low) - (span - w)], low[span - w :])
    best = (low & U64(0xFFFFFFFF)).astype(np.int64)  # of the window at each place
    size = np.diff(offs)
    valid = np.repeat(np.arange(len(size)), np.maximum(size - LENGTH + 1, 0))
    many = np.maximum(size - LENGTH + 1, 0)
    place = np.arange(len(valid)) - np.repeat(np.cumsum(many) - many, many)
    if not len(valid):
        return empty, np.zeros(0, U64), empty, empty
    best = best[place + offs[valid]]
    first = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (valid[1:] != valid[:-1])])
    return valid[first], h[best[first]], place[first], np.diff(np.r_[first, len(best)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _NAMES)


def _split(buckets: np.ndarray, kind: int, *columns: np.ndarray) -> Iterator[tuple]:
    """A row for each bucket with its share of the columns (fp, doc, seq, at)."""
    order = np.argsort(buckets, kind="stable")
    cut = np.flatnonzero(np.r_[True, buckets[order][1:] != buckets[order][:-1]]) if len(order) else []
    columns = [c[order] for c in columns]
    for a, b in zip(cut, np.r_[cut[1:], len(order)] if len(order) else []):
        yield (int(buckets[order[a]]), kind, *(c[a:b].tobytes() for c in columns), b"")


def _of_doc(doc: np.ndarray, seq: np.ndarray, n: int) -> np.ndarray:
    return (mix(doc.view(U64) + U64(0x9E37) * seq.astype(U64)) % U64(n)).astype(np.int64)


def _send_anchors(n_buckets: int):
    """Step 1. kind 0: anchors to count; kind 1: anchors that their slice has twice, on their way to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seqs = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
            for a, b, buf, offs in slices(batch.column(2), 2 << 20, 4096):
                row, fp, at, n = anchors(buf, offs)
                if not len(fp):
                    continue
                doc, seq, packed = ids[a:b][row], seqs[a:b][row], (at << 8) | n
                order = np.argsort(fp, kind="stable")
                new = np.r_[True, fp[order][1:] != fp[order][:-1]]
                again = np.zeros(len(fp), bool)
                again[order] = ~(new & np.r_[new[1:], True])
                once, lead = np.flatnonzero(~again), order[new & ~np.r_[new[1:], True]]
                # the leader of a repeated hash stands for its slice, under no document
                told = np.r_[once, lead]
                sent = packed.copy()
                sent[lead] = -1
                fps = fp[told]
                rows = [*_split((fps % U64(n_buckets)).astype(np.int64), 0, fps, doc[told], seq[told], sent[told])]
                more = np.flatnonzero(again)
                rows += _split((mix(fp[more]) % U64(n_buckets)).astype(np.int64), 1, fp[more], doc[more], seq[more], packed[more])
                yield _batch(rows)
        trim()

    return run


def _columns(table) -> tuple[np.ndarray, ...]:
    """fp, doc, seq and at of rows, end to end."""
    kinds = {"fp": U64, "doc": np.int64, "seq": np.int32, "at": np.int64}
    return tuple(np.concatenate([np.frombuffer(x, k) for x in table[c].to_pylist()] or [np.zeros(0, k)]) for c, k in kinds.items())


def _match_anchors(n_buckets: int):
    """Step 2: what is counted twice goes on to its document's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = [], []

        def tell(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            if parts:
                fp, doc, seq, at = (np.concatenate(c) for c in zip(*parts))
                if len(fp):
                    yield _batch([*_split(_of_doc(doc, seq, n_buckets), 0, fp, doc, seq, at)])

        for batch in batches:
            kind = batch.column(1).to_numpy()
            known.append(_columns(batch.filter(pa.array(kind == 1))))
            if sum(len(k[0]) for k in known) >= SEND:
                yield from tell(known)
                known = []
            held.append(_columns(batch.filter(pa.array(kind == 0))))
        if not held:
            return
        fp, doc, seq, at = (np.concatenate(c) for c in zip(*held))
        del held
        order = np.argsort(fp)
        sorted_ = fp[order]
        new = np.r_[True, sorted_[1:] != sorted_[:-1]] if len(order) else np.zeros(0, bool)
        again = order[~(new & np.r_[new[1:], True])] if len(order) else order
        again = again[at[again] >= 0]
        yield from tell([*known, (fp[again], doc[again], seq[again], at[again])])
        del fp, doc, seq, at, order, sorted_, new, again, known
        trim()

    return run


def _rows_of(key_doc, key_seq, doc, seq):
    """Which row of (key_doc, key_seq), sorted, each (doc, seq) is."""
    where: dict[tuple[int, int], int] = {k: i for i, k in enumerate(zip(key_doc.tolist(), key_seq.tolist()))}
    change = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (seq[1:] != seq[:-1])]) if len(doc) else np.zeros(0, np.int64)
    each = np.array([where[k] for k in zip(doc[change].tolist(), seq[change].tolist())], np.int64)
    return np.repeat(each, np.diff(np.r_[change, len(doc)]))


def _texts(right: pa.Table):
    data = [bytes(x) for x in right["text"].to_pylist()]
    offs = np.r_[0, np.cumsum([len(x) for x in data])].astype(np.int64)
    return np.frombuffer(b"".join(data), np.uint8), offs, right["doc"].to_numpy(), right["seq"].to_numpy().astype(np.int32)


def _stretch(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of stretches end to end."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _copies(buf: np.ndarray, start: np.ndarray, size: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Stretches equal, byte by byte, to an earlier one of the same digest."""
    digest = fp.copy()
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[U64(1), np.full(255 + LENGTH, _STEPS[0], U64)])
        for x in range(0, len(fp), CHUNK):
            own = size[x : x + CHUNK]
            first = np.cumsum(own) - own
            index = _stretch(start[x : x + CHUNK], own)
            inner = np.arange(len(index)) - np.repeat(first, own)
            digest[x : x + CHUNK] = mix(np.add.reduceat(_BYTE[buf[index]] * power[inner], first) + fp[x : x + CHUNK])
    by = np.argsort(digest, kind="stable")
    lead = np.maximum.accumulate(np.where(np.r_[True, digest[by][1:] != digest[by][:-1]], np.arange(len(by)), 0)) if len(by) else by
    first = np.empty(len(fp), np.int64)
    first[by] = by[lead]
    copy = np.flatnonzero((first != np.arange(len(fp))) & (size == size[first]) & (fp == fp[first]))
    parts = [copy[x : x + CHUNK] for x in range(0, len(copy), CHUNK)]
    sure = []
    for c in parts:
        equal = buf[_stretch(start[c], size[c])] == buf[_stretch(start[first[c]], size[c])]
        sure.append(c[np.logical_and.reduceat(equal, np.cumsum(size[c]) - size[c])])
    return np.concatenate(sure) if sure else copy


def _cut_stretches(n_buckets: int):
    """Step 3. kind 0: stretches for the shards; kind 1: runs of windows already known to go (at: first << 32 | windows)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            buf, offs, key_doc, key_seq = _texts(right)
            fp, doc, seq, at = _columns(left)
            order = np.lexsort((at, seq, doc))
            fp, doc, seq, at = fp[order], doc[order], seq[order], at[order]
            start = offs[_rows_of(key_doc, key_seq, doc, seq)] + (at >> 8)
            windows = at & 255
            size = windows + LENGTH - 1
            copy = _copies(buf, start, size, fp)
            gone = np.zeros(len(fp), bool)
            gone[copy] = True
            keep_ = np.flatnonzero(~gone)
            bucket = (mix(fp[keep_] ^ U64(0x5DEECE66D)) % U64(n_buckets)).astype(np.int64)
            order = keep_[np.argsort(bucket, kind="stable")]
            bucket = np.sort(bucket)
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(order) else []
            for a, b in zip(cut, np.r_[cut[1:], len(order)] if len(order) else []):
                own = order[a:b]
                rows.append((int(bucket[a]), 0, fp[own].tobytes(), doc[own].tobytes(), seq[own].tobytes(), at[own].tobytes(), buf[_stretch(start[own], size[own])].tobytes()))
            d, s, f, n = join_runs(doc[copy], seq[copy], at[copy] >> 8, windows[copy])
            rows += _split((mix(d.view(U64)) % U64(n_buckets)).astype(np.int64), 1, np.zeros(len(d), U64), d, s, (f << 32) | n)
        return pa.Table.from_batches([_batch(rows)]) if rows else pa.Table.from_batches([], schema=pa.schema([(n, t) for n, t in zip(_NAMES, [pa.int64(), pa.int32()] + [pa.binary()] * 5)]))

    return run


def _sort_shards(n_buckets: int, shard: int = SHARD):
    """Step 4: runs of windows to go, to their documents' buckets. Rows come by bucket, so a shard holds whole buckets or a share of one."""

    def tell(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        if parts:
            d, s, f, n = (np.concatenate(c) for c in zip(*parts))
            if len(d):
                yield _batch([*_split(_of_doc(d, s, n_buckets), 0, np.zeros(len(d), U64), d, s, (f << 32) | n)])

    def solve(parts: list) -> list[tuple]:
        fp, doc, seq, at, data = (np.concatenate(c) for c in zip(*parts))
        windows = at & 255
        size = windows + LENGTH - 1
        source = np.cumsum(size) - size
        order = np.lexsort((at, seq, doc, fp))
        fp, doc, seq, at, windows, size, source = (x[order] for x in (fp, doc, seq, at, windows, size, source))
        out = []
        copy = _copies(data, source, size, fp)
        if len(copy):
            out.append(join_runs(doc[copy], seq[copy], at[copy] >> 8, windows[copy]))
            left = np.ones(len(fp), bool)
            left[copy] = False
            fp, doc, seq, at, windows, size, source = (x[left] for x in (fp, doc, seq, at, windows, size, source))
        # an anchor that occurs once among the distinct stretches here has nothing to meet
        new = np.r_[True, fp[1:] != fp[:-1]]
        many = ~(new & np.r_[new[1:], True])
        fp, doc, seq, at, windows, size, source = (x[many] for x in (fp, doc, seq, at, windows, size, source))
        a = 0
        group_end = np.r_[np.flatnonzero(np.r_[fp[1:] != fp[:-1]]) + 1, len(fp)] if len(fp) else np.zeros(0, np.int64)
        total = np.r_[0, np.cumsum(size)]
        shards: list[Shard] = []

        def make(x: int, y: int) -> Shard:
            sizes = size[x:y]
            return Shard(data[_stretch(source[x:y], sizes)], np.cumsum(sizes) - sizes, windows[x:y], doc[x:y], seq[x:y], at[x:y] >> 8)

        while a < len(fp):
            fit = group_end[(group_end > a) & (total[group_end] - total[a] <= shard)]
            if len(fit):
                b = int(fit[-1])
                out.append(make(a, b).runs())
            else:  # one group fills several shards
                b = int(group_end[np.searchsorted(group_end, a, "right")])
                shards, x = [], a
                while x < b:
                    y = max(x + 1, int(np.searchsorted(total, total[x] + shard, "right")) - 1)
                    one = make(x, min(y, b))
                    for other in shards:
                        one.meet(other)
                    shards.append(one)
                    x = min(y, b)
                out += [s.runs() for s in shards]
            a = b
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_bytes, last, found = [], 0, None, []
        for batch in batches:
            for row in batch.to_pylist():
                fp, doc, seq, at = np.frombuffer(row["fp"], U64), np.frombuffer(row["doc"], np.int64), np.frombuffer(row["seq"], np.int32), np.frombuffer(row["at"], np.int64)
                if row["kind"] == 1:
                    found.append((doc, seq, at >> 32, at & 0xFFFFFFFF))
                    continue
                if last is not None and row["bucket"] != last and held_bytes >= shard:
                    found += solve(held)
                    held, held_bytes = [], 0
                last = row["bucket"]
                held.append((fp, doc, seq, at, np.frombuffer(row["data"], np.uint8)))
                held_bytes += len(row["data"])
            if sum(len(f[0]) for f in found) >= SEND:
                yield from tell(found)
                found = []
        if held:
            found += solve(held)
        held = []
        yield from tell(found)
        trim()

    return run


def _remove(left: pa.Table, right: pa.Table) -> pa.Table:
    """Step 5."""
    _, doc, seq, at = _columns(left)
    order = np.lexsort((at, seq, doc))
    doc, seq, at = doc[order], seq[order], at[order]
    first, n = at >> 32, at & 0xFFFFFFFF
    texts = right["text"].to_pylist()
    where = _rows_of(right["doc"].to_numpy(), right["seq"].to_numpy().astype(np.int32), doc, seq)
    by = np.argsort(where, kind="stable")
    cut = np.searchsorted(where[by], np.arange(len(texts) + 1))
    removed, spans, kept = [], [], []
    for r, text in enumerate(texts):
        own = by[cut[r] : cut[r + 1]]
        if not len(own):
            removed.append(0), spans.append(0), kept.append(hashlib.sha256(text).hexdigest())
            continue
        a, b = first[own], first[own] + n[own] + LENGTH - 1
        reach = np.maximum.accumulate(b)
        new = np.flatnonzero(np.r_[True, a[1:] > reach[:-1]])
        a, b = a[new].tolist(), reach[np.r_[new[1:] - 1, len(reach) - 1]].tolist()
        h, last = hashlib.sha256(), 0
        for x, y in zip(a, b):
            h.update(memoryview(text)[last:x])
            last = y
        h.update(memoryview(text)[last:])
        removed.append(sum(b) - sum(a)), spans.append(len(a)), kept.append(h.hexdigest())
    return pa.table({"doc_id": right["doc_id"], "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(kept, pa.string())})


def remove_repeats(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    first = F.lit(-(1 << 63)).cast("long")
    if rows.groupBy("doc_id").count().where("count > 1 or doc_id = -9223372036854775808").limit(1).count():
        order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
        rows = rows.withColumn("seq", F.row_number().over(order).cast("int"))
    else:
        rows = rows.withColumn("seq", F.lit(1))
    rows = rows.select("doc_id", F.coalesce("doc_id", first).alias("doc"), "seq", "text")
    # what a task holds follows from the bytes of text, whatever number of partitions the session has
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(partitions(docs.sparkSession), -(-size // BUCKET))
    n = SPREAD * shards
    told = rows.select("doc", "seq", "text").mapInArrow(_send_anchors(shards), _SENT)
    found = told.repartition(shards, "bucket").mapInArrow(_match_anchors(n), _SENT)
    # the same bucket as _of_doc, so that texts and packed arrays meet
    texts = rows.mapInArrow(_place(n), "bucket long, doc_id long, doc long, seq int, text binary")
    cut = found.groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInArrow(_cut_stretches(shards), _SENT)
    gone = cut.repartition(shards, "bucket").sortWithinPartitions("bucket").mapInArrow(_sort_shards(n, shard), _SENT)
    return gone.groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _place(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, seq = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(_of_doc(doc, seq, n_buckets)), batch.column(0), batch.column(1), batch.column(2), batch.column(3).cast(pa.binary())], ["bucket", "doc_id", "doc", "seq", "text"])

    return run
