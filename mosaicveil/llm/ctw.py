"""Language-model scores by context-tree weighting over bytes, beside a word-unigram base.

A text is coded as its UTF-8 bytes and one end mark, each byte as eight binary decisions (high bit first). Every decision has a node
in each context of the 0 to DEPTH bytes before it. A node's Krichevsky-Trofimov estimate and the product of its children's weighted
probabilities are mixed half and half, from the deepest context up; what a text gets is the conditional probability of this mixture
with the tree as learned, so a score is a proper log-probability.

Counts are taken over all training rows, those whose crc32(id as text) mod 10 is not 0, and the tree keeps every context: nothing is
dropped or pooled at any input size. score() never has it in one place. Texts are packed into slices of about SLICE bytes; each slice
lists its distinct (context, byte) keys with their training counts, dealt to shards by their last SPLIT context bytes. A shard holds
whole subtrees: it sums its counts, weighs its nodes bottom-up, and sends up what its subtrees add to the decisions of the contexts of
SPLIT - 1 bytes. The driver mixes those, of which there are as many as such contexts, and sends the mixture down; then each shard
answers the keys of each slice, and the slice adds up its texts. What is dealt grows with the slices, in proportion to the input.
fit() holds a tree on the driver, for small corpora and tests; only there a capacity can be asked for, and contexts below share a branch.

Base: sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1))), tokens being words (A-Z lower-cased) and one end. Counts of the at most
FREQUENT commonest tokens are broadcast; other tokens of the texts meet their counts in a shuffle join, pre-aggregated by text.

A null text is empty (the end alone); a null id counts as the empty string for the fold; repeated ids are scored row by row; with
no training rows all counts are 0. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, id_crc, keep, partitions, release
from .textops import U64, mix, slices, trim, word_bounds, word_hashes

DEPTH, FREQUENT = 5, 1 << 19
SPLIT, SLICE = 3, 4 << 20
#: Shards for each task of the shuffles by shard, which holds one at a time, and bytes of text that such a task stands for at most: a
#: shard's tables are many times its keys, so there are more of them the more text there is, whatever the number of shuffle partitions.
SHARDS, TASK = 4, 16 << 20
_START, _STOP = 0xFE, 0xFF  # bytes that UTF-8 does not use
_END_TOKEN = U64(0x6A09E667F3BCC909)
_HOLD = 3_000_000  # keys that a task holds before it counts them
#: Rows that go to Python at once: documents, and keys or answers of a slice and shard; whole slices go one by one.
_DOCS, _ASKS = 1000, 256
_NONE = U64(0xFFFFFFFFFFFFFFFF)


def grams(buf: np.ndarray, offs: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Key of each coded symbol (symbol in the low byte, the byte before it next, and so on) and each row's first symbol."""
    n = len(offs) - 1
    size = np.diff(offs)
    at = offs[:-1] + (depth + 1) * np.arange(n) + depth
    out = np.full(len(buf) + (depth + 1) * n, _START, np.uint8)
    out[np.arange(len(buf)) + np.repeat(at - offs[:-1], size)] = buf
    out[at + size] = _STOP
    key = np.zeros(len(out), U64)
    for j in range(depth, -1, -1):
        key = (key << U64(8)) | np.r_[np.full(j, _START, np.uint8), out[: len(out) - j]].astype(U64)
    return key[out != _START], offs[:-1] + np.arange(n)


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the words and of each row's end token."""
    starts, ends, rows = word_bounds(buf, offs)
    n = len(offs) - 1
    return np.r_[word_hashes(buf, starts, ends), np.full(n, _END_TOKEN, U64)], np.r_[rows, np.arange(n)]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts; keys is sorted in its place."""
    keys.sort()
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.r_[first, len(keys)])


def _count(batches: Iterator[pa.RecordBatch], kinds: tuple[int, ...] = (0, 1)) -> Iterator[pa.RecordBatch]:
    """Counts of byte grams (kind 0) and tokens (kind 1) of a task's texts, a row for each distinct one."""
    held: list[list] = [[], []]
    sums: list[list] = [[], []]

    def settle(kind: int) -> None:
        if held[kind]:
            sums[kind].append(_distinct(np.concatenate(held[kind])))
            held[kind].clear()
            if len(sums[kind]) > 3:
                sums[kind][:] = [_merge(sums[kind])]

    for batch in batches:
        for _, _, buf, offs in slices(batch.column(0), 1 << 20):
            for kind in kinds:
                held[kind].append((grams, tokens)[kind](buf, offs)[0])
                if sum(map(len, held[kind])) > _HOLD:
                    settle(kind)
        for kind in kinds:  # a task's tables stay bounded
            if sum(len(k) for k, _ in sums[kind]) > _HOLD:
                yield from _emit(kind, sums[kind])
    for kind in kinds:
        settle(kind)
        yield from _emit(kind, sums[kind])
    trim()


def _emit(kind: int, parts: list) -> Iterator[pa.RecordBatch]:
    if parts:
        keys, counts = _merge(parts)
        parts.clear()
        for at in range(0, len(keys), 100_000):
            k, c = keys[at : at + 100_000], counts[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.astype(np.int64)), pa.array(c.astype(np.int64))], ["kind", "key", "n"])


class Lookup:
    """Open-addressed table from 64-bit keys to float columns."""

    def __init__(self, keys: np.ndarray, *columns: np.ndarray):
        self.keys, self.columns, self.table = keys, columns, None

    def __getstate__(self):  # the table is made where it is used
        return {"keys": self.keys, "columns": self.columns, "table": None}

    def _open(self) -> None:
        keys, size = self.keys, 1 << max(4, int(2 * len(self.keys) + 1).bit_length())
        self.mask, self.table = U64(size - 1), np.full(size, _NONE, U64)
        self.row = np.zeros(size, np.int32)
        slot, todo = mix(keys) & self.mask, np.arange(len(keys))
        while len(todo):
            free = self.table[slot[todo]] == _NONE
            self.table[slot[todo[free]]] = keys[todo[free]]
            won = self.table[slot[todo]] == keys[todo]
            self.row[slot[todo[won]]] = todo[won]
            todo = todo[~won]
            slot[todo] = (slot[todo] + U64(1)) & self.mask

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        if self.table is None:
            self._open()
        slot = mix(keys) & self.mask
        have = self.table[slot]
        out = np.where(have == keys, self.row[slot], -1)
        todo = np.flatnonzero((have != keys) & (have != _NONE))
        slot = slot[todo]
        while len(todo):
            slot = (slot + U64(1)) & self.mask
            have = self.table[slot]
            hit = have == keys[todo]
            out[todo[hit]] = self.row[slot[hit]]
            more = ~hit & (have != _NONE)
            todo, slot = todo[more], slot[more]
        return out


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, by Stirling's series eight places up."""
    down = np.zeros_like(x)
    for j in range(8):
        down += np.log(x + j)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - down


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - np.log(np.pi)


def _tag(depth: int, kind: int) -> np.uint64:
    return U64((depth + 1) << 56 | kind << 60)


def _mask(n_bytes: int) -> np.uint64:
    return U64((1 << (8 * n_bytes)) - 1)


def _nodes(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context and node, zeros, ones) of all decisions behind (context, byte) entries; sorted by the first."""
    out = []
    byte, context = keys & U64(255), keys >> U64(8)
    for level in range(8):
        node = (context << U64(8)) | U64(1 << level) | (byte >> U64(8 - level))
        one = ((byte >> U64(7 - level)) & U64(1)).astype(bool)
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        out.append((node[first], np.add.reduceat(np.where(one, 0, counts), first), np.add.reduceat(np.where(one, counts, 0), first)))
    node, zeros, ones = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(node)
    return node[order], zeros[order].astype(np.float64), ones[order].astype(np.float64)


class Model:
    """A learned tree in one place, as tables: entries, contexts and nodes."""

    def __init__(self, entries: list[tuple[np.ndarray, np.ndarray]]):
        """entries: for each depth the sorted (context, byte) keys of kept contexts and their counts."""
        self.depth = len(entries) - 1
        if not len(entries[0][0]):
            self.entry = self.node = None
            return
        tree = [_nodes(*e) for e in entries]
        up = [None] + [np.searchsorted(tree[d - 1][0], ((tree[d][0] >> U64(8)) & _mask(d - 1)) << U64(8) | tree[d][0] & U64(255)) for d in range(1, self.depth + 1)]
        own = [log_kt(z, o) for _, z, o in tree]
        sigma, rest = [None] * (self.depth + 1), [None] * (self.depth + 1)
        weighted = own[-1]
        sigma[-1], rest[-1] = np.ones(len(weighted)), np.full(len(weighted), 0.5)
        for d in range(self.depth - 1, -1, -1):
            n = len(tree[d][0])
            z = tree[d][1] - np.bincount(up[d + 1], tree[d + 1][1], n)
            o = tree[d][2] - np.bincount(up[d + 1], tree[d + 1][2], n)
            below = np.bincount(up[d + 1], weighted, n) + log_kt(np.maximum(z, 0), np.maximum(o, 0))
            sigma[d] = 1 / (1 + np.exp(np.clip(below - own[d], -500, 500)))
            rest[d] = (o + 0.5) / (z + o + 1)
            weighted = np.logaddexp(own[d], below) - np.log(2)
        keys, ends, halts, e_keys, e_bits = [], [], [], [], []
        so_far = weight = None
        for d, (node, z, o) in enumerate(tree):
            kt = (o + 0.5) / (z + o + 1)
            if d == 0:
                so_far, weight = sigma[0] * kt, 1 - sigma[0]
            else:
                so_far, weight = so_far[up[d]] + weight[up[d]] * sigma[d] * kt, weight[up[d]] * (1 - sigma[d])
            end, halt = so_far + weight * rest[d], so_far + weight * 0.5
            keys.append(node | _tag(d, 2))
            ends.append(end.astype(np.float32))
            halts.append(halt.astype(np.float32))
            e = entries[d][0]
            bits = np.zeros(len(e))
            for level in range(8):
                at = np.searchsorted(node, ((e >> U64(8)) << U64(8)) | U64(1 << level) | ((e & U64(255)) >> U64(8 - level)))
                p = end[at].astype(np.float32).astype(np.float64)
                bits += np.log2(np.where((e >> U64(7 - level)) & U64(1), p, 1 - p))
            e_keys.append(e | _tag(d, 0))
            e_bits.append(bits)
        self.entry = Lookup(np.concatenate(e_keys), np.concatenate(e_bits).astype(np.float32))
        self.node = Lookup(np.concatenate(keys), np.concatenate(ends), np.concatenate(halts))

    def log2(self, keys: np.ndarray) -> np.ndarray:
        """log2 probability of each symbol in its context."""
        out = np.full(len(keys), -8.0)
        if self.entry is None:
            return out
        todo = np.arange(len(keys))
        for d in range(self.depth, -1, -1):
            if not len(todo):
                break
            own = keys[todo] & _mask(d + 1)
            row = self.entry.rows(own | _tag(d, 0))
            hit = row >= 0
            out[todo[hit]] = self.entry.columns[0][row[hit]]
            todo, own = todo[~hit], own[~hit]
            # a kept context has its first decision; there the symbol is new and is coded bit by bit
            kept = self.node.rows(own & ~U64(255) | U64(1) | _tag(d, 2)) >= 0
            if kept.any():
                new, where = np.unique(own[kept], return_inverse=True)
                out[todo[kept]] = self._bitwise(new, d)[where]
            todo = todo[~kept]
        return out

    def _bitwise(self, keys: np.ndarray, depth: int) -> np.ndarray:
        total = np.zeros(len(keys))
        for level in range(8):
            p, todo = np.full(len(keys), 0.5), np.arange(len(keys))
            for d in range(depth, -1, -1):
                k = keys[todo] & _mask(d + 1)
                row = self.node.rows(k & ~U64(255) | U64(1 << level) | ((k & U64(255)) >> U64(8 - level)) | _tag(d, 2))
                hit = row >= 0
                p[todo[hit]] = self.node.columns[0 if d == depth else 1][row[hit]]
                todo = todo[~hit]
                if not len(todo):
                    break
            total += np.log2(np.where((keys >> U64(7 - level)) & U64(1), p, 1 - p))
        return total


def _above(node: np.ndarray, depth: int) -> np.ndarray:
    """The same decisions in the contexts one byte shorter; node: of contexts of depth bytes."""
    return ((node >> U64(8)) & _mask(depth - 1)) << U64(8) | node & U64(255)


def _share(own: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Posterior weight of a node's own estimate against its children's."""
    return 1 / (1 + np.exp(np.clip(below - own, -500, 500)))


class Subtrees:
    """The part of the whole tree below some contexts of SPLIT bytes; keys: sorted, of full depth."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH):
        self.depth, self.keys = depth, keys
        self.tree = [_nodes(*_merge([(keys & _mask(d + 1), counts)])) if len(keys) else (keys, np.zeros(0), np.zeros(0)) for d in range(SPLIT, depth + 1)]
        self.up = [None] + [np.searchsorted(self.tree[d - SPLIT - 1][0], _above(self.tree[d - SPLIT][0], d)) for d in range(SPLIT + 1, depth + 1)]
        self.weighted, self.sigma = None, []
        for k in range(depth - SPLIT, -1, -1):
            own = log_kt(*self.tree[k][1:])
            if self.weighted is None:
                self.weighted = own
                self.sigma.insert(0, np.ones(len(own)))
                continue
            below = np.bincount(self.up[k + 1], self.weighted, len(own))
            self.sigma.insert(0, _share(own, below))
            self.weighted = np.logaddexp(own, below) - np.log(2)

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(node, zeros, ones, log weighted probability), summed for the contexts of SPLIT - 1 bytes."""
        node, where = np.unique(_above(self.tree[0][0], SPLIT), return_inverse=True)
        return node, *(np.bincount(where, x, len(node)) for x in (*self.tree[0][1:], self.weighted))

    def open(self, top: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Mix from the root down; top: what top_of returns."""
        self.table = [(node, so_far + 0.5 * weight) for node, so_far, weight in top]
        for k, (node, z, o) in enumerate(self.tree):
            if k:
                a, w = so_far[self.up[k]], weight[self.up[k]]
            else:
                at = np.searchsorted(top[-1][0], _above(node, SPLIT))
                a, w = top[-1][1][at], top[-1][2][at]
            so_far, weight = a + w * self.sigma[k] * (o + 0.5) / (z + o + 1), w * (1 - self.sigma[k])
            self.table.append((node, so_far + 0.5 * weight))
        self.bits = self._bitwise(self.keys)

    def log2(self, keys: np.ndarray) -> np.ndarray:
        """log2 probability of each symbol in its context."""
        if not len(self.keys):
            return self._bitwise(keys)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out = self.bits[at]
        new = self.keys[at] != keys
        out[new] = self._bitwise(keys[new])
        return out

    def _bitwise(self, keys: np.ndarray) -> np.ndarray:
        total = np.zeros(len(keys))
        for level in range(8):
            p, todo = np.full(len(keys), 0.5), np.arange(len(keys))
            for d in range(self.depth, -1, -1):
                node, mid = self.table[d]
                if not len(todo) or not len(node):
                    continue
                k = keys[todo] & _mask(d + 1)
                k = k & ~U64(255) | U64(1 << level) | ((k & U64(255)) >> U64(8 - level))
                at = np.minimum(np.searchsorted(node, k), len(node) - 1)
                hit = node[at] == k
                p[todo[hit]] = mid[at[hit]]
                todo = todo[~hit]
            total += np.log2(np.where((keys >> U64(7 - level)) & U64(1), p, 1 - p))
        return total


def top_of(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each depth under SPLIT (node, mixture so far, weight of what is deeper); the arguments are sums() over all shards, sorted."""
    tree, up = [], []
    for d in range(SPLIT - 1, -1, -1):
        own = log_kt(zeros, ones)
        tree.insert(0, (node, _share(own, below), (ones + 0.5) / (zeros + ones + 1)))
        if d:
            weighted = np.logaddexp(own, below) - np.log(2)
            node, where = np.unique(_above(node, d), return_inverse=True)
            zeros, ones, below = (np.bincount(where, x, len(node)) for x in (zeros, ones, weighted))
            up.insert(0, where)
    out = []
    for d, (node, sigma, kt) in enumerate(tree):
        a, w = (out[-1][1][up[d - 1]], out[-1][2][up[d - 1]]) if d else (0.0, 1.0)
        out.append((node, a + w * sigma * kt, w * (1 - sigma)))
    return out


def _bytes(keys: np.ndarray) -> bytes:
    """48-bit keys, first the lowest byte of all, then the next: this compresses well."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : DEPTH + 1].T).tobytes()


def _keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(DEPTH + 1, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : DEPTH + 1] = planes.T
    return out.view("<u8")[:, 0].astype(U64)


_SLICE = "slice long, doc_id array<long>, held_out array<boolean>, offs binary, text binary, size long"


def _packer(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices of (doc_id, text, held_out); a slice's number is that of its first row."""
        from pyspark import TaskContext

        row, held = TaskContext.get().partitionId() << 36, []

        def pack() -> pa.RecordBatch:
            nonlocal row
            ids, folds, texts, sizes = zip(*held)
            held.clear()
            ids, folds, sizes = pa.concat_arrays(ids), pa.concat_arrays(folds), np.concatenate(sizes)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), x) for x in (ids, folds)]
            out = pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), *lists, pa.array([np.r_[0, np.cumsum(sizes)].astype(np.int64).tobytes()]), pa.array([np.concatenate(texts).tobytes()]), pa.array([int(sizes.sum())], pa.int64())], ["slice", "doc_id", "held_out", "offs", "text", "size"])
            row += len(ids)
            return out

        for batch in batches:
            for a, b, buf, offs in slices(batch.column(1), min(most, 1 << 20)):
                held.append((batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), buf.copy(), np.diff(offs)))
                if sum(len(h[2]) + len(h[3]) for h in held) >= most:
                    yield pack()
        if held:
            yield pack()
        trim()

    return run


def _runs(offs, text) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a slice's runs of about a MB."""
    offs, buf = np.frombuffer(offs, np.int64), np.frombuffer(text, np.uint8)
    at = 0
    while at < len(offs) - 1:
        end = max(int(np.searchsorted(offs, offs[at] + (1 << 20), "right")) - 1, at + 1)
        yield at, end, buf[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def _all_grams(offs, text, held: np.ndarray | None = None) -> np.ndarray:
    """Keys of a slice, in one array from the start; with held, shifted to make room for the fold in the lowest bit."""
    rows = len(np.frombuffer(offs, np.int64)) - 1
    out, at = np.empty(len(text) + rows, U64), 0
    for a, b, buf, cut in _runs(offs, text):
        keys = grams(buf, cut)[0]
        if held is not None:
            keys = keys << U64(1) | np.repeat(~held[a:b].astype(bool), np.diff(cut) + 1).astype(U64)
        out[at : at + len(keys)] = keys
        at += len(keys)
    return out


def _dealt(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shards of sorted keys, ascending, and the order of the keys that goes with them."""
    shard = np.empty(len(keys), np.int32)
    for at in range(0, len(keys), 1 << 18):  # what mixing holds stays small
        shard[at : at + (1 << 18)] = mix((keys[at : at + (1 << 18)] >> U64(8)) & _mask(SPLIT)) % U64(shards)
    order = np.argsort(shard, kind="stable").astype(np.int32)
    return shard[order], order


def _asker(shards: int):
    """For each slice and shard one row: the slice's distinct keys there and how often its training rows have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                number, held = batch.column(0)[k].as_py(), batch.column(2)[k].values.to_numpy(zero_copy_only=False)
                # keys with the fold in the lowest bit, as plain sorting is far faster than sorting places
                keys, n = _distinct(_all_grams(batch.column(3)[k].as_buffer(), batch.column(4)[k].as_buffer(), held))
                trained, keys = np.where(keys & U64(1), n, 0), keys >> U64(1)
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                keys, n = keys[first], np.add.reduceat(trained, first)
                shard, order = _dealt(keys, shards)
                keys, n = keys[order], n[order].astype(np.uint32)
                cut = np.r_[np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]), len(shard)]
                pairs = list(zip(cut[:-1], cut[1:]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[cut[:-1]]), pa.array(np.full(len(pairs), number)), pa.array([_bytes(keys[a:b]) for a, b in pairs], pa.binary()), pa.array([n[a:b].tobytes() for a, b in pairs], pa.binary())], ["shard", "slice", "keys", "n"]
                )
        trim()

    return run


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a shard, of rows in order of shards: its training keys and counts, and what it sends up."""
    last, parts = None, []

    def grown() -> Iterator[pa.RecordBatch]:
        keys, n = _merge(parts)
        parts.clear()
        if len(keys):
            node, z, o, w = Subtrees(keys, n).sums()
            ups = [pa.ListArray.from_arrays(pa.array([0, len(node)], pa.int32()), pa.array(x)) for x in (node.astype(np.int64), z, o, w)]
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([_bytes(keys)]), pa.array([n.tobytes()]), *ups], ["shard", "keys", "n", "node", "z", "o", "w"])

    for batch in batches:
        for shard, keys, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if shard != last and parts:
                yield from grown()
            last, n = shard, np.frombuffer(n, np.uint32).astype(np.int64)
            parts.append((_keys(keys)[n > 0], n[n > 0]))
            if sum(len(k) for k, _ in parts[1:]) > _HOLD:
                parts[:] = [_merge(parts)]
    if parts:
        yield from grown()
    trim()


def _answerer(shared):
    """Bits of the asked keys, in their order; of each shard its tree comes first (slice -1), then what the slices ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree = None, None
        for batch in batches:
            for k in range(len(batch)):
                shard, number, keys, n = (batch.column(c)[k].as_py() for c in range(4))
                keys = _keys(keys)
                if shard != last:
                    tree = None  # the last one goes first
                    tree = Subtrees(keys, np.frombuffer(n, np.int64)) if number < 0 else Subtrees(keys[:0], np.zeros(0, np.int64))
                    tree.open(shared.value)
                    last = shard
                if number >= 0:
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([shard], pa.int32()), pa.array([tree.log2(keys).astype(np.float32).tobytes()])], ["slice", "shard", "bits"])
        trim()

    return run


def _scorer(shared, n_tokens: int, n_distinct: int, floor: int, shards: int):
    """floor: the least count of broadcast tokens; a token not among them has fewer or none. Answers name no keys: a slice makes
    the list that it asked anew."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        frequent = shared.value
        absent = np.log10(0.1 / (n_tokens + 0.1 * (n_distinct + 1)))
        raw, offsets = texts["text"][0].as_buffer(), texts["offs"][0].as_buffer()
        known_keys, _ = _distinct(_all_grams(offsets, raw))
        told = sorted(zip(answers["shard"].to_pylist(), answers["bits"].to_pylist()))
        trim()
        known_bits, order, at = np.empty(len(known_keys), np.float32), _dealt(known_keys, shards)[1], 0
        for _, b in told:
            known_bits[order[at : at + len(b) // 4]] = np.frombuffer(b, np.float32)
            at += len(b) // 4
        del told, order
        trim()
        ids, folds = (pa.concat_arrays([x.values for x in texts[c].combine_chunks().slice(0, 1)]) for c in ("doc_id", "held_out"))
        row, out = texts["slice"][0].as_py(), []
        for a, b, buf, offs in _runs(offsets, raw):
            n = b - a
            keys, first = grams(buf, offs)
            order = np.argsort(keys)
            bits = np.empty(len(keys))
            bits[order] = known_bits[np.searchsorted(known_keys, keys[order])]
            score = np.add.reduceat(bits, first) * np.log10(2)
            word, of = tokens(buf, offs)
            place = frequent.rows(word)
            known = place >= 0
            base = np.bincount(of[known], frequent.columns[0][place[known]], n)
            rare, rows = word[~known], of[~known]
            if floor <= 1:  # every training token is broadcast
                base = base + absent * np.bincount(rows, minlength=n)
                rare, rows = rare[:0], rows[:0]
            order = np.lexsort((rare, rows))
            rare, rows = rare[order], rows[order]
            new = np.flatnonzero(np.r_[True, (rare[1:] != rare[:-1]) | (rows[1:] != rows[:-1])]) if len(rare) else np.zeros(0, np.int64)
            times = np.diff(np.r_[new, len(rare)])
            cut = np.searchsorted(rows[new], np.arange(n + 1)).astype(np.int32)
            out.append(
                pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row + a, row + b)),
                        ids.slice(a, n),
                        folds.slice(a, n),
                        pa.array(np.bincount(of, minlength=n).astype(np.int64)),
                        pa.array(np.bincount(of[known], minlength=n).astype(np.int64)),
                        pa.array(base),
                        pa.array(score),
                        pa.ListArray.from_arrays(cut, pa.array(rare[new].astype(np.int64))),
                        pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int64))),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "times"],
                )
            )
        trim()
        return pa.Table.from_batches(out)

    return run


def _least(sizes: list[tuple[int, int]], most: int) -> int:
    """Least power of two so that what has that count at least is at most so much; sizes: (log2 of the count, how many)."""
    total, least = 0, 0
    for level, n in sorted(sizes, reverse=True):
        total += n
        if total > most:
            return 1 << (level + 1)
        least = level
    return 1 << least


def fit(docs: DataFrame, depth: int = DEPTH, capacity: int | None = None) -> tuple[Model, DataFrame]:
    """(tree, token counts) of the rows of docs whose fold is not 0; the whole tree if there is no capacity."""
    train = docs.where(F.pmod(id_crc(), F.lit(10)) != 0).select("text")
    counts = keep(train.mapInArrow(_count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    deepest = counts.where("kind = 0")
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.col("key").bitwiseAND(F.lit((1 << (8 * (d + 1))) - 1)).alias("key")) for d in range(depth + 1)))).alias("e")
    every = deepest.select(each, "n").groupBy("e.d", "e.key").agg(F.sum("n").alias("n"))
    every = keep(every.select("d", "key", F.expr("shiftright(key, 8)").alias("context"), "n"), "grams")
    contexts = every.groupBy("d", "context").agg(F.sum("n").alias("total"), F.count("*").alias("n"))
    least = 1
    if capacity is not None:
        sizes = contexts.groupBy(F.floor(F.log2("total")).cast("int").alias("level")).agg(F.sum("n").alias("n")).collect()
        least = _least([(r.level, r.n) for r in sizes], capacity)
    kept = every.join(contexts.where((F.col("total") >= least) | (F.col("d") == 0)).select("d", "context"), ["d", "context"])
    found = kept.select("d", "key", "n").toArrow()
    depths, every_key, every_n = (found[c].to_numpy() for c in ("d", "key", "n"))
    del found
    entries = []
    for d in range(depth + 1):
        own = depths == d
        keys, n = every_key[own].astype(U64), every_n[own].astype(np.int64)
        order = np.argsort(keys)
        entries.append((keys[order], n[order]))
    while len(entries) > 1 and not len(entries[-1][0]):
        entries.pop()
    del depths, every_key, every_n
    model = Model(entries)
    trim()
    return model, counts.where("kind = 1").select("key", "n")


def tasks(packed: DataFrame) -> int:
    """Tasks of a shuffle by shard: the shuffle partitions, or as many as the bytes of text ask for."""
    return max(partitions(packed.sparkSession), -(-(packed.agg(F.sum("size")).first()[0] or 0) // TASK))


def answers(packed: DataFrame, shards: int) -> DataFrame:
    """(slice, shard, bits): log2 probability, by the whole tree of the training rows, of all symbols in context that a slice has."""
    spark = packed.sparkSession
    n = -(-shards // SHARDS)
    asked = keep(packed.mapInArrow(_asker(shards), "shard int, slice long, keys binary, n binary"), "asked", 1)
    trees = asked.select("shard", "keys", "n").repartition(n, "shard").sortWithinPartitions("shard")
    trees = keep(trees.mapInArrow(_grow, "shard int, keys binary, n binary, node array<long>, z array<double>, o array<double>, w array<double>"), "trees", _ASKS)
    release(spark)  # what was shuffled to make the trees is of no more use
    sums = trees.select(F.inline(F.arrays_zip("node", "z", "o", "w"))).groupBy("node").agg(*(F.sum(c).alias(c) for c in "zow")).orderBy("node").toArrow()
    shared = spark.sparkContext.broadcast(top_of(sums["node"].to_numpy().astype(np.int64).view(U64), *(sums[c].to_numpy() for c in "zow")))
    both = trees.select("shard", F.lit(-1).cast("long").alias("slice"), "keys", "n").unionByName(asked.withColumn("n", F.lit(None).cast("binary")))
    told = keep(both.repartition(n, "shard").sortWithinPartitions("shard", "slice").mapInArrow(_answerer(shared), "slice long, shard int, bits binary"), "answers", _ASKS)
    forget(asked, trees)
    release(spark)
    return told


def score(docs: DataFrame, frequent: int = FREQUENT, slice_bytes: int = SLICE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.pmod(id_crc(), F.lit(10)) == 0).alias("held_out"))
    packed = keep(rows.mapInArrow(_packer(slice_bytes), _SLICE), "slices", _DOCS, large=True)
    train = rows.where("not held_out").select("text")
    counts = keep(train.mapInArrow(lambda batches: _count(batches, (1,)), "kind int, key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "counts", _DOCS)
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count("*").alias("n")).collect()
    floor = _least([(r.level, r.n) for r in sizes], frequent) if sizes else 1
    common = counts.where(F.col("n") >= floor).select("key", "n").toArrow()
    denominator = n + 0.1 * (v + 1)
    table = Lookup(common["key"].to_numpy().astype(np.int64).view(U64), np.log10((common["n"].to_numpy().astype(np.float64) + 0.1) / denominator))
    del common
    trim()
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kinds = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>, times array<long>"
    shards = SHARDS * tasks(packed)
    told = answers(packed, shards)
    scored = packed.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(_scorer(shared, n, v, floor, shards), kinds)
    if floor > 1:
        scored = keep(scored, "scores")
        forget(packed, told)
        release(docs.sparkSession)
        rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("key"), F.col("r.times").alias("times"))
        rare = rare.join(counts.where(F.col("n") < floor), "key", "left")
        more = rare.groupBy("row").agg(
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(denominator))).alias("more_base"),
        )
        scored = scored.drop("rare", "times").join(more, "row", "left")
        scored = scored.withColumn("n_known", F.col("n_known") + F.coalesce("more_known", F.lit(0))).withColumn("base_score", F.col("base_score") + F.coalesce("more_base", F.lit(0.0)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
