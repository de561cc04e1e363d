"""Cost-balanced packing of token streams into sequences of fixed capacity.

Each text is tokenised whole and ends with one end id. A task packs the documents it reads, in shards of bounded size: full
stretches of a long document fill sequences of their own; the rest, in descending length, goes to the sequence of lowest cost
(attention cost, linear * n + quadratic * n * n summed over its pieces) that has the capacity left. A piece that fits nowhere is cut
over the sequences of lowest cost that have room, so a shard pads one sequence at most. Nothing is shuffled.

A null text is the empty text (the end id alone); repeated ids are packed as separate rows, the same id on each; ties go to the
earlier row. An empty table gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import U64, mix, trim

CAPACITY, END, SHARD_TOKENS, CACHE = 2048, 1, 4_000_000, 1_000_000
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Letters and numbers of the range that is split here; texts with other characters go to the tokenizer whole.
_L, _N = "a-zªµºß-öø-ÿĀ-įı-ɏ", "0-9²³¹¼-¾"
_SAFE = re.compile("[\t\n\r -~\xa0-įı-ɏ‐-‧‰-⁞€]*")
#: The tokenizer's own split, as its file writes it; a tokenizer with another split gets every text whole.
_SPLIT = json.dumps(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SHORTENED = ("s", "t", "re", "ve", "m", "ll", "d")
_SPACE, _LETTER, _NUMBER, _MARK = range(4)
#: Characters that are split at once.
_CHUNK = 1 << 20


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and random 64-bit code of each character of the range."""
    top = 0x2100
    kinds = np.full(top, _MARK, np.uint8)
    every = [chr(k) for k in range(top)]
    for pattern, kind in ((r"\s", _SPACE), (f"[{_L}]", _LETTER), (f"[{_N}]", _NUMBER)):
        one = re.compile(pattern)
        kinds[[k for k, c in enumerate(every) if one.match(c)]] = kind
    return kinds, mix(np.arange(1, top + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


_KINDS, _CODES = _tables()
_BASE = 0x9E3779B97F4A7C15
_POWER = [np.ones(0, U64), np.ones(0, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    if len(_POWER[0]) < n:
        size = 1 << int(n - 1).bit_length()
        with np.errstate(over="ignore"):
            _POWER[:] = [np.cumprod(np.r_[U64(1), np.full(size - 1, U64(x), U64)]) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWER[0][:n], _POWER[1][:n]


def split(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of lower-cased characters: shortened words, runs of letters, single numbers, runs of marks."""
    kind = _KINDS[chars]
    cut = np.r_[True, kind[1:] != kind[:-1], True]
    start, end = cut[:-1] & (kind != _SPACE), cut[1:] & (kind != _SPACE)
    start |= kind == _NUMBER
    end |= kind == _NUMBER
    quotes = np.flatnonzero(start & (chars == 39) & end)
    wide = np.r_[chars, np.zeros(3, chars.dtype)]
    for word in _SHORTENED:
        here = quotes
        for j, c in enumerate(word):
            here = here[wide[here + 1 + j] == ord(c)]
        end[here], start[here + 1] = False, False
        end[here + len(word)] = True
        after = here + len(word) + 1
        after = after[after < len(chars)]
        start[after] |= kind[after] == _LETTER
    return np.flatnonzero(start), np.flatnonzero(end) + 1


class Pieces:
    """Ids of pieces by 64-bit hash, an open-addressed table over one pool of ids."""

    def __init__(self):
        self.n, self.size, self.used = 0, 0, 0
        self.rows, self.pool = np.zeros((2, 1 << 12), np.int64), np.zeros(1 << 14, "<u4")
        self._resize(1 << 13)

    def _resize(self, size: int) -> None:
        keys, rows = (self.keys[self.full], self.row[self.full]) if self.n else (np.zeros(0, U64), np.zeros(0, np.int32))
        self.size, self.keys, self.row, self.full = size, np.zeros(size, U64), np.zeros(size, np.int32), np.zeros(size, bool)
        self._place(keys, rows)

    def _place(self, keys: np.ndarray, rows: np.ndarray) -> None:
        slot, todo = (keys & U64(self.size - 1)).astype(np.int64), np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            free = ~self.full[at]
            self.row[at[free]], self.keys[at[free]] = rows[todo[free]], keys[todo[free]]
            self.full[at[free]] = True
            todo = todo[self.keys[at] != keys[todo]]  # of several that met in a slot, the last one has it
            slot[todo] = (slot[todo] + 1) & (self.size - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        slot = (keys & U64(self.size - 1)).astype(np.int64)
        hit = self.full[slot] & (self.keys[slot] == keys)
        out = np.where(hit, self.row[slot], -1)
        todo = np.flatnonzero(~hit & self.full[slot])
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (self.size - 1)
            at = slot[todo]
            hit = self.full[at] & (self.keys[at] == keys[todo])
            out[todo[hit]] = self.row[at[hit]]
            todo = todo[~hit & self.full[at]]
        return out

    def add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        """keys: distinct and new."""
        if 2 * (self.n + len(keys)) > self.size:
            self._resize(1 << int(4 * (self.n + len(keys))).bit_length())
        flat, size = np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)
        while self.n + len(keys) > self.rows.shape[1]:
            self.rows = np.c_[self.rows, np.zeros_like(self.rows)]
        while self.used + len(flat) > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
        new = slice(self.n, self.n + len(keys))
        self.rows[0, new], self.rows[1, new] = self.used + np.cumsum(size) - size, size
        self.pool[self.used : self.used + len(flat)] = flat
        self._place(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n, self.used = self.n + len(keys), self.used + len(flat)

    def ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows in turn, and how many each has."""
        first, size = self.rows[0, rows], self.rows[1, rows]
        return self.pool[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))], size


class Encoder:
    """Ids of whole texts as little-endian 32-bit words. Pieces between which nothing merges are looked up once each."""

    def __init__(self, path: str, end: int = END):
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.known = Tokenizer.from_file(path), np.array([end], "<u4").tobytes(), Pieces()
        self.special = re.compile("|".join(map(re.escape, sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values()))) or "(?!)")
        shape = json.loads(self.tokenizer.to_str())
        self.splits = shape["model"].get("end_of_word_suffix") is not None and _SPLIT in json.dumps(shape["pre_tokenizer"]) and "Lowercase" in json.dumps(shape["normalizer"])

        vocabulary, suffix = shape["model"]["vocab"], shape["model"].get("end_of_word_suffix") or "\0"
        self.closing = np.zeros(max(vocabulary.values()) + 2 + len(shape["added_tokens"]), bool)
        self.closing[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, words: list[str]) -> list[bytes]:
        """Ids of each piece. Many go at once, a line each; a token that ends a piece is known by its suffix."""
        out: list[bytes] = []
        for at in range(0, len(words), 512):
            own = words[at : at + 512]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(own)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(own):
                raw, cut = ids.tobytes(), (4 * np.r_[0, ends]).tolist()
                out += [raw[x:y] for x, y in zip(cut[:-1], cut[1:])]
            else:
                out += self._ids(own)
        return out

    def _looked_up(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, how many each piece has, start of each piece) of lower-cased text."""
        chars = np.frombuffer(text.encode("utf-32-le"), "<u4")
        starts, ends = split(chars)
        power, back = _powers(len(chars) + 1)
        with np.errstate(over="ignore"):
            sums = np.cumsum(np.r_[U64(0), _CODES[chars] * power[:-1]], dtype=U64)
            keys = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U64))
        if self.known.n >= CACHE:  # commoner pieces soon come in again
            self.known = Pieces()
        rows = self.known.find(keys)
        absent = np.flatnonzero(rows < 0)
        if len(absent):
            new, first = np.unique(keys[absent], return_index=True)
            words = [text[a:b] for a, b in zip(starts[absent[first]].tolist(), ends[absent[first]].tolist())]
            self.known.add(new, self._pieces(words))
            rows[absent] = self.known.find(keys[absent])
        return *self.known.ids(rows), starts

    def _chunks(self, text: str) -> list[str] | None:
        """The text in parts that end with a space; none if there is a longer stretch without one."""
        out, at = [], 0
        while len(text) - at > _CHUNK:
            end = max(text.rfind(" ", at, at + _CHUNK), text.rfind("\n", at, at + _CHUNK)) + 1
            if not end:
                return None
            out.append(text[at:end])
            at = end
        return [*out, text[at:]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list = [b""] * len(texts)
        whole: list[tuple[int, str]] = []
        parts: list[tuple[int, str]] = []
        for i, t in enumerate(texts):
            t, own = t or "", None
            if self.splits and _SAFE.fullmatch(t) and (t.isascii() or unicodedata.is_normalized("NFC", t)) and not self.special.search(t):
                own = self._chunks(t.lower())
            if own is None:
                whole.append((i, t))
            else:
                parts += [(i, p) for p in own]
        at = 0
        while at < len(parts):
            end, n = at + 1, len(parts[at][1])
            while end < len(parts) and n + len(parts[end][1]) < _CHUNK:
                n += len(parts[end][1]) + 1
                end += 1
            ids, size, starts = self._looked_up("\n".join(p for _, p in parts[at:end]))
            begins = np.cumsum([0, *(len(p) + 1 for _, p in parts[at:end])])
            cut = (4 * np.r_[0, np.cumsum(size)])[np.searchsorted(starts, begins)].tolist()
            raw = ids.tobytes()
            for (i, _), x, y in zip(parts[at:end], cut[:-1], cut[1:]):
                out[i] += raw[x:y]
            at = end
        for (i, _), ids in zip(whole, self._ids([t for _, t in whole])):
            out[i] = ids
        return [x + self.end for x in out]


def assign(sizes: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(row, start, length, sequence, offset) of pieces that cover each row's tokens once; sequences count from 0."""
    out, bins = [], 0
    for r in np.flatnonzero(sizes >= capacity).tolist():
        for k in range(int(sizes[r]) // capacity):
            out.append((r, k * capacity, capacity, bins, 0))
            bins += 1
    rest = sizes % capacity
    order = [r for r in np.argsort(-rest, kind="stable").tolist() if rest[r]]
    n = -(-int(rest.sum()) // capacity)
    room, cost = np.full(n, capacity, np.int64), np.zeros(n)

    def put(r: int, start: int, length: int, b: int) -> None:
        out.append((r, start, length, bins + b, capacity - int(room[b])))
        room[b] -= length
        cost[b] += linear * length + quadratic * length * length

    for r in order:
        length, start = int(rest[r]), int(sizes[r] - rest[r])
        b = int(np.argmin(np.where(room >= length, cost, np.inf)))
        if room[b] >= length:
            put(r, start, length, b)
            continue
        while length:
            b = int(np.argmin(np.where(room > 0, cost, np.inf)))
            part = min(length, int(room[b]))
            put(r, start, part, b)
            start, length = start + part, length - part
    return out


#: A worker's encoder outlives its tasks, and so do the pieces it has looked up.
_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _packer(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get((path, end)) or _ENCODERS.setdefault((path, end), Encoder(path, end))
        held, ids, tokens = [], [], 0
        base = TaskContext.get().partitionId() << 36

        def flush() -> pa.RecordBatch:
            nonlocal base
            sizes = np.array([len(x) // 4 for x in held], np.int64)
            pieces = assign(sizes, capacity)
            rows = [(ids[r], s, n, zlib.crc32(memoryview(held[r])[4 * s : 4 * (s + n)]), int(sizes[r]), base + q, o) for r, s, n, q, o in pieces]
            base += max(q for *_, q, _ in pieces) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [c.split()[0] for c in _PIECE.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                more = encoder.encode(part.column(1).to_pylist())
                held += more
                ids += part.column(0).to_pylist()
                tokens += sum(map(len, more)) // 4
                if tokens >= SHARD_TOKENS:
                    yield flush()
                    held, ids, tokens = [], [], 0
        if held:
            yield flush()
        trim()

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row for each piece of each document of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packer(tokenizer, capacity, end), _PIECE)
