"""Secret scans: fixed patterns, and formats inferred from the credentials they find.

The fixed patterns label credentials by kind (assign, access, hex). From at most SAMPLE distinct credentials a kind (smallest
xxhash64 first; those of over LONGEST characters are not learned from) a prefix tree is built. Its symbols are repertoires: a
credential falls into segments at ``-``, ``_``, ``.`` and ``=``, and each character of a segment stands for the smallest of digits,
hex digits (small, capital), letters and digits (small, capital, both) and these with ``+`` and ``/`` that holds the segment; a
separator stands for itself. States that are statistically compatible are merged (red and blue states, Hoeffding's bound on the ends and
on every transition, down the folded subtrees), which leaves one probabilistic automaton a kind: chains where lengths are fixed, loops where
they vary. A state also counts the characters seen on each transition, so literal beginnings weigh what they tell.

Ordinary text is a model of its own: pairs of neighbouring characters within runs of credential characters, counted over all
documents, labelled credentials left out. A candidate is a maximal run of LEAST and more credential characters (closing ``-``, ``_`` and
``.`` left off). It is one more span, of the kind ``format``, if it overlaps no fixed span, an automaton generates it, ends included, and
its likelihood there exceeds the likelihood as ordinary text by the factor exp(MARGIN). Fixed spans always stay.

Offsets are code points, ends exclusive; a null text is empty; repeated ids are scanned row by row; without any credential there
are no automata and only fixed spans; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep
from .textops import slices, trim

#: The patterns of the fixed kinds; a match that fails its condition is dropped, not searched again.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs of 32 and more: a shorter run is dropped whole
KINDS = ("assign", "access", "hex", "format")
_HINTS = ("passw", "secret", "token", "api")
LEAST = 8
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.\-]{%d,}={0,2}" % LEAST)

SAMPLE, LONGEST, ALPHA, MARGIN = 400, 512, 0.05, 12.0
_END = "$"

Span = tuple[int, int, str]


def fixed_spans(text: str) -> list[Span]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    out: list[Span] = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def credential(text: str, span: Span) -> str:
    """The credential in a fixed span: the value of an assignment, else the whole span."""
    found = text[span[0] : span[1]]
    return ASSIGN.match(found)[2] if span[2] == "assign" else found


_DIGITS, _SMALL, _CAPITAL = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Repertoires of a segment, smaller ones first.
REPERTOIRES = {
    "d": _DIGITS,
    "h": _DIGITS + "abcdef",
    "H": _DIGITS + "ABCDEF",
    "l": _DIGITS + _SMALL,
    "U": _DIGITS + _CAPITAL,
    "m": _DIGITS + _SMALL + _CAPITAL,
    "b": _DIGITS + _SMALL + _CAPITAL + "+/",
}
_HOLDS = {k: frozenset(v) for k, v in REPERTOIRES.items()}
_WITHIN = {k: [w for w in REPERTOIRES if _HOLDS[k] <= _HOLDS[w]] for k in REPERTOIRES}
_SEGMENT = re.compile(r"[-_.=]|[^-_.=]+")


def segments(text: str) -> list[tuple[str, str]]:
    """(symbol, characters): separators for themselves, other stretches under their smallest repertoire."""
    out = []
    for part in _SEGMENT.findall(text):
        own = set(part)
        out.append((part if part in "-_.=" else next(k for k, v in _HOLDS.items() if own <= v), part))
    return out


class Automaton:
    """States with counted transitions by symbol, the characters seen on each, and, under _END, the strings that stop there."""

    def __init__(self, states: list[dict[str, int]], target: list[dict[str, int]], chars: list[dict[str, Counter]]):
        self.target, self.step, self.end = target, [], []
        for counts, seen in zip(states, chars):
            total, step = sum(counts.values()), {}
            for c, n in counts.items():
                if c != _END:
                    size = len(REPERTOIRES.get(c, c))
                    step[c] = (math.log(n / total), {x: math.log((k + 0.5) / (n + 0.5 * size)) for x, k in seen[c].items()}, math.log(0.5 / (n + 0.5 * size)))
            self.step.append(step)
            self.end.append(math.log(counts[_END] / total) if counts.get(_END) else None)

    def log_likelihood(self, parts: list[tuple[str, str]]) -> float:
        """Of a string of such segments, by its likeliest path; minus infinity if no path ends with it."""
        at = {0: 0.0}
        for symbol, part in parts:
            then: dict[int, float] = {}
            for c in _WITHIN.get(symbol, symbol):
                for state, total in at.items():
                    for x in part:
                        step = self.step[state].get(c)
                        if step is None:
                            break
                        total += step[0] + step[1].get(x, step[2])
                        state = self.target[state][c]
                    else:
                        then[state] = max(total, then.get(state, -math.inf))
            at = then
        return max((total + self.end[s] for s, total in at.items() if self.end[s] is not None), default=-math.inf)


def infer(strings: list[str], alpha: float = ALPHA) -> Automaton | None:
    """Merge compatible states of the strings' prefix tree, shallow states first."""
    if not strings:
        return None
    counts: list[dict[str, int]] = [defaultdict(int)]
    target: list[dict[str, int]] = [{}]
    chars: list[dict[str, Counter]] = [defaultdict(Counter)]
    for s in sorted(strings):
        at = 0
        for c, part in segments(s):
            for x in part:
                counts[at][c] += 1
                chars[at][c][x] += 1
                if c not in target[at]:
                    target[at][c] = len(counts)
                    counts.append(defaultdict(int))
                    target.append({})
                    chars.append(defaultdict(Counter))
                at = target[at][c]
        counts[at][_END] += 1
    slack = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(x: int, n: int, y: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(x / n - y / m) > slack * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            n, m = sum(counts[a].values()), sum(counts[b].values())
            if any(differ(counts[a].get(c, 0), n, counts[b].get(c, 0), m) for c in counts[a].keys() | counts[b].keys()):
                return False
            todo += [(target[a][c], target[b][c]) for c in target[a].keys() & target[b].keys() if target[a][c] != target[b][c]]
        return True

    def fold(p: int, q: int) -> None:
        """The tree under q is added to the states from p on."""
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            for c, n in counts[b].items():
                counts[a][c] += n
            for c, seen in chars[b].items():
                chars[a][c].update(seen)
            for c, t in target[b].items():
                if c in target[a]:
                    todo.append((target[a][c], t))
                else:
                    target[a][c] = t

    red, blue, order = {0}, [(0, c) for c in sorted(target[0])], [0]
    while blue:
        p, c = blue.pop(0)
        q = target[p][c]
        if q in red:
            continue
        same = next((r for r in order if compatible(r, q)), None)
        if same is None:
            red.add(q)
            order.append(q)
        else:
            target[p][c] = same
            fold(same, q)
        blue = [(r, x) for r in order for x in sorted(target[r]) if target[r][x] not in red]
    place = {r: k for k, r in enumerate(order)}
    return Automaton([dict(counts[r]) for r in order], [{c: place[t] for c, t in target[r].items()} for r in order], [chars[r] for r in order])


#: Characters of candidates as numbers from 1; 0 is everything else, before and after a run.
_CODE = np.zeros(256, np.int64)
for _k, _c in enumerate(REPERTOIRES["b"] + "-_.="):
    _CODE[ord(_c)] = _k + 1
_CODES = len(REPERTOIRES["b"]) + 5


def pairs_of(codes: np.ndarray) -> np.ndarray:
    """How often each character follows each, as one vector; codes begin and end with 0."""
    return np.bincount(codes[:-1] * _CODES + codes[1:], minlength=_CODES * _CODES)


def _coded(text: str) -> np.ndarray:
    return np.r_[0, _CODE[np.frombuffer(text.encode("ascii"), np.uint8)], 0]


@dataclass
class Formats:
    """What is learned: the automata, and the log-probability of each character after each in ordinary text."""

    automata: list[Automaton] = field(default_factory=list)
    ordinary: np.ndarray = field(default_factory=lambda: np.zeros((_CODES, _CODES)))
    known: dict[str, bool] = field(default_factory=dict)

    @classmethod
    def of(cls, automata: list[Automaton], pairs: np.ndarray) -> "Formats":
        n = np.maximum(pairs.reshape(_CODES, _CODES), 0) + 0.5
        n[0, 0] = 0.5  # what lies between runs says nothing of them
        return cls(automata, np.log(n / n.sum(1, keepdims=True)))

    def log_odds(self, text: str) -> float:
        parts = segments(text)
        best = max((a.log_likelihood(parts) for a in self.automata), default=-math.inf)
        if best == -math.inf:
            return best
        codes = _coded(text)
        return best - float(self.ordinary[codes[:-1], codes[1:]].sum())

    def accepts(self, run: str, margin: float) -> bool:
        """Whether a candidate has a known format; answers to short ones are kept, for so many of them as fit."""
        told = self.known.get(run)
        if told is None:
            told = len(run) >= LEAST and self.log_odds(run) >= margin
            if len(run) <= 64 and len(self.known) < 1_000_000:
                self.known[run] = told
        return told

    def __getstate__(self):
        return {"automata": self.automata, "ordinary": self.ordinary, "known": {}}


def _run(found: str) -> str:
    return found.rstrip("-_.")


def all_spans(text: str, formats: Formats, margin: float = MARGIN) -> tuple[list[Span], list[Span]]:
    """(fixed spans, all spans) of a text."""
    fixed = fixed_spans(text)
    more: list[Span] = []
    if formats.automata and any(formats.accepts(_run(w), margin) for w in set(CANDIDATE.findall(text))):
        for m in CANDIDATE.finditer(text):
            run = _run(m[0])
            start, end = m.start(), m.start() + len(run)
            if formats.accepts(run, margin) and not any(s < end and e > start for s, e, _ in fixed):
                more.append((start, end, "format"))
    return fixed, sorted(fixed + more, key=lambda s: (s[0], KINDS.index(s[2])))


def _told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, value, n): distinct labelled credentials of each batch, and under no kind a task's pairs of characters by their place."""
    pairs, names = np.zeros(_CODES * _CODES, np.int64), ["kind", "value", "n"]
    for batch in batches:
        found = set()
        for t in batch.column(0).to_pylist():
            for s in fixed_spans(t) if t else ():
                value = credential(t, s)
                found.add((s[2], value))
                pairs -= pairs_of(_coded(value))
        for _, _, buf, offs in slices(batch.column(0), 1 << 20, 1 << 16):
            # a zero stands before each row
            codes = np.insert(_CODE[buf], offs[:-1], 0)
            pairs += pairs_of(np.r_[codes, 0])
        if found:
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in zip(*sorted(found))), pa.array([1] * len(found), pa.int64())], names)
    some = np.flatnonzero(pairs)
    yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.string()), pa.array([str(k) for k in some], pa.string()), pa.array(pairs[some], pa.int64())], names)
    trim()


def learn(docs: DataFrame, sample: int = SAMPLE) -> Formats:
    """One automaton a kind, from a bounded sample of its distinct credentials, beside the pairs of characters of all rows."""
    found = keep(docs.select("text").mapInArrow(_gathered, "kind string, value string, n long"), "credentials")
    automata = []
    for kind in KINDS[:3]:
        rows = found.where((F.col("kind") == kind) & (F.length("value") <= LONGEST)).select("value").distinct()
        automata.append(infer([r.value for r in rows.orderBy(F.xxhash64("value"), "value").limit(sample).collect()]))
    pairs = np.zeros(_CODES * _CODES)
    for r in found.where("kind is null").groupBy("value").agg(F.sum("n").alias("n")).collect():
        pairs[int(r.value)] = r.n
    forget(found)
    return Formats.of([a for a in automata if a is not None], pairs)


def _scanner(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [all_spans(t or "", shared.value) for t in batch.column(1).to_pylist()]
            count = [Counter(k for *_, k in fixed) for fixed, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array([c[k] for c in count], pa.int64()) for k in KINDS[:3]),
                    pa.array([hashlib.sha256(_told(fixed).encode()).hexdigest() for fixed, _ in rows]),
                    pa.array([_told(spans) for _, spans in rows], pa.string()),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return run


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scanner(shared), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_text(text: str, formats: Formats) -> str:
    """Each span, overlapping ones together, becomes its first kind in brackets."""
    out, at, end = [], 0, -1
    for s, e, kind in all_spans(text, formats)[1]:
        if s >= end:
            out += [text[at:s] if s > at else "", f"[{kind}]"]
        at = end = max(end, e)
    return "".join(out) + text[at:]


def _redactor(shared, names: list[str]):
    place, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = [t if t is None else redact_text(t, shared.value) for t in columns[place].to_pylist()]
            columns[place] = pa.array(texts, columns[place].type)
            if size is not None:
                old = columns[size].to_pylist()
                columns[size] = pa.array([n if t is None or n is None else len(t) for t, n in zip(texts, old)], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def redact(docs: DataFrame) -> DataFrame:
    """Stage: every row stays, its secrets replaced by their kind; n_chars follows the text."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))
    return docs.mapInArrow(_redactor(shared, docs.columns), docs.schema)
