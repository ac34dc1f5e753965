"""Secret scans: fixed formats, and probabilistic automata inferred from labelled credentials.

Base spans come from three fixed patterns. What they find in the corpus, one example per distinct string, is the labelled
sample: LABELLED strings per kind, those with the smallest hashes, so that it is bounded and the same for any partitioning.
A prefix tree of each kind's strings, over character classes, is folded into a deterministic probabilistic automaton by
state merging in the red-blue order: two states merge if Hoeffding's bound at ALPHA can't tell their stop and transition
frequencies apart, all the way down. Ordinary tokens that occur in the texts in which the secrets were found give a
background automaton. Every candidate, a run of LEAST_CHARS or more credential characters outside the base spans, is scored by its log likelihood per character under the best format minus that under the background;
those over MARGIN, and no more than SLACK less likely than all but one in a hundred of the labelled strings, are spans of
kind `format`.

Edge cases: a null or empty text has no spans; a very long text, or candidate, is scored whole; of strings with one hash
the smaller is labelled first; no labelled strings means no automata and base spans only; repeated rows
each have their row; an empty table gives no rows; other columns are ignored or, in redacted(), kept.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm import common

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32
#: What every match of ASSIGN begins with, in lower case.
ASSIGN_STARTS = (b"passw", b"secret", b"token", b"api")

LEAST_CHARS = 16
LABELLED = 400
ALPHA = 0.05
MARGIN = 1.0
SLACK = 0.25

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_CREDENTIAL = np.zeros(256, bool)
_CREDENTIAL[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True

#: Character classes: digits, a-f, other lower case, A-F, other upper case, and each symbol.
_CLASSES = [b"0123456789", b"abcdef", b"ghijklmnopqrstuvwxyz", b"ABCDEF", b"GHIJKLMNOPQRSTUVWXYZ", *(bytes([c]) for c in b"+/_.=-")]
_CLASS_OF = np.full(256, -1, np.int64)
for _k, _chars in enumerate(_CLASSES):
    _CLASS_OF[list(_chars)] = _k
_LOG_SIZE = np.log([len(c) for c in _CLASSES])


@dataclass
class Automaton:
    """next[state, class] (-1: none), log probabilities of transitions and of stopping."""

    next: np.ndarray
    step: np.ndarray
    stop: np.ndarray
    floor: float = -math.inf

    def score(self, token: bytes) -> float:
        """Log likelihood per character; unseen transitions count as one in the number of strings seen there."""
        state, total = 0, 0.0
        for c in _CLASS_OF[np.frombuffer(token, np.uint8)].tolist():
            if c < 0:
                return -math.inf
            total += self.step[state, c] - _LOG_SIZE[c]
            after = self.next[state, c]
            state = after if after >= 0 else 0
        return (total + self.stop[state]) / max(1, len(token))


def infer(strings: list[bytes], alpha: float = ALPHA) -> Automaton | None:
    """The automaton of labelled strings, by merging compatible states of their prefix tree."""
    if not strings:
        return None
    arcs: list[dict[int, list]] = [{}]  # class -> [target, count]
    ends = [0]
    for s in sorted(strings):
        at = 0
        for c in _CLASS_OF[np.frombuffer(s, np.uint8)].tolist():
            if c not in arcs[at]:
                arcs[at][c] = [len(arcs), 0]
                arcs.append({})
                ends.append(0)
            arcs[at][c][1] += 1
            at = arcs[at][c][0]
        ends[at] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def total(q: int) -> int:
        return ends[q] + sum(x[1] for x in arcs[q].values())

    def alike(p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            n, m = total(a), total(b)
            most = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(ends[a] / n - ends[b] / m) > most:
                return False
            for c in arcs[a].keys() | arcs[b].keys():
                x, y = arcs[a].get(c), arcs[b].get(c)
                if abs((x[1] if x else 0) / n - (y[1] if y else 0) / m) > most:
                    return False
                if x and y and x[0] != y[0]:
                    todo.append((x[0], y[0]))
        return True

    def fold(p: int, q: int) -> None:
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            ends[a] += ends[b]
            for c, (to, n) in arcs[b].items():
                if c in arcs[a]:
                    arcs[a][c][1] += n
                    if arcs[a][c][0] != to:
                        todo.append((arcs[a][c][0], to))
                else:
                    arcs[a][c] = [to, n]

    red, blue = [0], [(0, c) for c in sorted(arcs[0])]
    while blue:
        p, c = blue.pop(0)
        if c not in arcs[p] or (q := arcs[p][c][0]) in red:
            continue
        for r in red:
            if alike(r, q):
                arcs[p][c][0] = r
                fold(r, q)
                break
        else:
            red.append(q)
        blue = [(r, c) for r in red for c in sorted(arcs[r]) if arcs[r][c][0] not in red]
    number = {q: k for k, q in enumerate(red)}
    n = len(red)
    after, step, stop = np.full((n, len(_CLASSES)), -1), np.zeros((n, len(_CLASSES))), np.zeros(n)
    for q, k in number.items():
        weight = total(q) + 1.0
        step[k] = math.log(1 / weight / (len(_CLASSES) + 1))
        for c, (to, count) in arcs[q].items():
            after[k, c], step[k, c] = number[to], math.log((count + 1 / (len(_CLASSES) + 1)) / weight)
        stop[k] = math.log((ends[q] + 1 / (len(_CLASSES) + 1)) / weight)
    out = Automaton(after, step, stop)
    out.floor = float(np.quantile([out.score(s) for s in strings], 0.01)) - SLACK
    return out


def base_spans(data: np.ndarray, offs: np.ndarray) -> list[list[tuple[int, str, int]]]:
    """Of each row the base spans as (start, kind, end) in bytes from the row's start, in order of the text."""
    out: list[list] = [[] for _ in range(len(offs) - 1)]
    starts, ends, row = common.words(data, offs, _HEX)
    long = ends - starts >= HEX_CHARS
    for s, e, r in zip(starts[long].tolist(), ends[long].tolist(), row[long].tolist(), strict=True):
        out[r].append((s - int(offs[r]), "hex", e - int(offs[r])))
    raw = data.tobytes()
    low = common.lowered(data).tobytes()
    for kind, where, signs, pattern, group, least in (("assign", low, ASSIGN_STARTS, ASSIGN, 2, ASSIGN_CHARS), ("access", raw, (b"AKIA",), ACCESS, 0, ACCESS_CHARS)):
        rows = set()
        for sign in signs:
            at = where.find(sign)
            while at >= 0:
                r = int(np.searchsorted(offs, at, side="right")) - 1
                rows.add(r)
                at = where.find(sign, int(offs[r + 1]))
        for r in rows:
            out[r] += [(m.start(), kind, m.end()) for m in pattern.finditer(raw[offs[r] : offs[r + 1]]) if len(m[group]) >= least]
    for spans in out:
        spans.sort(key=lambda x: (x[0], KINDS.index(x[1])))
    return out


def candidates(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of runs of LEAST_CHARS or more credential characters."""
    starts, ends, row = common.words(data, offs, _CREDENTIAL)
    keep = ends - starts >= LEAST_CHARS
    return starts[keep], ends[keep], row[keep]


class _Smallest:
    """The distinct tokens with the smallest hashes, `most` of them."""

    def __init__(self, most: int) -> None:
        self.most, self.known, self.sorted = most, set(), []

    def __len__(self) -> int:
        return len(self.sorted)

    @property
    def last(self) -> int:
        return self.sorted[-1][0]

    def add(self, h: int, token: bytes) -> None:
        if token not in self.known:
            self.known.add(token)
            bisect.insort(self.sorted, (h, token))
            if len(self.sorted) > self.most:
                self.known.discard(self.sorted.pop()[1])

    def items(self) -> list[tuple[int, bytes]]:
        return self.sorted


class _Touched:
    """Whether a stretch of a text meets one of its spans, from their sorted starts and the furthest end so far."""

    def __init__(self, spans: list[tuple[int, str, int]]):
        ordered = sorted((s, e) for s, _, e in spans)
        self.starts = [s for s, _ in ordered]
        self.ends = list(accumulate((e for _, e in ordered), max))

    def __call__(self, s: int, e: int) -> bool:
        k = bisect.bisect_left(self.starts, e)
        return k > 0 and self.ends[k - 1] > s


def labelled(docs: DataFrame, per_kind: int = LABELLED) -> dict[str, list[bytes]]:
    """A bounded sample of distinct strings by kind, and of ordinary tokens of the same texts as `background`: those that no
    span touches and that aren't labelled in their text."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(lambda: _Smallest(per_kind))
        for batch in batches:
            data, offs = common.buffers(batch.column("text"))
            rows: list[tuple[str, bytes]] = []
            for a, b in common.chunks(offs):
                part, own = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                for r, spans in enumerate(base_spans(part, own)):
                    if not spans:
                        continue
                    text = part[own[r] : own[r + 1]].tobytes()
                    own_tokens = [(kind, ASSIGN.match(text[s:e])[2] if kind == "assign" else text[s:e]) for s, kind, e in spans]
                    touched, secret = _Touched(spans), {token for _, token in own_tokens}
                    plain = [m[0] for m in re.finditer(rb"[A-Za-z0-9+/_.=-]{8,}", text) if not touched(*m.span())]
                    rows += own_tokens + [("background", t) for t in plain if t not in secret]
            for kind, token in dict.fromkeys(rows):
                own = held[kind]
                h = int.from_bytes(hashlib.blake2b(token, digest_size=7).digest(), "big")
                if len(own) < per_kind or h < own.last:
                    own.add(h, token)
        rows = [(kind, t, h) for kind, own in held.items() for h, t in own.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["kind", "token", "h"])

    rows = common.texts(docs).mapInArrow(found, "kind string, token binary, h long").distinct()  # per_kind of each kind from a task
    first = common.smallest(rows, "kind", ["h", "token"], per_kind)
    out: dict[str, list[bytes]] = {}
    for r in first.select("kind", "token").collect():  # per_kind rows of four kinds at most
        out.setdefault(r.kind, []).append(bytes(r.token))
    return {k: sorted(v) for k, v in out.items()}


def formats(sample: dict[str, list[bytes]]) -> dict[str, Automaton]:
    return {k: infer(v) for k, v in sorted(sample.items()) if v}


def scores(tokens: list[bytes], automaton: Automaton) -> np.ndarray:
    """Automaton.score() of many tokens, a character of each at a time."""
    size = np.array([len(t) for t in tokens], np.int64)
    out = np.zeros(len(tokens))
    order = np.argsort(-size, kind="stable")
    flat = _CLASS_OF[np.frombuffer(b"".join(tokens), np.uint8)]
    start = np.cumsum(size) - size
    bad = np.zeros(len(tokens), bool)
    state = np.zeros(len(tokens), np.int64)
    live = int(np.searchsorted(-size[order], 0))  # tokens with a character at this place are the first ones
    place = 0
    while live:
        own = order[:live]
        c = flat[start[own] + place]
        bad[own] |= c < 0
        c = np.maximum(c, 0)
        out[own] += automaton.step[state[own], c] - _LOG_SIZE[c]
        after = automaton.next[state[own], c]
        state[own] = np.where(after >= 0, after, 0)
        place += 1
        live = int(np.searchsorted(-size[order[:live]], -place))
    out = (out + automaton.stop[state]) / np.maximum(1, size)
    out[bad] = -math.inf
    return out


#: Tokens of more bytes are scored one by one.
LONG = 512


def likely(tokens: list[bytes], automata: dict[str, Automaton], margin: float = MARGIN) -> list[bool]:
    """Which tokens some format explains, and better than ordinary text does."""
    if not tokens or not automata:
        return [False] * len(tokens)
    long = [k for k, t in enumerate(tokens) if len(t) > LONG]
    short = [b"" if len(t) > LONG else t for t in tokens]

    def scored(a: Automaton) -> np.ndarray:
        out = scores(short, a)
        out[long] = [a.score(tokens[k]) for k in long]
        return out

    plain = scored(automata["background"]) if "background" in automata else np.full(len(tokens), -math.log(70))
    found = np.zeros(len(tokens), bool)
    for kind, a in automata.items():
        if kind != "background":
            own = scored(a)
            fits = own >= a.floor
            found[fits] |= own[fits] - plain[fits] > margin
    return found.tolist()


def all_spans(data: np.ndarray, offs: np.ndarray, automata: dict[str, Automaton]) -> list[list[tuple[int, str, int]]]:
    """Base spans and, outside them, the candidates that the automata find likely."""
    out = base_spans(data, offs)
    left, touched = [], [_Touched(spans) for spans in out]
    for s, e, r in zip(*(x.tolist() for x in candidates(data, offs)), strict=True):
        s, e = s - int(offs[r]), e - int(offs[r])
        if not touched[r](s, e):
            left.append((r, s, e, data[offs[r] + s : offs[r] + e].tobytes()))
    tokens = list(dict.fromkeys(x[3] for x in left))
    judged = dict(zip(tokens, likely(tokens, automata), strict=True))
    for r, s, e, token in left:
        if judged[token]:
            out[r].append((s, "format", e))
    for spans in out:
        spans.sort(key=lambda x: (x[0], KINDS.index(x[1])))
    return out


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def scanned(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of spans, in code points, of each document."""
    automata = docs.sparkSession.sparkContext.broadcast(formats(labelled(docs)))

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = common.buffers(batch.column("text"))
            for a, b in common.chunks(offs):
                part, own = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                cols: tuple[list, ...] = ([], [], [], [], [])
                for r, spans in enumerate(all_spans(part, own, automata.value)):
                    if spans:
                        before = np.concatenate([[0], np.cumsum((part[own[r] : own[r + 1]] & 0xC0) != 0x80)])
                        spans = [(int(before[s]), k, int(before[e])) for s, k, e in spans]
                    n = Counter(k for _, k, _ in spans)
                    base = _joined([x for x in spans if x[1] != "format"])
                    for col, x in zip(cols, (n["assign"], n["access"], n["hex"], hashlib.sha256(base.encode()).hexdigest(), _joined(spans)), strict=True):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return common.texts(docs).mapInArrow(ran, SCANNED)


#: What stands for a secret; of its own it is none.
MASK = b"[secret]"


def redacted(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with each span (overlapping ones as one) of text replaced by MASK; n_chars follows."""
    automata = docs.sparkSession.sparkContext.broadcast(formats(labelled(docs)))
    at = docs.columns.index("text")
    names, schema = docs.columns, docs.schema

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = common.buffers(batch.column(at))
            for a, b in common.chunks(offs):
                part, own = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                new = batch.column(at)[a:b].to_pylist()
                for r, spans in enumerate(all_spans(part, own, automata.value)):
                    if spans:
                        raw, out, last = part[own[r] : own[r + 1]].tobytes(), [], 0
                        for s, _, e in spans:
                            if s >= last:
                                out += [raw[last:s], MASK]
                            last = max(last, e)
                        new[r] = b"".join([*out, raw[last:]]).decode()
                yield pa.RecordBatch.from_arrays([pa.array(new, batch.schema.field(at).type) if k == at else batch.column(k)[a:b] for k in range(len(names))], schema=batch.schema)

    common.small_batches(docs.sparkSession)
    out = docs.mapInArrow(ran, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out
