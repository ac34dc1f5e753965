"""Token counts of a SentencePiece BPE vocabulary by a compiled finite-state transducer.

The transducer reads characters; each transition is annotated with how many tokens the text read so far has gained (or
lost, when pieces join). BPE of a text ends with the one piece t for which the pair (last piece before t, t) stays as it is
under BPE; so the state after a character is the suffix that a longer piece could still begin in, with, at each place where
one could begin, the last piece up to there and the count relative to now. Equal states are one, and transitions are
compiled when first taken. No piece has a space mark after another character, so a space mark after one (and any character
outside the vocabulary, counted as its bytes) resets the state: a stretch between resets, a unit, maps every entry state
to the same exit and adds its own count. Counts of whole texts are prefix sums over their units.

A unit of over CHUNK characters is cut into chunks. Each chunk yields a state map, from entry states to exit state and tokens
gained: its entry is guessed by running the WARM characters before it from the start state, as transducers of this kind
forget what is further back. Maps of neighbours are composed pairwise, as in a parallel prefix scan; a map that is met from
an entry it lacks is extended by it, so that a wrong guess costs time and never changes a count.

Space runs: the pieces of several marks have the lowest score, so all others are joined before; a run of r marks before a
word counts as the word with its own mark, and r - 1 marks, or r if the word leaves its mark alone.

Edge cases: a null or empty text has no tokens; repeated rows each have their row; an empty table gives no rows; other
columns are ignored; a very long text, with or without spaces, is counted whole. The memo of units and the compiled states are dropped and built anew beyond a bound; counts stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm import common
from lineweave.llm.bytebpe import tokenizer_path

PIECE_BPE = "piece_bpe_32k.model"
MARK = "▁"
LIMIT = 4096
CHUNK = 256
WARM = 32
MEMO_UNITS = 1_000_000
MAX_STATES = 1_000_000

#: State: (suffix, ((start in suffix, last piece before, count relative to now, lone mark), ...)).
_START = ("", ((0, "", 0, False),))


class Transducer:
    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.score = {m.id_to_piece(i): m.get_score(i) for i in normal}
        assert not any(MARK in p.lstrip(MARK) for p in self.score), "pieces may not cross words"
        self.spaces = {p for p in self.score if len(p) > 1 and not p.strip(MARK)}
        for p in self.spaces:
            assert self.score[p] <= min(self.score.values())
        joined = [p for p in self.score if p not in self.spaces]
        self.alphabet = {p for p in joined if len(p) == 1}
        self.words = {p for p in joined if self._bpe(p) == [p]}
        self.begins = {p[:k] for p in self.words for k in range(1, len(p))} | {""}
        self.stays: dict[tuple[str, str], bool] = {}
        self.runs: list[int] = [0]
        self.memo = _Memo(self)
        self._clear()
        rest = "".join(map(re.escape, sorted(self.alphabet - {MARK})))
        self.units = re.compile(f"{MARK}*[{rest}]+|{MARK}+|[^{MARK}{rest}]").findall

    def _clear(self) -> None:
        self.numbers: dict[tuple, int] = {_START: 0}
        self.states: list[tuple] = [_START]
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]

    def _bpe(self, text: str) -> list[str]:
        """BPE of a short text without space runs: the best-scored adjacent pair is joined, the first of equals."""
        parts, score, spaces = list(text), self.score, self.spaces
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                both = parts[k] + parts[k + 1]
                s = score.get(both)
                if s is not None and (best is None or s > best) and both not in spaces:
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compile(self, state: tuple, c: str) -> tuple:
        """The state after c and the tokens gained; c is of the alphabet."""
        suffix, places = state
        longer = suffix + c
        for start, before, count, lone in places:  # the earliest start, and so the longest piece, first
            piece = longer[start:]
            if piece in self.words and self._stay(before, piece):
                gained, lone = count + 1, piece == MARK if not before else lone
                break
        else:
            raise AssertionError("no piece fits")
        kept = [(s, b, n - gained, o) for s, b, n, o in places if longer[s:] in self.begins] + [(len(longer), piece, 0, lone)]
        cut = kept[0][0]
        return (longer[cut:], tuple((s - cut, b, n, o) for s, b, n, o in kept)), gained

    def _stay(self, before: str, piece: str) -> bool:
        if not before:
            return True
        known = self.stays.get((before, piece))
        if known is None:
            known = self.stays[before, piece] = self._bpe(before + piece) == [before, piece]
        return known

    def chunk_map(self, state: int, chunk: str) -> tuple[int, int]:
        """Exit state and tokens gained of a chunk without resets, from an entry state."""
        total = 0
        for c in chunk:
            own = self.arcs[state]
            step = own.get(c)
            if step is None:
                after, gained = self._compile(self.states[state], c)
                number = self.numbers.setdefault(after, len(self.states))
                if number == len(self.states):
                    self.states.append(after)
                    self.arcs.append({})
                step = own[c] = number, gained
            state = step[0]
            total += step[1]
        return state, total

    def state_map(self, text: str, entries: Iterable[int]) -> dict[int, tuple[int, int]]:
        """Exit state and tokens gained of a chunk for each entry state."""
        return {e: self.chunk_map(e, text) for e in entries}

    def composed(self, text: str, chunk: int = CHUNK, warm: int = WARM) -> tuple[int, int]:
        """Exit state and tokens gained of a text without resets, from the start state, by composing the maps of its chunks."""
        maps = []
        for k in range(0, len(text), chunk):
            entry = self.chunk_map(0, text[max(0, k - warm) : k])[0] if k else 0
            maps.append((k, min(len(text), k + chunk), self.state_map(text[k : k + chunk], [entry])))
        while len(maps) > 1:
            over = []
            for (a, _, f), (b, c, g) in zip(maps[::2], maps[1::2], strict=False):
                for exit_, _ in f.values():
                    if exit_ not in g:
                        g.update(self.state_map(text[b:c], [exit_]))
                over.append((a, c, compose(f, g)))
            maps = over + maps[len(over) * 2 :]
        return maps[0][2][0] if maps else (0, 0)

    def unit(self, text: str) -> int:
        """Tokens of a unit: marks, then characters of the alphabet other than marks, or one other character."""
        word = text.lstrip(MARK)
        marks = len(text) - len(word)
        if not word:
            return self.run(marks)
        if len(word) == 1 and word not in self.alphabet:
            return len(word.encode())
        if len(self.states) > MAX_STATES:
            self._clear()
        text = MARK * bool(marks) + word
        state, total = self.chunk_map(0, text) if len(text) <= CHUNK else self.composed(text)
        if marks > 1:
            lone = self.states[state][1][-1][3]
            total += self.run(marks) - 1 if lone else self.run(marks - 1)
        return total

    def run(self, marks: int) -> int:
        """Tokens of marks alone."""
        while len(self.runs) <= marks:
            self.runs.append(_joined(len(self.runs), {len(p) for p in self.spaces}))
        return self.runs[marks]

    def counts(self, batch: list[str | None]) -> np.ndarray:
        """Tokens of each whole text: a prefix scan of what its units add."""
        if len(self.memo) > MEMO_UNITS:
            self.memo.clear()
        gained: list[int] = []
        ends = [0]
        for text in batch:
            if text:
                gained.extend(map(self.memo.__getitem__, self.units(MARK + text.replace(" ", MARK))))
            ends.append(len(gained))
        total = np.concatenate([[0], np.cumsum(np.array(gained, np.int64))])
        return np.diff(total[ends])


def compose(f: dict[int, tuple[int, int]], g: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """The state map of two chunks in a row; g has all exits of f."""
    return {e: (g[x][0], n + g[x][1]) for e, (x, n) in f.items()}


class _Memo(dict):
    """Counts of units; long ones aren't kept."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.transducer = transducer

    def __missing__(self, unit: str) -> int:
        n = self.transducer.unit(unit)
        if len(unit) <= 64:
            self[unit] = n
        return n


def _joined(marks: int, sizes: set[int]) -> int:
    """Pieces left of a run of marks when the leftmost adjacent two that make a piece are joined until none do."""
    done: list[int] = []
    rest = [1] * marks
    while rest:
        done.append(rest.pop())
        while len(done) > 1 and done[-2] + done[-1] in sizes:
            rest.append(done.pop() + done.pop())
            if done:
                rest.append(done.pop())
            done.append(rest.pop())
    return len(done)


_TRANSDUCERS: dict[str, Transducer] = {}


def transducer(name: str = PIECE_BPE) -> Transducer:
    """This worker's transducer of a vocabulary file."""
    if name not in _TRANSDUCERS:
        _TRANSDUCERS[name] = Transducer(tokenizer_path(name))
    return _TRANSDUCERS[name]


def counted(docs: DataFrame, *, vocabulary: str = PIECE_BPE, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each whole text."""

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for batch in batches:
            col = batch.column("text")
            _, offs = common.buffers(col)
            for a, b in common.chunks(offs):
                n = t.counts(col[a:b].to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(np.diff(offs[a : b + 1])), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    found = common.texts(docs).mapInArrow(ran, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
