"""Byte-level BPE ids by the tokenizers library, each distinct pre-token encoded once per worker.

Pre-tokens are found for a whole batch of texts at once, by arrays over its bytes; Arrow numbers the distinct ones, and only
those that a worker hasn't met go to the library's BPE. A text with a character outside _KNOWN, or with a special string,
is a single entry and goes to the library as it is.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from lineweave.llm import common

BYTE_BPE = "byte_bpe_50k.json"
#: Distinct pre-tokens kept by a worker before it starts anew; it changes speed and memory, never ids.
MEMO_WORDS = 500_000
#: Entries of more bytes aren't kept.
MEMO_BYTES = 64

#: The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: b for b in _PRINTABLE} | {b: 0x100 + k for k, b in enumerate(sorted({*range(0x100)} - {*_PRINTABLE}))}

#: Classes of characters in the ByteLevel pre-tokenizer.
_SPACE, _LETTER, _DIGIT, _MARK, _UNKNOWN = range(5)
#: Characters over U+007F on whose classes all Unicode versions agree.
_KNOWN = [*range(0xA1, 0xB2), *range(0xB4, 0xB9), 0xBA, 0xBB, *range(0xBF, 0x250), 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2026, 0x20AC]
_CLASS = np.full(0x10000, _UNKNOWN, np.uint8)
_CLASS[[0x09, 0x0A, 0x0D, 0x20]] = _SPACE
for _c in [*range(0x21, 0x7F), *_KNOWN]:
    _CLASS[_c] = _LETTER if chr(_c).isalpha() else _DIGIT if chr(_c).isdigit() else _MARK
_ASCII = np.concatenate([_CLASS[:0x80], np.full(0x80, _UNKNOWN, np.uint8)])
#: What the pre-tokenizer splits off after an apostrophe.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")

_ENCODERS: dict[str, Encoder] = {}


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; a path is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str = BYTE_BPE) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(tokenizer_path(name))
    return _ENCODERS[name]


def classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    kind = _ASCII[data]
    high = np.flatnonzero(data >= 0x80)
    if not len(high):
        return kind
    wide = np.concatenate([data, np.zeros(2, np.uint8)])
    lead = data[high]
    two, three = high[(lead >= 0xC2) & (lead < 0xE0)], high[(lead >= 0xE0) & (lead < 0xF0)]
    kind[two] = kind[two + 1] = _CLASS[((wide[two].astype(np.int32) & 0x1F) << 6) | (wide[two + 1] & 0x3F)]
    kind[three] = kind[three + 1] = kind[three + 2] = _CLASS[((wide[three].astype(np.int32) & 0x0F) << 12) | ((wide[three + 1].astype(np.int32) & 0x3F) << 6) | (wide[three + 2] & 0x3F)]
    return kind


def starts_of_pre_tokens(data: np.ndarray, first: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Flags of the bytes at which a pre-token starts. first: flags of the first bytes of texts, and one after the last."""
    n = len(data)
    begins = first[:n].copy()
    space = kind == _SPACE
    inside = ~first[1:n]  # byte i + 1 is of the same text as byte i
    change = kind[1:] != kind[:-1]
    blank = data == 0x20
    # a word takes one blank before it along; of other white space the last character stands alone, unless the text ends with it
    begins[1:] |= change & inside & (space[1:] | ~blank[:-1])
    begins[:-1] |= space[:-1] & ~space[1:] & inside
    for i in np.flatnonzero(data == 0x27).tolist():
        if not first[i] and (kind[i - 1] == _MARK or blank[i - 1]):
            continue
        for tail in CONTRACTIONS:
            end = i + 1 + len(tail)
            if data[i + 1 : end].tobytes() == tail and not first[i + 1 : end].any():
                begins[i + 1 : end] = False
                if end < n:
                    begins[end] = True
                break
    return begins


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _numbers(self, entries: list[bytes], direct: set[bytes]) -> np.ndarray:
        """The place of each distinct entry in start and size; new ones are encoded."""
        if len(self.index) > MEMO_WORDS:
            self._clear()
        index, model, ids = self.index, self.tokenizer.model, []
        out = list(map(index.get, entries))
        base = len(self.start)
        for k, x in enumerate(entries):
            if out[k] is None:
                out[k] = base + len(ids)
                if x in direct:
                    ids.append(self.tokenizer.encode(x.decode(), add_special_tokens=False).ids)
                else:
                    ids.append([t.id for t in model.tokenize(x.decode("latin-1").translate(_BYTES))])
                    if len(x) <= MEMO_BYTES:
                        index[x] = out[k]
        if ids:
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))])
        return np.array(out, np.int64)

    def encode_flat(self, data: np.ndarray, offs: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of UTF-8 texts laid end to end (offs: their bounds), with `end` after each if given, and the bounds of their ids."""
        rows = len(offs) - 1
        if not len(data):
            return np.full(rows, end, np.uint32) if end is not None else np.zeros(0, np.uint32), np.arange(rows + 1) * (end is not None)
        first = np.zeros(len(data) + 1, bool)
        first[offs] = True
        kind = classes(data)
        begins = starts_of_pre_tokens(data, first, kind)
        odd = np.unique(np.searchsorted(offs, np.flatnonzero(kind == _UNKNOWN), side="right") - 1).tolist()
        raw = data.tobytes()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                odd.append(int(np.searchsorted(offs, at, side="right")) - 1)
                at = raw.find(s, at + 1)
        direct = set()
        for r in set(odd):
            begins[offs[r] : offs[r + 1]] = False
            begins[offs[r]] = True
            direct.add(raw[offs[r] : offs[r + 1]])
        starts = np.flatnonzero(begins)
        bounds = np.append(starts, len(data)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        at = self._numbers(found.dictionary.to_numpy(zero_copy_only=False).tolist(), direct)[found.indices.to_numpy()]
        size = self.size[at]
        after = np.cumsum(size)
        place = np.arange(int(after[-1]))
        place += np.repeat(self.start[at] - (after - size), size)
        ids = self.flat[place]
        ends = np.concatenate([[0], after])[np.searchsorted(starts, offs)]
        if end is not None:
            ids, ends = np.insert(ids, ends[1:], end), ends + np.arange(rows + 1)
        return ids, ends

    def encode(self, batch: list[str | None]) -> list[np.ndarray]:
        """The ids of each whole text (None: none), as Tokenizer.encode(text, add_special_tokens=False) gives them."""
        data, offs = common.buffers(pa.array(batch, pa.large_string()))
        ids, ends = self.encode_flat(data, offs)
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
