"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids end together in a corpus.

A is a byte-level BPE over space + text, B a SentencePiece BPE over the text, to which it adds the space itself; so the
tokens of both cut the bytes of space + text, and a token has a start and an end there.

1. Both sides are encoded batch by batch; B's distinct units (a word with its spaces, or one character outside the
   vocabulary, which resets BPE) go to the library once per worker.
2. pandas.merge_asof on starts, keyed by document, finds for each token of one side the token of the other that covers its
   start. Both directions together are the overlapping pairs; those that end together are links, and their ends cut the
   tokens into groups.
3. A row per document, with its distinct links and how often it has each, is written. Their sums over all documents are the
   counts of id pairs. Where there are no more than PAIRS id pairs these are sent to all tasks; beyond, documents' links are
   joined with them.

Edge cases: a text that is null or empty, or that has a U+2581 or anything else that a side doesn't give back byte for byte,
has no tokens: zeros and an empty groups_sha256. Strings of special tokens are plain text. A very long text is aligned whole,
in a pass of its own; repeated rows, also without doc_id, each have their row and count as often as they stand; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm import common
from lineweave.llm.bytebpe import BYTE_BPE, Encoder, tokenizer_path
from lineweave.llm.token_counts import PIECE_BPE

MARK = "▁"
#: Id pairs up to which their counts are sent to all tasks, as two arrays of 8 bytes each.
PAIRS = 1_000_000
#: Bytes of a text that are a pass of their own.
PASS_BYTES = 1 << 19


class ByteSide(Encoder):
    """Byte-level BPE with special tokens' strings as plain text."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.special = []
        self.n_ids = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes_of = np.zeros(self.n_ids, np.int64)
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes_of[i] = len(piece)  # a character of a byte-level entry stands for a byte


class PieceSide:
    """SentencePiece BPE with byte fallback, each distinct unit encoded once per worker."""

    MEMO_UNITS, MEMO_BYTES = 500_000, 64

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n_ids = m.get_piece_size()
        self.piece = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(map(m.id_to_piece, range(self.n_ids)))]
        self.bytes_of = np.array([*map(len, self.piece)], np.int64)
        pieces = [m.id_to_piece(i) for i in range(self.n_ids) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece goes on after a space: words can't be encoded one by one")
        self.inside = np.zeros(0x110000, bool)
        self.inside[[ord(p) for p in pieces if len(p) == 1]] = True
        if self.inside[0x0A]:
            raise ValueError("a line feed is in the vocabulary and doesn't end a unit")
        self.before = len(m.encode("\n"))
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.start, self.size, self.flat, self.right = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, bool)

    def _begins(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Flags of the bytes at which a unit starts. first: flags of the first bytes of texts."""
        inside = self.inside[data]  # a byte over 0x7F is set right below
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64)
            b0, b1, b2, b3 = (wide[lead + j] for j in range(4))
            two = ((b0 & 0x1F) << 6) | (b1 & 0x3F)
            three = ((b0 & 0x0F) << 12) | ((b1 & 0x3F) << 6) | (b2 & 0x3F)
            four = ((b0 & 0x07) << 18) | ((b1 & 0x3F) << 12) | ((b2 & 0x3F) << 6) | (b3 & 0x3F)
            known = self.inside[np.where(b0 < 0xE0, two, np.where(b0 < 0xF0, three, np.minimum(four, 0x10FFFF)))]
            more = 1 + (b0 >= 0xE0) + (b0 >= 0xF0)
            for j in range(4):
                inside[lead[more >= j] + j] = known[more >= j]
        blank, head = data == 0x20, (data & 0xC0) != 0x80
        odd = ~inside & ~blank
        begins = first.copy()
        begins |= odd & head
        begins[1:] |= head[1:] & (odd[:-1] | (blank[1:] & ~blank[:-1]))
        return begins

    def _numbers(self, entries: list[bytes]) -> np.ndarray:
        if len(self.index) > self.MEMO_UNITS:
            self._clear()
        out = list(map(self.index.get, entries))
        new = [k for k, x in enumerate(out) if x is None]
        if new:
            found = [x[self.before :] for x in self.model.encode(["\n" + entries[k].decode() for k in new], num_threads=1)]
            base = len(self.start)
            for j, k in enumerate(new):
                out[k] = base + j
                if len(entries[k]) <= self.MEMO_BYTES:
                    self.index[entries[k]] = out[k]
            size = np.fromiter(map(len, found), np.int64, len(found))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in found for i in x), np.uint32, int(size.sum()))])
            self.right = np.concatenate([self.right, np.array([b"".join(map(self.piece.__getitem__, x)) == entries[k] for k, x in zip(new, found, strict=True)], bool)])
        return np.array(out, np.int64)

    def encode_flat(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of texts laid end to end, each with a space before it; the bounds of their ids; which texts come back byte for byte."""
        rows = len(offs) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64), np.ones(rows, bool)
        first = np.zeros(len(data) + 1, bool)
        first[offs] = True
        starts = np.flatnonzero(self._begins(data, first[:-1]))
        bounds = np.append(starts, len(data)).astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        at = self._numbers(found.dictionary.to_numpy(zero_copy_only=False).tolist())[found.indices.to_numpy()]
        size = self.size[at]
        after = np.cumsum(size)
        place = np.arange(int(after[-1]))
        place += np.repeat(self.start[at] - (after - size), size)
        right = np.ones(rows, bool)
        right[np.searchsorted(offs, starts[~self.right[at]], side="right") - 1] = False
        return self.flat[place], np.concatenate([[0], after])[np.searchsorted(starts, offs)], right


class Aligner:
    """Both sides, and the written form of each id with what stands after it."""

    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = ByteSide(tokenizer_path(a)), PieceSide(tokenizer_path(b))
        said = [b"%d%s" % (i, sep) for n, seps in ((self.a.n_ids, (b",", b"|")), (self.b.n_ids, (b",", b";", b""))) for sep in seps for i in range(n)]
        width = max(map(len, said))
        self.written = np.frombuffer(b"".join(x.ljust(width, b" ") for x in said), np.uint8).reshape(-1, width)
        self.filled = self.written != 0x20

    def spaced(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A space before each text that has a byte and no U+2581; other texts have none left."""
        raw, rows = data.tobytes(), np.diff(offs)
        keep, at = rows > 0, raw.find(MARK.encode())
        while at >= 0:
            keep[np.searchsorted(offs, at, side="right") - 1] = False
            at = raw.find(MARK.encode(), at + 1)
        ends = np.concatenate([[0], np.cumsum(np.where(keep, rows + 1, 0))])
        out = np.full(int(ends[-1]), 0x20, np.uint8)
        is_text = np.ones(len(out), bool)
        is_text[ends[:-1][keep]] = False
        out[is_text] = data[np.repeat(keep, rows)]
        return out, ends

    def align(self, data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray | list]:
        """What each text has, and its distinct links, in rows laid end to end (`bounds`)."""
        data, ends = self.spaced(data, offs)
        b, b_at, right = self.b.encode_flat(data, ends)
        if not right.all():  # those texts have no tokens
            data, ends = data[np.repeat(right, np.diff(ends))], np.concatenate([[0], np.cumsum(np.where(right, np.diff(ends), 0))])
            b, b_at, _ = self.b.encode_flat(data, ends)
        a, a_at = self.a.encode_flat(data, ends)
        rows = len(ends) - 1
        sides = []
        for ids, at, side in ((a, a_at, self.a), (b, b_at, self.b)):
            end = np.concatenate([[0], np.cumsum(side.bytes_of[ids])])
            if not np.array_equal(end[at], ends):
                raise ValueError("tokens don't cover their texts")
            sides.append(pd.DataFrame({"start": end[:-1], "doc": np.repeat(np.arange(rows), np.diff(at)), "at": np.arange(len(ids)), "end": end[1:]}, copy=False))
        left, over = sides
        of_a = pd.merge_asof(left[["start", "doc"]], over[["start", "doc", "at"]], on="start", by="doc")["at"].to_numpy()
        of_b = pd.merge_asof(over[["start", "doc"]], left[["start", "doc", "at"]], on="start", by="doc")["at"].to_numpy()
        # overlapping pairs: of either direction, those that start together once
        apart = left["start"].to_numpy()[of_b] != over["start"].to_numpy()
        overlaps = np.concatenate([np.arange(len(a)), of_b[apart]]), np.concatenate([of_a, np.flatnonzero(apart)])
        together = left["end"].to_numpy()[overlaps[0]] == over["end"].to_numpy()[overlaps[1]]
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[overlaps[0][together]] = last_b[overlaps[1][together]] = True
        la, lb = np.flatnonzero(last_a), np.flatnonzero(last_b)  # a token has one link at most, and both sides have them in order
        link_at = np.concatenate([[0], np.cumsum(last_a)])[a_at]
        known, number = np.unique((a[la].astype(np.int64) << 32) | b[lb].astype(np.int64), return_inverse=True)
        own, n = np.unique(np.repeat(np.arange(rows), np.diff(link_at)) * max(1, len(known)) + number, return_counts=True)
        of = own // max(1, len(known))
        return {
            "n_a": np.diff(a_at), "n_b": np.diff(b_at), "n_groups": np.diff(link_at), "groups_sha256": self._hashes(a, b, a_at, b_at, la, lb),
            "codes": known[own - of * max(1, len(known))], "ns": n, "bounds": np.searchsorted(of, np.arange(rows + 1)),
        }

    def _hashes(self, a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, la: np.ndarray, lb: np.ndarray) -> list[str]:
        """The hash of the written groups of each text. la, lb: the last tokens of each group."""
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[la] = last_b[lb] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        code = np.zeros(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.concatenate([[0], lb + 1])[group_a]] = a + last_a * self.a.n_ids
        last_b[b_at[1:][np.diff(b_at) > 0] - 1] = 2
        code[np.arange(len(b)) + (la + 1)[group_b]] = b + last_b * self.b.n_ids + 2 * self.a.n_ids
        at = (a_at + b_at).tolist()
        out = []
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            h = hashlib.sha256()
            for k in range(lo, hi, 1 << 16):
                own = code[k : min(hi, k + (1 << 16))]
                h.update(self.written[own][self.filled[own]].tobytes())
            out.append(h.hexdigest() if hi > lo else "")
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a: str = BYTE_BPE, b: str = PIECE_BPE) -> Aligner:
    """This worker's aligner of two vocabulary files."""
    if (a, b) not in _ALIGNERS:
        _ALIGNERS[a, b] = Aligner(a, b)
    return _ALIGNERS[a, b]


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, codes array<long>, ns array<long>"
_LONGS = ("n_a", "n_b", "n_groups")


def aligned(docs: DataFrame, *, key: str = "doc_id", text: str = "text", a: str = BYTE_BPE, b: str = PIECE_BPE) -> DataFrame:
    """A row per document: tokens of either side, groups, their hash, and its distinct links (A's id << 32 | B's id) with how often it has them."""

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a, b)
        for batch in batches:
            data, offs = common.buffers(batch.column("text"))
            for lo, hi in common.chunks(offs, PASS_BYTES):
                x = both.align(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                bounds = pa.array(x["bounds"].astype(np.int32))
                cols = [batch.column("doc_id")[lo:hi], *(pa.array(x[c].astype(np.int64)) for c in _LONGS), pa.array(x["groups_sha256"], pa.string())]
                cols += [pa.ListArray.from_arrays(bounds, pa.array(x[c].astype(np.int64))) for c in ("codes", "ns")]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *_LONGS, "groups_sha256", "codes", "ns"])

    return common.texts(docs, key, text).mapInArrow(ran, ALIGNED)


def pair_counts(found: DataFrame) -> DataFrame:
    """a, b, n and best: the id pairs of aligned() documents, how often they are linked, and whether none is linked with b more often."""
    each = found.select(F.explode(F.arrays_zip("codes", "ns")).alias("x")).select(F.col("x.codes").alias("code"), F.col("x.ns").alias("n"))
    pairs = common.cut(each.groupBy("code").agg(F.sum("n").alias("n")), "pair-counts")
    b = F.col("code").bitwiseAND((1 << 32) - 1)
    top = pairs.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return pairs.withColumn("b", b).join(top, "b").select("code", F.shiftright("code", 32).alias("a"), "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _looked_up(found: DataFrame, counts: DataFrame) -> DataFrame:
    """n_best and count_sum of each document from counts that are sent to all tasks."""
    table = counts.select("code", (F.col("n") * 2 + F.col("best").cast("long")).alias("n")).toArrow()
    code, n = table.column("code").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(code)
    sent = found.sparkSession.sparkContext.broadcast((code[order], n[order]))

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n = sent.value
        for batch in batches:
            x = batch.column("codes")
            own, times = x.flatten().to_numpy(), batch.column("ns").flatten().to_numpy()
            bounds = x.offsets.to_numpy().astype(np.int64)
            bounds -= bounds[0]
            total = n[np.searchsorted(code, own)] if len(own) else np.zeros(0, np.int64)
            sums = [np.diff(np.concatenate([[0], np.cumsum(v)])[bounds]) for v in (times * (total & 1), times * (total >> 1))]
            cols = [*(batch.column(c) for c in kept), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "n_best", "count_sum"])

    kept = ["doc_id", *_LONGS, "groups_sha256"]
    common.small_batches(found.sparkSession)
    return found.mapInArrow(ran, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long")


def _joined(found: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by a join of all links with the counts, whatever their number."""
    each = found.select("nth", F.explode(F.arrays_zip("codes", "ns")).alias("x")).select("nth", F.col("x.codes").alias("code"), F.col("x.ns").alias("times"))
    sums = each.join(counts.select("code", "n", "best"), "code").groupBy("nth").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    return found.join(sums, "nth", "left").select("doc_id", *_LONGS, "groups_sha256", *zero)


def digests(docs: DataFrame, *, a: str = BYTE_BPE, b: str = PIECE_BPE, most_pairs: int = PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document."""
    found = common.cut(aligned(docs, a=a, b=b).withColumn("nth", F.monotonically_increasing_id()), "aligned")
    counts = common.cut(pair_counts(found), "pair-counts-best")
    done = _looked_up(found, counts) if counts.count() <= most_pairs else _joined(found, counts)
    return done.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
