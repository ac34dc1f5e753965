"""Best-fit packing improved by swap-based local search.

Pieces are dealt evenly into groups of about GROUP_PIECES, each packed by one task: best fit in descending order, and where
that leaves a bin more than the tokens need, best fit by size classes too; the search goes on from both, and the better
result is kept, so it never has more bins than best fit in descending order. The search takes the emptiest bin and moves one of its pieces into another underfull bin, swaps one for a shorter one
there, or two for one, whatever raises the sum of squared fills most, until the bin is empty; a bin that nothing helps is
left until one of its partners changes. Only lengths are moved, never ids. More pieces make more groups, not larger ones;
the emptiest bin of each group is packed again with those of the other groups. Full pieces are sequences of their own.

Edge cases: a null or empty text is the end id alone; repeated rows, and rows of one doc_id with different texts, are packed
as often as they stand; pieces of one length are interchangeable; an empty table gives no rows; a text longer than a
sequence, however long, is cut into full pieces after a first, shorter one; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm import common
from lineweave.llm.bytebpe import BYTE_BPE, encoder
from lineweave.llm.token_output import END_ID

MAX_TOKENS = 2048
GROUP_PIECES = 1 << 14
#: Steps of a group's search, at most so many times its pieces.
STEPS_PER_PIECE = 4


def best_fit(lengths: np.ndarray, cap: int) -> list[list[int]]:
    """Bins of indices: each piece in turn goes into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for i, size in enumerate(lengths.tolist()):
        k = bisect.bisect_left(room, (size, -1))
        if k < len(room):
            free, b = room.pop(k)
            bins[b].append(i)
        else:
            free, b = cap, len(bins)
            bins.append([i])
        if free > size:
            bisect.insort(room, (free - size, b))
    return bins


def local_search(lengths: np.ndarray, bins: list[list[int]], cap: int) -> list[list[int]]:
    """Fewer bins of the same pieces, where moves, swaps of one for one or of two for one find a way.

    What leaves the source for a place with room for x tokens gains most if it is the longest piece or pair of up to x
    tokens, so one table of the source's sizes finds the best step over all underfull bins and all their pieces.
    """
    members = [set(b) for b in bins]
    of = np.zeros(len(lengths), np.int64)
    for b, m in enumerate(bins):
        of[m] = b
    fill = np.bincount(of, weights=lengths, minlength=len(bins)).astype(np.int64)
    least, alive, steps = -(-int(lengths.sum()) // cap), len(bins), STEPS_PER_PIECE * len(lengths)
    failed = np.zeros(len(bins), bool)
    while alive > least and steps > 0:
        open_ = (fill > 0) & (fill < cap)
        sources = np.flatnonzero(open_ & ~failed)
        if len(sources) < 1:
            break
        source = int(sources[np.argmin(fill[sources])])
        while fill[source] and steps > 0:
            steps -= 1
            own: dict[int, list[int]] = {}
            for i in members[source]:
                own.setdefault(int(lengths[i]), []).append(i)
            one = np.zeros(cap + 1, np.int64)
            sizes = np.array(sorted(own), np.int64)
            one[sizes] = sizes
            two = one.copy()
            for s in sizes.tolist():
                with_s = s + (sizes[sizes >= s] if len(own[s]) > 1 else sizes[sizes > s])
                with_s = with_s[with_s <= cap]
                two[with_s] = with_s
            one, two = np.maximum.accumulate(one), np.maximum.accumulate(two)
            open_ = (fill > 0) & (fill < cap)
            open_[source] = False
            targets = np.flatnonzero(open_)
            others = np.flatnonzero(open_[of])
            moved = one[cap - fill[targets]]
            gains = 2 * moved * (fill[targets] - fill[source] + moved)
            k = int(np.argmax(gains)) if len(gains) else -1
            gain, size, back, to = (int(gains[k]), int(moved[k]), -1, int(targets[k])) if k >= 0 else (0, 0, -1, -1)
            there = of[others]
            delta = two[np.minimum(lengths[others] + cap - fill[there], cap)] - lengths[others]
            gains = np.where(delta > 0, 2 * delta * (fill[there] - fill[source] + delta), 0)
            k = int(np.argmax(gains)) if len(gains) else -1
            if k >= 0 and gains[k] > gain:
                gain, size, back, to = int(gains[k]), int(delta[k] + lengths[others[k]]), int(others[k]), int(there[k])
            if gain <= 0:
                failed[source] = True
                break
            if size in own and (back < 0 or one[size] == size):
                out = [own[size][0]]
            else:
                s = next(s for s in own if size - s in own and (size - s != s or len(own[s]) > 1))
                out = [own[s][0], own[size - s][-1]]
            for i in out:
                members[source].discard(i)
                members[to].add(i)
            if back >= 0:
                members[to].discard(back)
                members[source].add(back)
                of[back] = source
            of[out] = to
            change = size - (int(lengths[back]) if back >= 0 else 0)
            fill[source] -= change
            fill[to] += change
            failed[to] = False
        alive -= not fill[source]
    return [sorted(m) for m in members if m]


def by_size_class(lengths: np.ndarray) -> np.ndarray:
    """Long pieces first, by powers of two, as they stand within one."""
    return np.argsort(-np.frexp(lengths.astype(np.float64))[1], kind="stable")


def pack(lengths: np.ndarray, cap: int = MAX_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece."""
    least, found = -(-int(lengths.sum()) // cap), None
    for start in (np.argsort(-lengths, kind="stable"), by_size_class(lengths)):
        sizes = lengths[start]
        bins = local_search(sizes, best_fit(sizes, cap), cap)
        if found is None or len(bins) < len(found):
            order, ordered, found = start, sizes, bins
        if len(found) <= least:
            break
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, members in enumerate(found):
        sizes = ordered[members]
        bin_of[order[members]], offset[order[members]] = b, np.cumsum(sizes) - sizes
    return bin_of, offset


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECE}, sequence_id long, offset long"


def cut_pieces(n: int, cap: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """Start and length of each piece of n ids: all but the first are full."""
    first = n % cap or min(n, cap)
    return [(0, first)] + [(s, cap) for s in range(first, n, cap)]


def pieces(docs: DataFrame, *, cap: int = MAX_TOKENS, vocabulary: str = BYTE_BPE, with_ids: bool = False) -> DataFrame:
    """The pieces of each whole text, with their checksums and, if asked for, their ids."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            data, offs = common.buffers(batch.column("text"))
            for a, b in common.chunks(offs):
                ids, ends = enc.encode_flat(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], END_ID)
                ids = ids.astype("<u4")
                n = np.diff(ends)
                parts = np.maximum(1, -(-n // cap))
                row = np.repeat(np.arange(b - a), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                first = n - (parts - 1) * cap  # all pieces but the first are full
                start = np.where(piece > 0, first[row] + (piece - 1) * cap, 0)
                length = np.where(piece > 0, cap, first[row])
                at = ends[row] + start
                crcs = [zlib.crc32(ids[s:e]) for s, e in zip(at.tolist(), (at + length).tolist(), strict=True)]
                cols = [batch.column("doc_id")[a:b].take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
                if with_ids:
                    cols.append(pa.array([ids[s:e].astype(np.int64) for s, e in zip(at.tolist(), (at + length).tolist(), strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    return common.texts(docs).mapInArrow(made, PIECE + ", ids array<long>" * with_ids)


#: Sequence numbers of the groups' packing, of the second packing and of full pieces begin at multiples of this.
_RANGE = 1 << 61


def _packed_groups(found: DataFrame, rows: int, cap: int, group: int, base: int) -> DataFrame:
    """Adds sequence_id, offset and whether the sequence is the emptiest of its group, about `group` pieces each."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            lengths = t.column("length").to_numpy()
            bin_of, offset = pack(lengths, cap)
            last = bin_of == np.argmin(np.bincount(bin_of, weights=lengths))
            for name, x in (("sequence_id", bin_of + (base + (TaskContext.get().partitionId() << 32))), ("offset", offset), ("emptiest", last)):
                t = t.append_column(name, pa.array(x))
            yield from t.to_batches(4096)

    return found.select("doc_id", "piece", "start", "length", "ids_crc32").repartition(max(1, math.ceil(rows / group))).mapInArrow(packed, PACKED + ", emptiest boolean")


def pack_pieces(found: DataFrame, *, cap: int = MAX_TOKENS, group: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces of at most cap tokens. found: a table that is cheap to read more than once."""
    short = found.where(F.col("length") < cap)
    once = common.cut(_packed_groups(short, short.count(), cap, group, 0), "packed")
    rest = once.where("emptiest")
    again = _packed_groups(rest, rest.count(), cap, group, _RANGE).drop("emptiest")
    full = found.where(F.col("length") >= cap).select("doc_id", "piece", "start", "length", "ids_crc32", (F.monotonically_increasing_id() + 2 * _RANGE).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return once.where("not emptiest").drop("emptiest").unionByName(again).unionByName(full)


def pack_documents(docs: DataFrame, *, cap: int = MAX_TOKENS, vocabulary: str = BYTE_BPE) -> DataFrame:
    """All documents in as few sequences of at most cap tokens as the search finds."""
    return pack_pieces(common.cut(pieces(docs, cap=cap, vocabulary=vocabulary), "pieces"), cap=cap)


def sequences(plan: DataFrame, docs: DataFrame, *, cap: int = MAX_TOKENS, vocabulary: str = BYTE_BPE) -> DataFrame:
    """The packed sequences themselves: sequence_id and its ids, at most cap of them."""
    ids = pieces(docs, cap=cap, vocabulary=vocabulary, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"])
    placed = plan.join(ids, ["doc_id", "piece", "ids_crc32"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return placed.select("sequence_id", F.flatten(F.transform("x", lambda p: p["ids"])).alias("ids"))
