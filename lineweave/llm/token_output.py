"""Token-id files in Simple-8b words.

A file set is a Parquet table, one row per segment (whole documents in ascending order, about SEGMENT_IDS ids). `words`
holds little-endian 64-bit words; the top four bits of a word select how many ids of how many bits fill the other 60.
Ids are coded in blocks of BLOCK_IDS; every block starts a new word and `block_words` has its first word, so blocks
decode side by side. An id of over 60 bits is an escape: selector 15, then the id as a word of its own; `escaped` lists
the blocks that have any. Zeros that pad the last word of a block are cut by the segment's count.

Edge cases: a null or empty text is the end id alone; documents with equal doc_id are ordered by the hash of their
texts, and equal rows are interchangeable; a very long text is a segment of its own, whatever its length; a null doc_id
sorts first; an empty table gives an empty file set and no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineweave.llm import common
from lineweave.llm.bytebpe import BYTE_BPE, encoder

END_ID = 0
BLOCK_IDS = 1024
SEGMENT_IDS = 1 << 18

#: Ids and bits of a word, by selector 0 to 13.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
_COUNT = np.array([n for n, _ in SELECTORS] + [0, 1], np.int64)
_POW2 = np.uint64(1) << np.arange(64, dtype=np.uint64)
_BITS16 = np.searchsorted(_POW2, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def encode_words(values: np.ndarray, block: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Words, the first word of each block and, at the end, their number, and the blocks with escapes."""
    n = len(values)
    blocks = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int32), []
    width = block + SELECTORS[0][0]
    v = np.zeros((blocks, width), np.uint64)
    flat = np.zeros(blocks * block, np.uint64)
    flat[:n] = values
    v[:, :block] = flat.reshape(blocks, block)
    bits = _BITS16[v] if int(v.max()) < 1 << 16 else np.searchsorted(_POW2, v, side="right").astype(np.uint8)
    choice = np.full((blocks, block), ESCAPE, np.uint8)
    most, by_count = bits[:, :block].copy(), {c: s for s, (c, _) in enumerate(SELECTORS)}
    for c in range(1, SELECTORS[0][0] + 1):  # most: bits of the largest of the next c ids
        if c > 1:
            np.maximum(most, bits[:, c - 1 : c - 1 + block], out=most)
        if c in by_count:
            fits = most <= SELECTORS[by_count[c]][1]
            if not fits.any():
                break
            choice[fits] = by_count[c]
    left = np.full(blocks, block, np.int64)
    left[-1] = n - (blocks - 1) * block
    heads = np.zeros((blocks, block), bool)
    at, row = np.zeros(blocks, np.int64), np.arange(blocks)
    while len(row):
        heads[row, at] = True
        at = at + _COUNT[choice[row, at]]
        on = at < left[row]
        at, row = at[on], row[on]
    of, pos = np.nonzero(heads)
    chosen = choice[of, pos]
    escapes = chosen == ESCAPE
    place = np.arange(len(of)) + np.cumsum(escapes) - escapes
    words = np.zeros(len(of) + int(escapes.sum()), np.uint64)
    v = v.ravel()
    start = of * width + pos
    for s, (c, b) in enumerate(SELECTORS):
        if len(k := np.flatnonzero(chosen == s)):
            word = np.full(len(k), s << 60, np.uint64)
            for j in range(c):
                word |= v[start[k] + j] << np.uint64(b * j)
            words[place[k]] = word
    words[place[escapes]] = np.uint64(ESCAPE << 60)
    words[place[escapes] + 1] = v[start[escapes]]
    first = np.searchsorted(of, np.arange(blocks))
    return words, np.append(place[first], len(words)).astype(np.int32), np.unique(of[escapes]).tolist()


def decode_words(words: np.ndarray, block_words: np.ndarray, escaped: list[int], n: int, block: int = BLOCK_IDS) -> np.ndarray:
    """The n values of encode_words()."""
    out = np.zeros(n, np.uint64)
    of = np.repeat(np.arange(len(block_words) - 1), np.diff(block_words))
    plain = np.ones(len(words), bool)
    for b in escaped:
        plain[block_words[b] : block_words[b + 1]] = False
        at, k = b * block, int(block_words[b])
        while k < block_words[b + 1]:
            s = int(words[k] >> np.uint64(60))
            if s == ESCAPE:
                got, k = [words[k + 1]], k + 2
            else:
                c, w = SELECTORS[s]
                got, k = [(words[k] >> np.uint64(w * j)) & np.uint64((1 << w) - 1) for j in range(c)], k + 1
            got = got[: min(n, (b + 1) * block) - at]
            out[at : at + len(got)] = got
            at += len(got)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    count = np.where(plain, _COUNT[chosen], 0)
    before = np.cumsum(count) - count
    local = before - before[np.minimum(block_words[:-1], max(0, len(words) - 1))][of] if len(words) else before
    limit = np.minimum(block, n - of * block)
    for s, (c, w) in enumerate(SELECTORS):
        if len(k := np.flatnonzero(plain & (chosen == s))):
            for j in range(c):
                m = k[local[k] + j < limit[k]]
                out[of[m] * block + local[m] + j] = (words[m] >> np.uint64(w * j)) & np.uint64((1 << w) - 1)
    return out


SEGMENT = (
    "part int, first_doc long, first_tie long, first_nth long, segment int, start_in_part long, n_ids long, doc_ids array<long>, lengths array<long>,"
    " words binary, block_words binary, escaped array<int>"
)
_SEGMENT_ARROW = pa.schema(
    [("part", pa.int32()), ("first_doc", pa.int64()), ("first_tie", pa.int64()), ("first_nth", pa.int64()), ("segment", pa.int32()), ("start_in_part", pa.int64()), ("n_ids", pa.int64())]
    + [("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("words", pa.binary()), ("block_words", pa.binary()), ("escaped", pa.list_(pa.int32()))]
)
#: Bytes of a table by written part up to which it is sent to all tasks.
BROADCAST_BYTES = 16 << 20


def encoded(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str = BYTE_BPE, end_id: int = END_ID) -> DataFrame:
    """doc_id, tie, nth and the ids of each whole text with end_id, as little-endian words of `width` bytes; in any order."""

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            data, offs = common.buffers(batch.column("text"))
            for a, b in common.chunks(offs):
                ids, ends = enc.encode_flat(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], end_id)
                width = 2 if int(ids.max(initial=0)) < 1 << 16 else 4
                raw = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((ends * width).astype(np.int32)), pa.py_buffer(ids.astype(f"<u{width}"))])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("tie")[a:b], pa.array(np.full(b - a, width, np.int32)), raw], names=["doc_id", "tie", "width", "ids"])

    rows = common.texts(docs, key, text).withColumn("tie", F.xxhash64("text")).mapInArrow(ran, "doc_id long, tie long, width int, ids binary")
    return rows.withColumn("nth", F.monotonically_increasing_id())


def write_token_files(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", vocabulary: str = BYTE_BPE, end_id: int = END_ID) -> None:
    """Encodes whole texts, appends end_id to each and writes them in ascending order of key as the files described above.

    Ids, not texts, are sorted; they are written first, so that finding the ranges of the sort doesn't encode twice.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, start, first = TaskContext.get().partitionId(), 0, 0, None
        held: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[np.ndarray] = []
        size = 0

        def segment() -> pa.RecordBatch:
            ids = np.concatenate(held)
            words, block_words, escaped = encode_words(ids)
            row = [part, *first, number, start, len(ids), names, np.concatenate(sizes), words.astype("<u8").tobytes(), block_words.astype("<i4").tobytes(), escaped]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SEGMENT_ARROW, strict=True)], schema=_SEGMENT_ARROW)

        for batch in batches:
            if not len(batch):
                continue
            first = first or tuple(batch.column(c)[0].as_py() for c in ("doc_id", "tie", "nth"))
            data, offs = common.buffers(batch.column("ids"))
            width = batch.column("width").to_numpy()
            keys = batch.column("doc_id").to_pylist()
            count = np.diff(offs) // width
            a = 0
            while a < len(batch):  # rows up to a change of width or to a full segment
                b = a + 1 + int(np.argmax(np.append(width[a + 1 :] != width[a], True)))
                b = min(b, a + 1 + int(np.searchsorted(np.cumsum(count[a:b]), SEGMENT_IDS - size)))
                held.append(np.frombuffer(data[offs[a] : offs[b]].tobytes(), f"<u{width[a]}").astype(np.uint32))
                names += keys[a:b]
                sizes.append(count[a:b])
                size += int(count[a:b].sum())
                if size >= SEGMENT_IDS:
                    yield segment()
                    number, start, held, names, sizes, size = number + 1, start + size, [], [], [], 0
                a = b
        if held:
            yield segment()

    rows = common.cut(encoded(docs, key=key, text=text, vocabulary=vocabulary, end_id=end_id), "token-ids")
    order = ("doc_id", "tie", "nth")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(coded, SEGMENT).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Segments with `start`, the number of all ids before them. Only one row per written part is summed up in one place."""
    files = spark.read.schema(SEGMENT).parquet(path)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"), F.min(F.struct("first_doc", "first_tie", "first_nth")).alias("first"))
    order = Window.orderBy("first", "part").rowsBetween(Window.unboundedPreceding, -1)
    begins = common.cut(parts.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("part_start")), "token-parts")
    if begins.count() * 12 <= BROADCAST_BYTES:  # a row of an int and a long per part
        begins = F.broadcast(begins)
    return files.join(begins, "part").withColumn("start", F.col("part_start") + F.col("start_in_part"))


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def document_digests(segments: DataFrame) -> DataFrame:
    """Each document's place and checksum, decoded from the files."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_words(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["block_words"], "<i4"), row["escaped"], row["n_ids"]).astype("<u4")
                sizes = np.array(row["lengths"], np.int64)
                ends = np.cumsum(sizes)
                crcs = [zlib.crc32(ids[e - s : e]) for s, e in zip(sizes, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - sizes), pa.array(sizes), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return segments.select("start", "n_ids", "doc_ids", "lengths", "words", "block_words", "escaped").mapInArrow(decoded, DIGEST)


def token_file_digests(docs: DataFrame, vocabulary: str = BYTE_BPE) -> DataFrame:
    """Writes the files to a new shared folder and returns what is read back from them."""
    spark = docs.sparkSession
    path = common.scratch(spark, "tokens")
    write_token_files(docs, path, vocabulary=vocabulary)
    return document_digests(read_token_files(spark, path))
