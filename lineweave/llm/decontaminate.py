"""Benchmark decontamination by a broadcast hash set of test n-grams.

1. Words are runs of a-z (A-Z lowered), 0-9 and characters over U+007F. Every run of WINDOW words of an item is a window; a
   shorter item with words is one window. Windows are written as a table with their words.
2. What is broadcast is the set of the windows' 64-bit hashes, 8 bytes each, if that is no more than SET_BYTES; beyond, a
   bit map of MAP_BITS bits with two bits per window, which lets some more windows through. Its size never depends on more.
3. One scan of the texts by rolling hashes gives a row per document, with the windows in the set and their words, if any.
4. Only those few are joined with the table of windows, by hash and words, so every hit is compared word for word.
5. Documents are marked, or removed, or the union of their hit windows is cut from them.

Edge cases: a null or empty text has no words and isn't contaminated; an item that has no words or no id is ignored;
repeated items count once, repeated documents each have their row; a very long text is scanned whole like any other; empty
tables give no hits or no rows; other columns of the documents are kept by contaminated_removed() and spans_removed() and
ignored by scan().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm import common

WINDOW = 13
SET_BYTES = 64 << 20
MAP_BITS = 30
#: Bytes of a table up to which it is sent to all tasks.
BROADCAST_BYTES = 16 << 20
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20

WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[0x30:0x3A] = WORD_BYTES[0x61:0x7B] = WORD_BYTES[0x80:] = True


class HashSet:
    """The hashes of windows of k words: sorted, with a table of their top bits to look at first."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes)
        self.bits = min(26, max(16, int(len(self.hashes)).bit_length() + 6))
        self.seen: np.ndarray | None = None

    def has(self, h: np.ndarray) -> np.ndarray:
        top = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        if self.seen is None:
            self.seen = np.zeros(1 << self.bits, bool)
            self.seen[(self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        out = self.seen[top]
        at = np.flatnonzero(out)
        if len(at):
            near = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            out[at] = self.hashes[near] == h[at]
        return out


class BitMap:
    """Two bits for each hash, of a fixed number: it has all hashes that were put in, and some others."""

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.map = np.zeros(1 << max(0, bits - 3), np.uint8)

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64), (common.mixed(h) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, h: np.ndarray) -> None:
        for x in self._places(h):
            np.bitwise_or.at(self.map, x >> 3, (1 << (x & 7)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        x, y = self._places(h)
        return ((self.map[x >> 3] >> (x & 7).astype(np.uint8)) & (self.map[y >> 3] >> (y & 7).astype(np.uint8)) & 1).astype(bool)


def _said(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes of texts, and of their words starts, ends, rows and hashes."""
    data = common.lowered(data)
    starts, ends, row = common.words(data, offs, WORD_BYTES)
    return data, starts, ends, row, common.run_hashes(data, starts, ends)


WINDOWS = "k int, h long, words string, item long"


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The distinct windows of the items: number of words, hash, words with one space between, and the item's id."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = common.buffers(batch.column("text"))
            for a, b in common.chunks(offs):
                raw, starts, ends, row, word = _said(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                n = np.bincount(row, minlength=b - a)
                for k in sorted({min(window, x) for x in n.tolist() if x}):
                    h = common.window_hashes(word, k)
                    at = np.flatnonzero((row[: len(h)] == row[k - 1 :]) & ((n == k) | (k == window))[row[: len(h)]])
                    said = [b" ".join(raw[starts[j] : ends[j]].tobytes() for j in range(i, i + k)).decode() for i in at.tolist()]
                    item = batch.column("doc_id")[a:b].take(pa.array(row[at]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(h[at].view(np.int64)), pa.array(said, pa.string()), item], names=["k", "h", "words", "item"])

    return common.texts(benchmark, "item_id").where("doc_id is not null").mapInArrow(made, WINDOWS).distinct()


def _hash_sets(windows: DataFrame, set_bytes: int, map_bits: int) -> dict[int, HashSet | BitMap]:
    """What is broadcast, by words of a window."""
    distinct = windows.select("k", "h").distinct()
    n = distinct.count()
    parts = max(1, -(-8 * n // set_bytes))
    small = parts == 1
    out: dict[int, HashSet | BitMap] = {}
    for p in range(parts):  # set_bytes of hashes come to the driver at a time
        own = distinct.where(F.pmod(F.xxhash64("h"), F.lit(parts)) == p).toArrow()
        k, h = own.column("k").to_numpy(), own.column("h").to_numpy().view(np.uint64)
        for words in np.unique(k).tolist():
            mine = h[k == words]
            if small:
                out[words] = HashSet(mine)
            else:
                out.setdefault(words, BitMap(map_bits)).add(mine)
    return out


SCANNED = "doc_id long, n_words long, hits array<struct<k:int,at:long,h:long,words:string>>"
_HITS = pa.list_(pa.struct([("k", pa.int32()), ("at", pa.int64()), ("h", pa.int64()), ("words", pa.string())]))


def scan(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", set_bytes: int = SET_BYTES, map_bits: int = MAP_BITS, window: int = WINDOW) -> DataFrame:
    """A row per document: doc_id, two hashes of its text, n_words, runs of hit words (first and last), and the items found."""
    spark = docs.sparkSession
    windows = common.cut(windows_of(benchmark, window), "benchmark-windows")
    sets = spark.sparkContext.broadcast(_hash_sets(windows, set_bytes, map_bits))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = common.buffers(batch.column("text"))
            for a, b in common.chunks(offs):
                raw, starts, ends, row, word = _said(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                n = np.bincount(row, minlength=b - a)
                before = np.cumsum(n) - n
                hits: list[list[dict]] = [[] for _ in range(b - a)]
                for k, known in sets.value.items():
                    h = common.window_hashes(word, k)
                    if len(h):
                        for i in np.flatnonzero((row[: len(h)] == row[k - 1 :]) & known.has(h)).tolist():
                            said = b" ".join(raw[starts[j] : ends[j]].tobytes() for j in range(i, i + k)).decode()
                            hits[row[i]].append({"k": k, "at": i - int(before[row[i]]), "h": int(h[i : i + 1].view(np.int64)[0]), "words": said})
                cols = [batch.column("doc_id")[a:b], pa.array(n.astype(np.int64)), pa.array(hits, _HITS), batch.column("x")[a:b], batch.column("y")[a:b]]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "hits", "x", "y"])

    rows = common.texts(docs, key, text).withColumns({"x": F.xxhash64("text"), "y": F.xxhash64(F.lit(1), "text")})
    found = common.cut(rows.mapInArrow(scanned, SCANNED + ", x long, y long").withColumn("nth", F.monotonically_increasing_id()), "decontaminate")
    some = found.where(F.size("hits") > 0)
    each = some.select("nth", F.inline("hits"))
    small = (windows.agg(F.sum(F.length("words") + 20)).first()[0] or 0) <= BROADCAST_BYTES
    sent = F.broadcast if small else lambda df: df
    of = ["k", "h", "words"]
    real = common.cut(each.join(sent(windows.select(*of).distinct()), of), "window-hits")
    spans = _runs(real.select("nth", F.col("at").alias("first"), (F.col("at") + F.col("k") - 1).alias("last")))
    # a document and an item meet once, however many windows they share and however many items have a window
    named = real.select("nth", *of).distinct().join(sent(windows), of).select("nth", "item").distinct().groupBy("nth").agg(F.array_sort(F.collect_list("item")).alias("items"))
    none = F.lit(None).cast("array<struct<first:long,last:long>>"), F.lit(None).cast("array<long>")
    both = some.join(spans, "nth", "left").join(named, "nth", "left").select("doc_id", "x", "y", "n_words", "runs", "items")
    both = both.unionByName(found.where(F.size("hits") == 0).select("doc_id", "x", "y", "n_words", none[0].alias("runs"), none[1].alias("items")))
    return both.select("doc_id", "x", "y", "n_words", F.coalesce("runs", F.array().cast("array<struct<first:long,last:long>>")).alias("runs"), F.coalesce("items", F.array().cast("array<long>")).alias("items"))


def _runs(spans: DataFrame) -> DataFrame:
    """nth and its spans, those that meet or overlap made one, in order."""
    w = Window.partitionBy("nth").orderBy("first", "last")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("first") > before + 1, F.lit(True)).cast("int")
    runs = spans.withColumn("begins", begins).withColumn("run", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    one = runs.groupBy("nth", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return one.groupBy("nth").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def n_hit(runs: str = "runs") -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)


def is_contaminated(hit: Column, n_words: Column, one_in: int = ONE_IN) -> Column:
    return (hit > 0) & (one_in * hit >= n_words)


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = scan(docs, benchmark).withColumn("n_hit", n_hit())
    names = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated")
    )


def _with_texts(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """The documents joined with rows on texts, told by two hashes; these are sent along if they are small."""
    x, y = ("_x" + "_" * len(max(docs.columns, key=len)), "_y" + "_" * len(max(docs.columns, key=len)))
    told = common.cut(found.withColumnsRenamed({"x": x, "y": y}), "texts-found")
    if (told.agg(F.count(F.lit(1)) * 64 + (F.coalesce(F.sum(16 * F.size("runs")), F.lit(0)) if "runs" in told.columns else 0)).first()[0] or 0) <= BROADCAST_BYTES:
        told = F.broadcast(told)
    text = F.col("text").cast("string")
    return docs.withColumns({x: F.xxhash64(text), y: F.xxhash64(F.lit(1), text)}).join(told, [x, y], how)


def contaminated_removed(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that aren't contaminated."""
    found = scan(docs, benchmark)
    gone = found.where(is_contaminated(n_hit(), F.col("n_words"))).select("x", "y").distinct()
    return _with_texts(docs, gone, "left_anti").select(*docs.columns)


def spans_removed(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, each hit run of words cut from its text."""

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                if runs:
                    raw = text.encode()
                    data = common.lowered(np.frombuffer(raw, np.uint8))
                    starts, ends, _ = common.words(data, np.array([0, len(data)]), WORD_BYTES)
                    for r in reversed(runs):
                        raw = raw[: starts[r["first"]]] + raw[ends[r["last"]] :]
                    text = raw.decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, pa.string())], schema=pa.schema([batch.schema.field("_row"), ("_cut", pa.string())]))

    hit = scan(docs, benchmark).where(F.size("runs") > 0).select("x", "y", "runs").dropDuplicates(["x", "y"])
    common.small_batches(docs.sparkSession)
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").cast("string").alias("text"))
    rows = _with_texts(own, hit, "left").select("_row", "text", "runs")
    done = rows.mapInArrow(cut, rows.select("_row", F.col("text").alias("_cut")).schema)
    return done.select(*[F.col("_cut").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
