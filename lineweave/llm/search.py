"""Ranked lexical search in reverse: the items' terms are the index, and the documents are streamed through it.

1. Items are dealt into blocks of about BLOCK_BYTES of text. A block's distinct terms, numbered, are sent to all tasks: the
   block bounds their size, whatever the number of items, and each further block is a further pass.
2. One scan of the texts counts each document's terms and, of the block's terms, their occurrences; these counts are written.
   From them come the number of documents with a term, the length of all, and of each term the documents that hold it.
3. The counts of documents are streamed through the block's inverted index (of a term: items and occurrences in them), batch
   by batch; each task keeps a heap of `k` documents for each item. Heaps are merged in two steps, so no task gets all.

All is in 64-bit integers but the terms' weights, which come from doubles.

Edge cases: a null or empty text has no terms: such a document is found by no item and doesn't count, such an item has no
rows; repeated rows of documents each count and are ranked one after the other; equal scores go by ascending doc_id, rows
without doc_id last; an item without id is an item like others; of items with equal id and text one counts, items of one id
with different texts are each an item; a term of the items that no document has scores nothing; an empty table of either kind
gives no rows; a very long text is counted whole; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lineweave.llm import common

TOP = 10
#: Bytes of items' texts in a block, about.
BLOCK_BYTES = 4 << 20
#: Cells of a batch's scores (documents x items) in a task.
CELLS = 1 << 20
#: Parts of an item's heaps that are merged apart.
PARTS = 64
#: Fixed values of the score.
SCALE, K1, FLAT, SLOPE, UNIT = 1_000_000_000, 8, 25, 75, 1000

TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[0x30:0x3A] = TERM_BYTES[0x41:0x5B] = TERM_BYTES[0x61:0x7B] = TERM_BYTES[0x80:] = True


def terms_of(data: np.ndarray, offs: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct terms of texts laid end to end, the number of each term in turn, and its text."""
    starts, ends, row = common.words(data, offs, TERM_BYTES)
    said = common.lowered(data[TERM_BYTES[data]])
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(said)]).dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), row


class Items:
    """A block of items: their ids, and the inverted index of their terms."""

    def __init__(self, ids: list[int | None], texts: list[str | None]) -> None:
        self.ids = ids
        names, number, row = terms_of(*common.buffers(pa.array(texts, pa.large_string())))
        self.number = {x: k for k, x in enumerate(names)}
        both, n = np.unique(number.astype(np.int64) * max(1, len(ids)) + row, return_counts=True)
        self.item, self.times = both % max(1, len(ids)), n
        self.at = np.searchsorted(both // max(1, len(ids)), np.arange(len(names) + 1))


COUNTED = "doc_id long, n long, terms array<int>, tf array<long>"


def counted(docs: DataFrame, items: Items, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: its terms with repeats, and of the items' terms those that it has, with their occurrences."""
    sent = docs.sparkSession.sparkContext.broadcast(items.number)

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        size = max(1, len(known))
        for batch in batches:
            data, offs = common.buffers(batch.column("text"))
            for a, b in common.chunks(offs):
                names, number, row = terms_of(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                of = np.fromiter((known.get(x, -1) for x in names), np.int64, len(names))[number]
                mine = of >= 0
                cell, tf = np.unique(row[mine] * size + of[mine], return_counts=True)
                doc = cell // size
                bounds = pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32))
                cols = [batch.column("doc_id")[a:b], pa.array(np.bincount(row, minlength=b - a).astype(np.int64))]
                cols += [pa.ListArray.from_arrays(bounds, pa.array((cell - doc * size).astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(tf.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "terms", "tf"])

    return common.texts(docs, key, text).mapInArrow(ran, COUNTED)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))), in doubles."""
    return np.array([math.floor(UNIT * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


class Heaps:
    """The `k` best documents of each item so far: highest score, then lowest doc_id."""

    LAST = np.iinfo(np.int64).max

    def __init__(self, n_items: int, k: int) -> None:
        self.k = k
        self.score = [np.zeros(0, np.int64)] * n_items
        self.doc = [np.zeros(0, np.int64)] * n_items
        self.none = [np.zeros(0, bool)] * n_items
        self.floor = np.zeros(n_items, np.int64)  # what a document must reach to come in

    def add(self, scores: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        """scores: a row per document, a column per item. none: of the documents without id."""
        for i in np.flatnonzero((scores >= np.maximum(self.floor, 1)).any(axis=0)).tolist():
            own = scores[:, i]
            least = max(1, int(self.floor[i]))
            if len(own) > self.k:
                least = max(least, int(np.partition(own, len(own) - self.k)[len(own) - self.k]))
            at = np.flatnonzero(own >= least)
            if not len(at):
                continue
            s, d, z = np.concatenate([self.score[i], own[at]]), np.concatenate([self.doc[i], doc[at]]), np.concatenate([self.none[i], none[at]])
            order = np.lexsort((d, z, -s))[: self.k]
            self.score[i], self.doc[i], self.none[i] = s[order], d[order], z[order]
            if len(order) == self.k:
                self.floor[i] = s[order[-1]]


HEAPS = "item int, doc_id long, score long"


def _searched(found: DataFrame, items: Items, weight: np.ndarray, n_docs: int, length: int, k: int) -> DataFrame:
    """The heaps of each task: item, doc_id and score of `k` documents at most."""
    sent = found.sparkSession.sparkContext.broadcast((items.item, items.times, items.at, weight, len(items.ids)))

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, times, at, weight, n_items = sent.value
        heaps, step = Heaps(n_items, k), max(1, CELLS // max(1, n_items))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                n = part.column("n").to_numpy()
                m = 100 - SLOPE + (SLOPE * n * n_docs) // length
                lists = part.column("terms")
                bounds = lists.offsets.to_numpy().astype(np.int64)
                term, tf = lists.flatten().to_numpy(), part.column("tf").flatten().to_numpy()
                doc = np.repeat(np.arange(len(n)), np.diff(bounds))
                gain = weight[term] * ((SCALE * tf) // (UNIT * tf + K1 * m[doc]))
                order = np.argsort(term, kind="stable")
                term, doc, gain = term[order], doc[order], gain[order]
                cut = np.flatnonzero(np.diff(term, prepend=-1))
                scores = np.zeros((len(n), n_items), np.int64)
                for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(term)], strict=True):
                    of = slice(at[term[lo]], at[term[lo] + 1])  # a term has each document once, and each item once
                    scores[np.ix_(doc[lo:hi], item[of])] += gain[lo:hi, None] * times[of]
                ids = part.column("doc_id")
                heaps.add(scores, ids.fill_null(Heaps.LAST).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        sizes = [len(s) for s in heaps.score]
        if sum(sizes):
            doc = pa.array(np.concatenate(heaps.doc), pa.int64(), mask=np.concatenate(heaps.none))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n_items), sizes).astype(np.int32)), doc, pa.array(np.concatenate(heaps.score))], names=["item", "doc_id", "score"])

    common.small_batches(found.sparkSession)
    return found.where("n > 0 and size(terms) > 0").select("doc_id", "n", "terms", "tf").mapInArrow(ran, HEAPS)


def _merged(heaps: DataFrame, k: int) -> DataFrame:
    """rank, doc_id and score of each item's `k` best, from the heaps of parts first."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("rank")
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part")
    first = heaps.select("*", part).select("*", rank("item", "part")).where(F.col("rank") <= k).drop("rank", "part")
    return first.select("*", rank("item")).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, *, k: int = TOP, key: str = "doc_id", item_key: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the `k` documents that score highest for each item."""
    spark = docs.sparkSession
    told = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0).distinct()
    told = common.cut(told, "search-items")
    blocks = max(1, math.ceil((told.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    done: DataFrame | None = None
    for block in range(blocks):
        own = told.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        index = Items(own.column("item_id").to_pylist(), own.column("text").to_pylist())
        found = common.cut(counted(docs, index, key=key, text=text), "term-counts")
        n_docs, length = found.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(index.number), np.int64)
        for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[r["term"]] = r["count"]
        heaps = common.cut(_searched(found, index, weights(df, n_docs), n_docs, max(1, length), k), "search-heaps")
        names = spark.createDataFrame(list(enumerate(index.ids)), "item int, item_id long")
        best = _merged(heaps, k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        done = best if done is None else done.unionByName(best)
    return done


#: The same in SQL.
ORACLE_SQL = """
with low as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as l from documents),
    items as (select item_id, row_number() over () as i, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as l from (select distinct item_id, text from benchmark) x),
    total as (select count(*) as n_docs, cast(sum(len(l)) as bigint) as length from low where len(l) > 0),
    doc as (select r, doc_id, 25 + (75 * len(l) * n_docs) // length as m from low, total where len(l) > 0),
    tf as (select r, t, count(*) as tf from (select r, unnest(l) as t from low) x group by r, t),
    qtf as (select i, t, count(*) as q from (select i, unnest(l) as t from items) x group by i, t),
    w as (select t, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) as w from (select t, count(*) as df from tf group by t) x, total),
    s as (select qtf.i, tf.r, cast(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score from qtf join w using (t) join tf using (t) join doc using (r) group by qtf.i, tf.r),
    ranked as (select i, doc_id, score, row_number() over (partition by i order by score desc, doc_id nulls last) as rank from s join doc using (r) where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked join items using (i) where rank <= 10
"""
