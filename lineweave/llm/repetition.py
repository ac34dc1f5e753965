"""Quality rules on repetition inside a text, from a suffix array of its words.

Suffixes of all texts of a chunk are sorted together by prefix doubling, a suffix's first key being its text and its word,
so that only suffixes of one text ever share a group; later rounds sort the groups that are left. The ranks of each round
give the longest common prefixes of neighbours. A suffix's deepest LCP interval, max(lcp before, lcp after), is the longest
repeated substring that starts there; the union of those of MIN_REPEAT words or more is what maximal repeats cover.

A text is rejected by the method if repeats cover over MAX_COVERED of the characters of its words, or if its longest
repeat has over LONGEST_WORDS words and over MAX_LONGEST of all words.

Edge cases: a null or empty text has no words and fails the base rule; other columns are ignored or kept as they are;
repeated rows each have their row; an empty table gives no rows. Work and memory follow a chunk of texts; a very long text
is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.llm import common

MIN_REPEAT = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_COVERED = 0.30
#: In the given tables no text that passes the base rule repeats over 14 words at a stretch; a repeat of over 30 words and 5 %
#: of a text fails neither the base rule nor MAX_COVERED if it stands only twice.
LONGEST_WORDS = 30
MAX_LONGEST = 0.05
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def suffix_ranks(first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array and, for each round r, the ranks by the first 2**r words, with -1 after the last. first: keys that differ between texts."""
    n = len(first)
    sa = np.argsort(first, kind="stable")
    rank = np.full(n + 1, -1, np.int32)
    new = np.ones(n, bool)
    new[1:] = first[sa[1:]] != first[sa[:-1]]
    slot = np.flatnonzero(new)
    rank[sa] = np.repeat(slot, np.diff(np.append(slot, n)))
    levels, k = [rank], 1
    single = np.append(new[1:], True) & new
    slots = np.flatnonzero(~single)
    while len(slots):
        own = sa[slots]
        high, low = rank[own].astype(np.int64), rank[np.minimum(own + k, n)].astype(np.int64) + 1
        key = high * (n + 2) + low
        order = np.argsort(key, kind="stable")
        key, own = key[order], own[order]
        sa[slots] = own
        new = np.ones(len(own), bool)
        new[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(new)
        rank = rank.copy()
        rank[own] = np.repeat(slots[begin], np.diff(np.append(begin, len(own))))
        levels.append(rank)
        slots = slots[~(np.append(new[1:], True) & new)]
        k *= 2
    return sa, levels


def neighbour_lcps(sa: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that sa[i] and sa[i + 1] have in common."""
    lcp = np.zeros(max(0, len(sa) - 1), np.int64)
    pairs = np.flatnonzero(levels[0][sa[:-1]] == levels[0][sa[1:]])
    a, b, n = sa[pairs].copy(), sa[pairs + 1].copy(), len(sa)
    for r in range(len(levels) - 1, -1, -1):
        same = (levels[r][a] == levels[r][b]) & (a < n) & (b < n)
        a[same] += 1 << r
        b[same] += 1 << r
    lcp[pairs] = a - sa[pairs]
    return lcp


def longest_repeats(keys: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest substring from it on that its text has elsewhere too."""
    if not len(keys):
        return np.zeros(0, np.int64)
    sa, levels = suffix_ranks(keys)
    lcp = neighbour_lcps(sa, levels)
    out = np.zeros(len(keys), np.int64)
    out[sa[:-1]] = lcp
    out[sa[1:]] = np.maximum(out[sa[1:]], lcp)
    return out


def maximal_repeats(words: list[str], least: int = MIN_REPEAT) -> list[tuple[int, list[int]]]:
    """Length and starts of every maximal repeated substring of one text: the LCP intervals that can't be widened to the left."""
    if not words:
        return []
    keys = np.unique(np.array(words), return_inverse=True)[1]
    sa, levels = suffix_ranks(keys)
    lcp = [*neighbour_lcps(sa, levels).tolist(), 0]
    out, stack = [], [(0, 0)]
    for i, x in enumerate(lcp):
        left = i
        while stack[-1][0] > x:
            depth, left = stack.pop()
            starts = sa[left : i + 1]
            before = {words[s - 1] if s else None for s in starts.tolist()}
            if depth >= least and (len(before) > 1 or None in before):
                out.append((depth, sorted(starts.tolist())))
        if stack[-1][0] < x:
            stack.append((x, left))
    return out


def covered(spans: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of at least so many words. spans: longest_repeats()."""
    marks = np.zeros(len(spans) + 1, np.int64)
    at = np.flatnonzero(spans >= least)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + spans[at], -1)
    return np.cumsum(marks[:-1]) > 0


def by_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offs[1:]] - total[offs[:-1]]


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars", "longest_repeat")


def measure(data: np.ndarray, offs: np.ndarray, least: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """MEASURES of each row of a chunk."""
    rows = len(offs) - 1
    starts, ends, row = common.words(data, offs, common.NON_SPACE)
    keys = common.mixed(common.run_hashes(data, starts, ends) ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    spans = longest_repeats(keys)
    inside = covered(spans, least)
    char = (data & 0xC0) != 0x80
    word = common.NON_SPACE[data]
    chars_before = np.concatenate([[0], np.cumsum(char)])
    in_word = chars_before[ends] - chars_before[starts]
    line = np.ones(256, bool)
    line[0x0A] = False
    first, last, of = common.words(data, offs, line)
    words_before = np.concatenate([[0], np.cumsum(word)])
    real = words_before[last] > words_before[first]
    first, last, of = first[real], last[real], of[real]
    lines = np.unique(common.mixed(common.run_hashes(data, first, last) ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)[1]
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, row, np.where(spans >= least, spans, 0))
    return {
        "n_words": np.bincount(row, minlength=rows),
        "word_chars": by_row(char & word, offs),
        "n_symbols": by_row(_SYMBOL[data], offs),
        "n_dup_lines": np.bincount(of, minlength=rows) - np.bincount(of[lines], minlength=rows),
        "n_repeat_words": np.bincount(row[inside], minlength=rows),
        "covered_chars": np.bincount(row[inside], weights=in_word[inside], minlength=rows).astype(np.int64),
        "longest_repeat": longest,
    }


def measured(df: DataFrame, *, text: str = "_text", least: int = MIN_REPEAT) -> DataFrame:
    """A table with a `text` column and no column named as in MEASURES; the text column is replaced by MEASURES."""
    rest = [c for c in df.columns if c != text]

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = common.buffers(batch.column(text))
            for a, b in common.chunks(offs):
                m = measure(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], least)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b] for c in rest), *(pa.array(m[k].astype(np.int64)) for k in MEASURES)], names=[*rest, *MEASURES])

    common.small_batches(df.sparkSession)
    schema = df.select(*rest, *[F.lit(0).cast("long").alias(k) for k in MEASURES]).schema
    return df.mapInArrow(ran, schema)


def verdicts(m: DataFrame) -> DataFrame:
    """base_failed and kept of measured rows."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    too_much = F.col("covered_chars") > MAX_COVERED * F.col("word_chars")
    too_long = (F.col("longest_repeat") > LONGEST_WORDS) & (F.col("longest_repeat") > MAX_LONGEST * F.col("n_words"))
    return m.withColumn("base_failed", base).withColumn("kept", ~base & ~too_much & ~too_long)


def digests(docs: DataFrame) -> DataFrame:
    found = verdicts(measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))))
    return found.select("doc_id", *MEASURES[:5], "base_failed", "kept", "covered_chars", "longest_repeat")


def rejected_removed(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that the rules keep."""
    carried = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").cast("string").alias("_text"))
    return verdicts(measured(carried)).where("kept").select("_row.*")
