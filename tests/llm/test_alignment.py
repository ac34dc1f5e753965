"""Alignment against a plain walk over both libraries' tokens."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lineweave.llm import alignment, bytebpe, common, queries

BOTH = alignment.aligner()
BYTE = {chr(c): b for b, c in bytebpe._BYTES.items()}
ODD = [None, "", " ", "   ", "\n\n\t x", "a▁b", "<s>hi</s><|endoftext|>", "日本語 text 😀 é", "\x00 \x00a", "  lead", "trail  ", "x" * 3000, "ﬁ ﬀ ①", "a　b", "﻿q", "same", "same"]


def sides(text):
    """Ids and end offsets of both sides, by the libraries on the whole text."""
    if not text:
        return [], []
    a, b = BOTH.a.tokenizer.encode(" " + text, add_special_tokens=False).ids, BOTH.b.model.encode(text)
    of_a, of_b = [bytes(BYTE[c] for c in BOTH.a.tokenizer.id_to_token(i)) for i in a], [BOTH.b.piece[i] for i in b]
    if b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
        return [], []
    return [[*zip(ids, np.cumsum([len(x) for x in of]).tolist(), strict=True)] for ids, of in ((a, of_a), (b, of_b))]


def plainly(texts):
    """The contract's row of each text, without doc_id."""
    tokens = [sides(t) for t in texts]
    links = []
    for a, b in tokens:
        at = {f: j for j, f in b}  # a side's ends differ
        links.append([(i, at[e]) for i, e in a if e in at])
    count = Counter(x for own in links for x in own)
    best: dict[int, int] = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for (a, b), own in zip(tokens, links, strict=True):
        written, i, j = [], 0, 0
        for c in sorted({e for _, e in a} & {e for _, e in b}):
            parts: list[list[str]] = [[], []]
            while i < len(a) and a[i][1] <= c:
                parts[0].append(str(a[i][0]))
                i += 1
            while j < len(b) and b[j][1] <= c:
                parts[1].append(str(b[j][0]))
                j += 1
            written.append("|".join(map(",".join, parts)))
        digest = hashlib.sha256(";".join(written).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(written), len(own), sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own), digest))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.lists(st.sampled_from(["the", " ", "  ", "ing", "é", "\n", "▁", "日", "<s>", "<|endoftext|>", "x", "'s", "12"]), max_size=12).map("".join)), min_size=1, max_size=4))
def test_batch_equals_plain_walk(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got = BOTH.align(*common.buffers(pa.array(texts, pa.large_string())))
    want = plainly(texts)
    assert [*zip(*(got[c].tolist() for c in ("n_a", "n_b", "n_groups")), got["groups_sha256"], strict=True)] == [(*w[:3], w[6]) for w in want]
    assert got["ns"].sum() == sum(w[3] for w in want)


def test_edge_cases_and_both_ways(spark):
    docs = spark.createDataFrame([*((k, t, 1) for k, t in enumerate(ODD)), (None, "no id", 1), (None, "no id", 1)], "doc_id long, text string, codes int").repartition(3)
    want = sorted(((k, *w) for k, w in zip([*range(len(ODD)), None, None], plainly([*ODD, "no id", "no id"]), strict=True)), key=repr)
    assert rows(alignment.digests(docs)) == want
    assert rows(alignment.digests(docs, most_pairs=0)) == want  # by a join
    assert alignment.digests(docs.limit(0)).count() == 0


def test_pair_counts(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["the cat", "the cat", "a cat"])], "doc_id long, text string")
    count = Counter((i, j) for t in ("the cat", "the cat", "a cat") for i, e in sides(t)[0] for j, f in sides(t)[1] if e == f)
    got = {(r.a, r.b): r.n for r in alignment.pair_counts(alignment.aligned(docs)).collect()}
    assert got == dict(count)


def test_a_very_long_text(spark):
    long = "word and more " * 20_000
    docs = spark.createDataFrame([(1, long), (2, "word")], "doc_id long, text string")
    got = {r.doc_id: r for r in alignment.digests(docs).collect()}
    a, b = sides(long)
    assert (got[1].n_a, got[1].n_b, got[1].n_links) == (len(a), len(b), len({e for _, e in a} & {f for _, f in b}))
    assert got[2].n_a == 1


def test_query_equals_plain_walk(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(((d.doc_id, *w) for d, w in zip(docs, plainly([d.text for d in docs]), strict=True)), key=repr)
    assert rows(queries.op12_cross_tokenizer_alignment(spark, sf)) == want
