"""Reversed search against a plain ranking of every document for every item."""

import math
import re
from collections import Counter

import pytest

from lineweave.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def plainly(docs, items, k=10):
    docs = [(d, Counter(terms(t))) for d, t in docs]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n, length = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        scored = []
        for d, c, own in docs:
            m = 100 - 75 + (75 * own * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


DOCS = [(k, t) for k, t in enumerate(["the cat sat", "The CAT sat on the mat", "a dog", "dog dog dog", "Größe größe 日本 é", None, "", "!!! ...", "x1 y2", "the cat sat", "rare", "long " * 30_000 + "cat"])]
DOCS += [(50, "tie tie"), (49, "tie tie"), (None, "tie tie"), (None, "tie tie"), (50, "tie tie"), (7, "@[`{ the")]
ITEMS = [(1, "the cat"), (2, "DOG dog the"), (3, "größe GRÖSSE 日本"), (4, None), (5, ""), (6, "nowhere"), (7, "tie"), (7, "tie"), (7, "rare rare"), (None, "cat"), (8, "--"), (9, "the")]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame([(*d, 5) for d in DOCS], "doc_id long, text string, score int").repartition(4), spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("k", [1, 3, 10])
def test_equals_plain_ranking(tables, k):
    got = search.ranked(*tables, k=k)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=repr) == plainly(DOCS, ITEMS, k)


def test_blocks_of_items_and_small_batches(tables, monkeypatch):
    monkeypatch.setattr(search, "CELLS", 3)
    monkeypatch.setattr(search, "PARTS", 2)
    assert sorted(map(tuple, search.ranked(*tables, block_bytes=8).collect()), key=repr) == plainly(DOCS, ITEMS)


def test_copies_of_one_text(spark):
    docs = [(k, "one text of many copies") for k in range(3000)] + [(-1, "one text")]
    got = search.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame([(1, "one copies"), (2, "text")], "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == plainly(docs, [(1, "one copies"), (2, "text")])


def test_empty_tables(tables):
    docs, items = tables
    assert search.ranked(docs.limit(0), items).count() == 0
    assert search.ranked(docs, items.limit(0)).count() == 0
    assert search.ranked(docs.where("text is null"), items).count() == 0
