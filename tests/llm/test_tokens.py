import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lineweave.llm import bytebpe, packing, token_output

EDGE = [(1, None, "x"), (2, "", "x"), (3, "a b  c\n\n d'll 12 ½ ² <|endoftext|> ok", "y"), (9, "日本語 \u0085 x  y\x1cz", None), (7, "same", "z"), (8, "same", "z"), (5, "long word " * 4000, None)]


def truth():
    return Tokenizer.from_file(bytebpe.tokenizer_path(bytebpe.BYTE_BPE))


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string, tie string")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(alphabet="ab'sL \n\t1é²ª,.!…–  \x1c", max_size=60)), max_size=6))
def test_memo_equals_library(batch):
    t = truth()
    batch = [x.encode("utf-8", "ignore").decode() for x in batch]
    got = bytebpe.encoder().encode(batch)
    assert [x.tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in batch]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 60), st.integers(0, 1 << 16), st.integers(0, (1 << 64) - 1)), max_size=200), st.sampled_from([1, 7, 64, 1024]))
def test_simple8b_round_trip(values, block):
    v = np.array(values, np.uint64)
    words, block_words, escaped = token_output.encode_words(v, block)
    assert token_output.decode_words(words, block_words, escaped, len(v), block).tolist() == values
    assert token_output.encode_words(np.zeros(600, np.uint64))[0].size == 10


def test_token_files(spark, docs):
    t, start, want = truth(), 0, []
    for doc, text, _ in sorted(EDGE, key=lambda r: r[0]):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_output.token_file_digests(docs).collect())) == want
    assert token_output.token_file_digests(docs.limit(0)).count() == 0


def test_packing(spark, docs):
    rows = packing.pack_documents(docs).collect()
    t = truth()
    for doc, text, _ in EDGE:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == packing.cut_pieces(len(ids))
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in seqs.values():
        at = 0
        for o, n in sorted(members):
            assert o == at
            at += n
        assert at <= packing.MAX_TOKENS
    assert packing.pack_documents(docs.limit(0)).count() == 0
    made = packing.sequences(packing.pack_documents(docs), docs).collect()
    assert sum(len(r.ids) for r in made) == sum(r.length for r in rows)


def best_known(sizes, cap):
    """The fewest bins, by trying every placement."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for r in {r for r in rooms if r >= sizes[i]}:
            k = rooms.index(r)
            place(i + 1, [*rooms[:k], r - sizes[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, cap - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120), st.integers(64, 90))
def test_never_more_bins_than_descending_best_fit(sizes, cap):
    x = np.array(sizes, np.int64)
    bins, offset = packing.pack(x, cap)
    assert len(set(bins.tolist())) <= len(packing.best_fit(np.sort(x)[::-1], cap))
    for b in set(bins.tolist()):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offset[own])]
        assert (offset[own] == np.cumsum(x[own]) - x[own]).all() and x[own].sum() <= cap


def searched(x, cap):
    first = packing.best_fit(x, cap)
    then = packing.local_search(x, first, cap)
    assert sorted(i for b in then for i in b) == list(range(len(x)))
    assert all(x[b].sum() <= cap for b in then) and len(then) <= len(first)
    assert sum(int(x[b].sum()) ** 2 for b in then) >= sum(int(x[b].sum()) ** 2 for b in first)
    return len(first), len(then)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=60))
def test_local_search_never_worse(sizes):
    searched(np.array(sizes), 100)


def test_local_search_gains_and_nears_the_optimum():
    rng = np.random.default_rng(3)
    over = 0
    for _ in range(40):
        x = rng.integers(20, 70, 9)
        over += searched(x, 100)[1] - best_known(x.tolist(), 100)
    assert over <= 3
    for low, high in ((300, 800), (600, 1400)):
        x = rng.integers(low, high, 2000)
        x = x[packing.by_size_class(x)]
        first, then = searched(x, 2048)
        descending = len(packing.best_fit(-np.sort(-x), 2048))
        assert then < first and then <= descending


def test_packing_in_groups(spark):
    rng = np.random.default_rng(9)
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(rng.integers(1, 900, 3000))] + [(7, 1, 0, 2048, 1), (7, 1, 0, 2048, 1), (None, 0, 0, 5, 1)]
    found = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack_pieces(found, group=256).collect()
    assert sorted((r.doc_id or -1, r.length) for r in out) == sorted((r[0] or -1, r[3]) for r in rows)
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in seqs.values():
        assert [o for o, _ in sorted(members)] == np.cumsum([0, *[n for _, n in sorted(members)]]).tolist()[:-1]
        assert sum(n for _, n in members) <= 2048
    least = -(-sum(r[3] for r in rows) // 2048)
    assert len(seqs) <= 1.02 * least


def test_two_texts_of_one_id_and_repeated_rows(spark):
    rows = [(4, "two of one id"), (4, "another text"), (2, "same"), (2, "same"), (None, "no id"), (3, "very long " * 60_000)]
    docs = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, ids binary")
    t = truth()
    lengths = lambda d: sorted(len(t.encode(x, add_special_tokens=False).ids) + 1 for k, x in rows if k == d)
    got = token_output.token_file_digests(docs).collect()
    for d in (None, 2, 3, 4):
        assert sorted(r.n_tokens for r in got if r.doc_id == d) == lengths(d)
    places = sorted((r.start, r.n_tokens, -1 if r.doc_id is None else r.doc_id) for r in got)
    assert [p[0] for p in places] == np.cumsum([0, *[p[1] for p in places]]).tolist()[:-1] and [p[2] for p in places] == [-1, 2, 2, 3, 4, 4]
    packed = packing.pack_documents(docs).collect()
    assert sum(r.length for r in packed) == sum(p[1] for p in places)
