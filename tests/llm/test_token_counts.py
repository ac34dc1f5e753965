from hypothesis import given, settings
from hypothesis import strategies as st

from lineweave.llm import token_counts

T = token_counts.transducer()
WORDS = sorted(T.words)


def library(texts):
    return [len(T.model.encode(t or "")) for t in texts]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=50), st.text(alphabet="etaoinsh  \n.,12é▁日\x00", max_size=60), st.lists(st.sampled_from(WORDS), max_size=12).map(lambda x: "".join(x).replace("▁", " ")), st.lists(st.sampled_from(["  ", "   ", "the", "t", "</s>", "<s>", "▁", "<0x0A>", "ing", "…"]), max_size=10).map("".join)))
def test_counts_equal_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert T.counts([text, None, text]).tolist() == library([text, None, text])


def test_space_runs_and_long_units():
    texts = [" " * n + w for n in range(1, 70) for w in ("", "the", "1", "\n")] + ["lorem" * 3000, "日本語文" * 2000, "a b " * 5000]
    assert T.counts(texts).tolist() == library(texts)


def test_state_maps_compose():
    text = "▁internationalisationofthewholeunit"
    entries = {T.chunk_map(0, text[:k])[0] for k in range(len(text))}
    assert len(entries) > 3
    for cut in range(1, len(text)):
        f = T.state_map(text[:cut], [0])
        g = T.state_map(text[cut:], entries | {x for x, _ in f.values()})
        assert token_counts.compose(f, g) == T.state_map(text, [0])
    middle = T.state_map("ation", entries)
    last = T.state_map("sof", {x for x, _ in middle.values()})
    assert token_counts.compose(middle, last) == T.state_map("ationsof", entries)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([w for w in WORDS if "▁" not in w]), min_size=1, max_size=60).map("".join), st.integers(1, 9), st.integers(0, 9))
def test_long_units_by_composition(word, chunk, warm):
    """Also with chunks so short, and guesses so poor, that maps must be extended."""
    text = "▁" + word
    assert T.composed(text, chunk, warm) == T.chunk_map(0, text)


def test_memo_and_states_are_built_anew():
    limits = token_counts.MEMO_UNITS, token_counts.MAX_STATES
    token_counts.MEMO_UNITS, token_counts.MAX_STATES = 3, 20
    try:
        texts = ["several words that fill the memo and many states of it", "unbelievably " * 30, "again and again"]
        assert [int(T.counts([t])[0]) for t in texts] == library(texts)
    finally:
        token_counts.MEMO_UNITS, token_counts.MAX_STATES = limits


def test_counted(spark):
    texts = [None, "", "plain text", "ünï  code\t日", "word " * 5000, "same", "same"]
    docs = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts.counted(docs).collect()))
    assert got == [(i, len((t or "").encode()), n, n > 4096) for i, (t, n) in enumerate(zip(texts, library(texts), strict=True))]
    assert token_counts.counted(docs.limit(0)).count() == 0
