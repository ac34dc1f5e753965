import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lineweave.llm import common, decontaminate, repetition

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contract_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_hits(text, items):
    w, hit, found = contract_words(text), set(), set()
    for item, t in items:
        own = contract_words(t)
        k = min(13, len(own))
        windows = {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(item)
    sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    return len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)


PASSAGE = "The Quick brown fóx jumps over the lazy dog and then runs far away from home today"
ITEMS = [(1, PASSAGE), (2, "short item"), (10, PASSAGE + " again"), (3, None), (4, "!!"), (None, "nothing here"), (1, PASSAGE)]
DOCS = [
    (1, PASSAGE.upper().replace("Ó", "ó") + " x " * 30, "c"),
    (2, "a short; ITEM b " + "w " * 200, "c"),
    (3, None, "c"),
    (4, "", None),
    (5, " ".join(PASSAGE.split()[:12]), "c"),
    (6, "pre " + PASSAGE + " post", "c"),
    (6, "pre " + PASSAGE + " post", "c"),
    (7, "long " * 50_000 + PASSAGE, "c"),
]


def test_decontamination(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, runs string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted((d, *brute_hits(t, [x for x in ITEMS if x[0] is not None])) for d, t, _ in DOCS)
    assert sorted(map(tuple, decontaminate.digests(docs, bench).collect())) == want
    for limits in ({"set_bytes": 16}, {"set_bytes": 16, "map_bits": 3}):  # a bit map, and one that lets all windows through
        blocks = decontaminate.scan(docs, bench, **limits).select("doc_id", "n_words", decontaminate.n_hit().alias("h"), "items")
        assert sorted((r.doc_id, r.n_words, r.h, len(r["items"])) for r in blocks.collect()) == [x[:4] for x in want]
    limit, decontaminate.BROADCAST_BYTES = decontaminate.BROADCAST_BYTES, 0
    assert sorted(map(tuple, decontaminate.digests(docs, bench).collect())) == want
    assert sorted(r.doc_id for r in decontaminate.contaminated_removed(docs, bench).collect()) == [x[0] for x in want if not x[5]]
    decontaminate.BROADCAST_BYTES = limit
    kept = decontaminate.contaminated_removed(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [x[0] for x in want if not x[5]]
    cut = {r.doc_id: r.text for r in decontaminate.spans_removed(docs, bench).collect()}
    assert cut[6] == "pre  post" and cut[3] is None and cut[2] == "a  b " + "w " * 200
    assert decontaminate.digests(docs.limit(0), bench).count() == 0
    assert decontaminate.digests(docs, bench.limit(0)).where("contaminated or n_hit > 0").count() == 0


def brute_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows, rep = {}, set()
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    longest = 0
    for at in windows.values():
        for i in at if len(at) > 1 else ():
            rep |= set(range(i, i + 8))
            for j in at:
                k = 0
                while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                    k += 1
                longest = max(longest, k)
    chars = sum(map(len, w))
    base = len(w) < 20 or 100 * len(rep) > 30 * len(w)
    kept = not base and sum(len(w[i]) for i in rep) <= 0.30 * chars and not (longest > 30 and longest > 0.05 * len(w))
    return len(w), chars, sum(c in "#*$%&|<>" for c in text), dup, len(rep), base, kept


def rules_of(texts):
    import pyarrow as pa

    m = repetition.measure(*common.buffers(pa.array(texts, pa.string())))
    return [tuple(int(m[k][i]) for k in repetition.MEASURES[:5]) for i in range(len(texts))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "é#", "\n", "c d", "\n\n", "\t"]), max_size=80).map(" ".join), min_size=1, max_size=4))
def test_measures(texts):
    assert rules_of(texts) == [brute_rules(t)[:5] for t in texts]


def test_maximal_repeats():
    w = "x a b c d y a b c d z b c d".split()
    assert repetition.maximal_repeats(w, 2) == [(4, [1, 6]), (3, [2, 7, 11])] or sorted(repetition.maximal_repeats(w, 2)) == [(3, [2, 7, 11]), (4, [1, 6])]


def test_quality_rules(spark):
    clean = " ".join(f"w{i}" for i in range(100))
    long = " ".join(f"v{i % 997}" for i in range(60_000))
    texts = [clean, None, "", "few words", clean + "\n" + clean, (clean + "\n") * 3, long, " ".join(f"u{i}" for i in range(400)) + " " + clean + " mid " + clean, clean]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = sorted(tuple(r)[:8] for r in repetition.digests(docs).collect())
    want = [(i, *brute_rules(t)) for i, t in enumerate(texts) if t is not long]
    assert [g for g in got if g[0] != 6] == want and got[6][6:] == (True, False)
    kept = repetition.rejected_removed(docs)
    assert kept.columns == docs.columns and kept.count() == sum(x[-1] for x in want)
    assert repetition.digests(docs.limit(0)).count() == 0


def test_longest_repeat_rejects_on_its_own(spark):
    fresh = (f"w{i}" for i in range(10**6))
    some = lambda n: [next(fresh) for _ in range(n)]
    passage, short = some(40), some(25)
    texts = {1: [*some(300), *passage, *some(200), *passage], 2: [*some(300), *short, *some(200), *short], 3: some(600), 4: [*some(50_000), *(p := some(4000)), *some(5000), *p]}
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in repetition.digests(docs).collect()}
    assert not any(r.base_failed or r.covered_chars > repetition.MAX_COVERED * r.word_chars for r in got.values())
    assert {k: r.kept for k, r in got.items()} == {1: False, 2: True, 3: True, 4: False}
