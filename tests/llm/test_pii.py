"""Spans of personal data against plain patterns and a plain graph; identifiers found by context."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from lineweave.llm import pii, queries

FORMS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(digits):
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def base(text):
    return sorted((m.start(), k, m.end()) for k, (kind, form) in enumerate(FORMS) for m in form.finditer(text or "") if valid(kind, m[0]))


def row(text):
    found = base(text)
    written = ",".join(f"{FORMS[k][0]}:{a}:{b}" for a, k, b in found)
    return (*(sum(s[1] == k for s in found) for k in range(4)), hashlib.sha256(written.encode()).hexdigest(), written)


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = ["a", "b.c", "x@y.z", "@", "-", ".", " ", "+", "+1", "(", ")", "1", "23", "4", "999", "10.0.0.1", "256.1.1.1", "0000010.1.2.003", "4539 1488 0343 6467", "4539148803436467", "49927398716", "+1 (555) 010-9999", "é", "😀", "_", "\n", "12345678", "x1y2@q-.r-s", "%"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(n)]


FIXED = [None, "", "a@b.c_d@e.f g@h", "1.2.3.4.5.6.7.8.9", "😀 me@x.org é +49 30 1234567", "0" * 20, "4539-1488-0343-6467-", "1 -2 3", "+1 555 010 9999 192.168.0.1", "1.1.1.1 me@a.b", "me@a.b", "me@a.b"]


def test_base_spans_equal_plain_patterns(spark):
    texts = FIXED + random_texts(3000, 7)
    docs = spark.createDataFrame([(k, t, 3) for k, t in enumerate(texts)], "doc_id long, text string, spans int").repartition(4)
    got = {r.doc_id: r for r in pii.digests(docs).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        r, want = got[k], row(text)
        own = ",".join(x for x in r.spans.split(",") if x and not x.startswith("context_"))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, own) == want, text


def test_long_runs_stay_cheap(spark):
    texts = ["a" * 2_000_000, "1" * 2_000_000, "1 " * 500_000, "a@" + "b." * 200_000 + "c", "+1" + " " * 1_000_000 + "2", "+1+2" * 300_000, "me@x.org " * 20_000, "._-" * 500_000 + "1234"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digests(docs).collect()}
    assert [(got[k].n_email, got[k].n_card) for k in range(len(texts))] == [(0, 0), (0, 0), (0, 0), (1, 0), (0, 0), (0, 0), (20_000, 0), (0, 0)]
    assert got[6].spans.endswith("email:179991:179999")
    assert got[4].n_phone == 0


def card(rng):
    while True:
        x = "4" + "".join(rng.choices("0123456789", k=15))
        if luhn(x):
            return x


@pytest.fixture(scope="module")
def letters(spark):
    """Texts in which phones and cards stand behind words of their own, and some that no form knows."""
    rng = random.Random(3)
    said = []
    for k in range(60):
        said.append(f"Dear all, call me: +1 555 {rng.randint(1000000, 9999999)} today please number {k}.")
        said.append(f"we charged card no {card(rng)} on monday")
        said.append(f"order {rng.randint(10000000, 99999999)} was shipped")
    said += ["Dear all, call me: 030/5551234567 today please", "we charged card no 4111-22-9931XA on monday", "order 77778888 was shipped", "copy 030/5551234567 there", "we charged card no nothing on monday"]
    said += ["Dear all, call me: +1 555 1234567 today please"] * 20
    return spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").repartition(5), said


def test_context_finds_unseen_identifiers(letters):
    docs, said = letters
    got = {r.doc_id: r for r in pii.digests(docs).collect()}
    added = {said[k][int(a) : int(b)] for k, r in got.items() for x, a, b in (s.split(":") for s in r.spans.split(",") if s) if x.startswith("context_")}
    assert added == {"4111-22-9931XA", "5551234567"}
    assert sum(r.n_context for r in got.values()) == 3
    assert all(row(t)[:5] == (got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone, got[k].base_sha256) for k, t in enumerate(said))


def plain_scores(graph, rounds, prior, pattern):
    """scored() by loops over (pattern, value, kind) edges."""
    known = {}
    for _ in range(rounds):
        of = defaultdict(list)
        for p, v, kind in graph:
            of[p].append([float(kind == k) if kind < 4 else known.get(v, [0.0] * 4)[k] for k in range(4)])
        sure = {p: [x if x >= pattern else 0.0 for x in (sum(y[k] for y in ys) / (len(ys) + prior) for k in range(4))] for p, ys in of.items()}
        left = defaultdict(lambda: [1.0] * 4)
        for p, v, kind in graph:
            if kind == 4 and max(sure[p]) > 0:
                left[v] = [x * (1 - c) for x, c in zip(left[v], sure[p], strict=True)]
        known = {v: [1 - x for x in xs] for v, xs in left.items()}
    return known


@pytest.mark.parametrize("sent", [0, 1000])
def test_scores_equal_plain_graph(spark, sent):
    rng = random.Random(5)
    kinds = [rng.choice([0, 0, 1, 2, 3, 4, 4]) for _ in range(120)]
    graph = sorted({(f"p{rng.choice([0, 0, 1, 1, 2, 3, rng.randint(4, 40)]) * 7 % 41}", v, kinds[v]) for v in range(120) for _ in range(4) if kinds[v] != 1 or rng.random() < 0.3})
    df = spark.createDataFrame([(p, v, v + 1, k) for p, v, k in graph], "pattern string, v long, w long, kind int")
    want = plain_scores(graph, 3, 0.5, 0.3)
    got = {r.v: [r.s0, r.s1, r.s2, r.s3] for r in pii.scored(df, prior=0.5, pattern=0.3, sent=sent).collect()}
    assert want and got.keys() == want.keys()
    assert all(math.isclose(a, b, abs_tol=1e-9) for v in want for a, b in zip(got[v], want[v], strict=True))


def test_join_instead_of_sending(letters):
    docs, _ = letters
    assert sorted(map(tuple, pii.digests(docs, sent=0).collect())) == sorted(map(tuple, pii.digests(docs).collect()))


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "me@x.org"), (1, "me@x.org"), (None, "me@x.org"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_email) for r in pii.digests(docs).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1)]
    assert pii.digests(docs.limit(0)).count() == 0


def test_query_on_given_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    df = queries.op11_pii(spark, sf)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())
    got = df.collect()
    assert len(got) == len(texts)
    assert all(row(texts[r.doc_id])[:5] == (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got)
