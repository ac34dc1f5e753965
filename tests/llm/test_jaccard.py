import random
import re

from pyspark.sql import functions as F

from lineweave.llm import jaccard
from lineweave.llm.components import components


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def near_copies(seed, groups, members, vocabulary=300):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([3, 5, 6, 20, 60, 150]))]
        for _ in range(rng.randrange(1, members)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [w[k].upper()], [f"x{rng.randrange(10)}"], [w[k], "y"]])
            rows.append(" ".join(w))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_joined_equals_all_pairs(spark):
    rows = near_copies(1, 60, 12) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "a b"), (9004, "A b"), (9005, "long x " * 30_000), (9005, "long x " * 30_000)]
    docs = spark.createDataFrame([(d, t, 1, "n") for d, t in rows], "doc_id long, text string, n long, sig string")
    got = sorted(map(tuple, jaccard.joined(docs).collect()))
    assert got == brute(rows)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({x[2] for x in got})
    twice = spark.createDataFrame([(1, "one text of the id that goes on", 1, 2), (1, "quite another text of this very id", 1, 2), (2, "one text of the id that goes on", 1, 2)], "doc_id long, text string, _own long, _at long")
    assert sorted(r.text[:3] for r in jaccard.one_of_each(twice).collect()) == ["one", "qui"]
    assert jaccard.joined(docs.limit(0)).count() == 0


def test_one_large_group(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(400):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    got = sorted(map(tuple, jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows)


def test_small_limits_lose_no_link(spark):
    rows = near_copies(7, 60, 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for limits in ({"hot": -(10**9)}, {"split": 0}, {"split": 0, "block": 2}, {"hot": -(10**9), "split": 1, "block": 1}):
        assert sorted(map(tuple, jaccard.joined(docs, **limits).collect())) == want


def test_a_shared_passage_makes_no_square(spark):
    """Classes that share one opening and don't link meet only where they share a second n-gram."""
    rng = random.Random(2)
    rows = [(d, " ".join(["one", "opening", "of", "all", "texts", *(f"v{rng.randrange(10**9)}" for _ in range(3))])) for d in range(3000)]
    rows += [(d + 5000, rows[d][1] + " x") for d in range(0, 3000, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shared = spark.createDataFrame([(1, d, 4, 0) for d in range(3000)], "gram long, sig long, n long, pos long").withColumn("salt", F.lit(0))
    signs = spark.createDataFrame([(d, [1, 10**6 + d], [0, 0, 0, 0]) for d in range(3000)], "sig long, prefix array<long>, parity array<long>")
    none = spark.createDataFrame([], "node long, component long")
    assert jaccard._between(shared, none, signs, 80, jaccard.SPLIT_PAIRS, jaccard.BLOCK_PAIRS).count() == 0
    assert jaccard._between(shared.where("sig < 40"), none, signs, 80, 10**9, 64).count() == 40 * 39 // 2
    got = {r.doc_id: r.component_id for r in jaccard.joined(docs).collect()}
    assert got == {d: d % 5000 for d, _ in rows}


def test_equal_signatures_are_told_apart(spark):
    rows = [(1, 5, 7), (2, 5, 8), (3, 5, 7), (4, 6, 1), (5, None, None)]
    got = {r.doc_id: r.sig for r in jaccard.told_apart(spark.createDataFrame(rows, "doc_id long, sig long, proof long")).collect()}
    assert got[1] == got[3] == 5 != got[2] and got[4] == 6 and got[5] is None


def test_rows_without_id(spark):
    base = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join([*base[:-1], f"e{k}"])
    other, lone = " ".join(f"v{i}" for i in range(30)), " ".join(f"u{i}" for i in range(30))
    rows = [(None, " ".join(base)), (7, " ".join(base)), (5, " ".join(base)), (3, near(1)), (None, near(2)), (None, other), (None, other), (None, other + " x"), (9, other + " y"), (None, lone), (None, lone + " x")]
    got = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()
    want = [(d, 3) for d in (None, 7, 5, 3, None)] + [(d, 9) for d in (None, None, None, 9)] + [(None, None)] * 2
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    kept = jaccard.one_of_each(spark.createDataFrame([x for x in rows if x[0] or x[1] == rows[0][1]], "doc_id long, text string"))
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [3, 9]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (101, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
