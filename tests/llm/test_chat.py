import duckdb

from lineweave.llm import chat


def brute(rows):
    convs = {}
    for c, t, r, x in {r[:4] for r in rows}:
        if c is not None:
            convs.setdefault(c, []).append((-1 if t is None else t, r, x))
    convs = {c: [x[1:] for x in sorted(v, key=lambda x: (x[0], x[1] or ""))] for c, v in convs.items()}
    kept = [c for c, v in convs.items() if not any((len(w) > len(v) and w[: len(v)] == v) or (w == v and d < c) for d, w in convs.items())]
    out = []
    for c in kept:
        at = 0
        for k, (role, text) in enumerate(convs[c], 1):
            said = f"<|im_start|>{role or ''}\n{text or ''}<|im_end|>\n"
            out.append((c, k, len(convs[c]), role, at, said))
            at += len(said)
    return sorted(out)


def test_maximal_conversations(spark):
    base = [("user", "hé"), ("assistant", "b"), ("user", None), ("assistant", ""), (None, "e")]
    rows = []
    for c in range(1, 6):
        rows += [(c, t, *base[t], "x") for t in range(c)]
    rows += [(7, t, *base[t], "x") for t in range(5)]  # equal to 5
    rows += [(8, 0, "user", "hé", "x"), (8, 1, "assistant", "other", "x"), (9, None, "user", "hé", "x"), (9, None, "user", "hé", "x"), (None, 0, "user", "z", "x")]
    rows += [(10, t, "user", f"m{t}", "x") for t in range(3000)] + [(11, t, "user", f"m{t}", "x") for t in range(2500)]
    rows += [(100 + k, 0, "user", "common first", "x") for k in range(300)] + [(500 + k, t, "user", "common first" if t == 0 else f"own {k}", "x") for k in range(100) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position string")
    got = sorted(map(tuple, chat.formatted(df).collect()))
    assert got == brute(rows)
    assert {r[0] for r in got} == {5, 8, 10, *range(500, 600)}
    assert chat.formatted(df.limit(0)).count() == 0


def test_equals_sql(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}'")
    res = con.execute(chat.ORACLE_SQL)
    names = [c[0] for c in res.description]
    got = chat.formatted(spark.read.parquet(path)).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, res.fetchall()))


def test_ties_and_long_texts(spark):
    long = "very long " * 100_000
    rows = [(1, 0, "user", "b", "x"), (1, 0, "user", "a", "x"), (1, 0, "user", "b", "x"), (1, None, None, None, "x"), (2, 0, "user", long, "x"), (2, 1, "user", "end", "x"), (3, 0, "user", long, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block string")
    got = {}
    for r in chat.formatted(df.repartition(3)).collect():
        got.setdefault(r.conv_id, []).append((r.position, r.start, len(r.rendered), r.rendered))
    again = sorted(map(tuple, chat.formatted(df.coalesce(1)).collect()))
    assert again == sorted(map(tuple, chat.formatted(df.repartition(3)).collect())) and set(got) == {1, 2}
    for turns in got.values():
        turns.sort()
        assert [t[0] for t in turns] == list(range(1, len(turns) + 1)) and [t[1] for t in turns] == [sum(x[2] for x in turns[:k]) for k in range(len(turns))]
    assert len(got[1]) == 3 and got[2][0][2] > len(long)
