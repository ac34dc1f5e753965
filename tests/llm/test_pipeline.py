import random
import zlib

import numpy as np
from test_jaccard import brute as brute_components
from test_secrets import brute_base
from test_text_rules import brute_hits, brute_rules
from test_tokens import truth

import corpus_pipeline
from lineweave.llm import packing


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    item = " ".join(f"b{i}" for i in range(20))
    texts = [None, "", "too few words"]
    for k in range(40):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(25, 120))]
        texts.append(" ".join(base))
        if k % 4 == 0:
            texts += [" ".join(base), " ".join([*base[:-1], "changed"])]
        if k % 7 == 0:
            texts.append(" ".join([*base, *item.split()[:15], "end"]))
        if k % 5 == 0:
            texts.append(" ".join(f"s{rng.randrange(900)}" for _ in range(50)) + f' token = "{rng.getrandbits(160):040x}" tail')
        if k % 6 == 0:
            texts.append(" ".join(base[:12] * 9))
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(i, t) for i, t, *_ in rows if brute_rules(t)[-1]]
    stay = {r[2] for r in brute_components(left)}
    left = [(i, t) for i, t in left if i in stay and not brute_hits(t, [(1, item)])[-1]]
    want = {}
    for i, t in left:
        for span in reversed([x.split(":") for x in brute_base(t)[4].split(",") if x.startswith("assign")]):
            t = t[: int(span[1])] + "[secret]" + t[int(span[2]) :]
        ids = truth().encode(t, add_special_tokens=False).ids + [0]
        want |= {(i, p): (s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())) for p, (s, n) in enumerate(packing.cut_pieces(len(ids)))}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    assert 0 < len(left) < len(rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def run_over(spark, folder, rows, items, schema="doc_id long, text string, lang string, source string, n_chars long, _own long, _row string, k int"):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == spark.read.parquet(f"{folder}/documents.parquet").columns
    return docs.collect(), corpus_pipeline.run(spark, folder).collect()


def test_edge_cases(spark, tmp_path):
    plain = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"l{i}" for i in range(60_000))
    row = lambda d, t: (d, t, None, None, None if t is None else len(t), 7, "r", 3)
    rows = [row(1, plain), row(1, plain), row(2, plain + " more"), row(None, "no id " + " ".join(f"n{i}" for i in range(40))), row(4, None), row(5, ""), row(6, long), row(None, None)]
    left, packed = run_over(spark, f"{tmp_path}/a", rows, [(1, None), (None, "x y")])
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in left) == [-1, 1, 6] and {(r._own, r._row, r.k) for r in left} == {(7, "r", 3)}
    assert {r.doc_id for r in packed} == {None, 1, 6} and sum(r.length for r in packed if r.doc_id == 6) == len(truth().encode(long, add_special_tokens=False).ids) + 1
    assert run_over(spark, f"{tmp_path}/b", [], [(1, plain)]) == ([], [])
    assert len(run_over(spark, f"{tmp_path}/c", rows[:1], [])[0]) == 1
