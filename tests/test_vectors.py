import numpy as np
from pyspark.sql import functions as F

from lineweave.operators import vectors


def _table(spark, x, name):
    return spark.createDataFrame([(f"{name}{k}", v.tolist()) for k, v in enumerate(x)], vectors.VECTORS)


def test_near_pairs_and_their_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 32))
    y = np.concatenate([x + 0.25 * rng.standard_normal(x.shape), x + 0.45 * rng.standard_normal(x.shape), rng.standard_normal((200, 32))])
    a, b = _table(spark, x, "a").union(spark.createDataFrame([("short", [1.0]), ("none", None)], vectors.VECTORS)), _table(spark, y, "b")
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    cosine = unit(x) @ unit(y).T
    want = {(f"a{i}", f"b{j}") for i, j in zip(*np.nonzero(np.round(cosine, 4) >= 0.9), strict=True)}
    exact = {(r.a_text, r.b_text) for r in vectors.near(a, b, 0.9, dim=32, exact=True).collect()}
    assert exact == want and len(want) > 300
    found = [(r.a_text, r.b_text) for r in vectors.near(a, b, 0.9, dim=32).collect()]
    assert len(found) == len(set(found)) and set(found) <= want
    assert len(found) >= 0.9 * len(want) and vectors.recall(0.9, 12, 24) >= 0.9


def test_each_text_is_embedded_once(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def embed(texts):
        with open(seen, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [[float(len(t))] for t in texts]

    path = f"file://{tmp_path}/vectors"
    said = lambda *t: spark.createDataFrame([(x,) for x in t], "norm_text string")
    assert {r.norm_text: r.vector for r in vectors.extended(said("a", "bb", "a", "", None), path, embed).collect()} == {"a": [1.0], "bb": [2.0]}
    assert {r.norm_text for r in vectors.extended(said("bb", "ccc"), path, embed).collect()} == {"bb", "ccc"}
    assert vectors.extended(said(), path, embed).count() == 0
    assert sorted(open(seen).read().split()) == ["a", "bb", "ccc"]
    assert vectors.stored(spark, path).agg(F.count(F.lit(1))).first()[0] == 3
