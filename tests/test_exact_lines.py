"""Pairing by words alone: one shuffle of both sides' lines, no list of candidates, and what the general operators say."""

import random

from pyspark.sql import functions as F

from lineweave.operators import matching


def _line_table(spark, seed, n):
    rng = random.Random(seed)
    keys = ["", "BOLT", "NUT M3", "PIN", None]
    return spark.createDataFrame([(k % 3, k, keys[rng.randrange(5)]) for k in range(n)], "pair long, item_ord int, norm_key string")


def test_exact_lines_say_what_candidates_say(spark):
    a, b = _line_table(spark, 1, 40), _line_table(spark, 2, 30)
    got = matching.exact_lines(a, b, ["item_ord"], ["item_ord"])
    c, pairs = matching.exact_candidates(a, b), matching.exact_pairs(a, b)
    rows = lambda df: sorted(map(tuple, df.collect()))
    paired = got.where("a is not null and b is not null")
    assert rows(paired.select("pair", "a.item_ord", "b.item_ord")) == rows(pairs.select("pair", "a_ord", "b_ord"))
    unsure = matching.ambiguities(c, pairs).groupBy("pair", "a_ord").agg(F.count(F.lit(1)).alias("n"))
    own = paired.where("n_b > 1").select("pair", "a.item_ord", F.col("n_b") - 1).union(got.where("b is null and n_b > 0").select("pair", "a.item_ord", F.lit(1)))
    assert rows(own) == rows(unsure)
    for s, other in ("ab", "ba"):
        hinted = got.where(f"{other} is null and n_{other} > 0").select("pair", f"{s}.item_ord")
        assert rows(hinted) == rows(matching.hints(c, pairs, s).select("pair", "item_ord"))
    assert got.where("a is not null").count() == 40 and got.where("b is not null").count() == 30


def test_exact_lines_need_one_shuffle(spark):
    a, b = _line_table(spark, 1, 4000), _line_table(spark, 2, 4000)
    got = matching.exact_lines(a, b, ["item_ord"], ["item_ord"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert got.count() < 8000
