from pyspark.sql import functions as F

from lineweave.sources import scratch


def test_large_tables_are_not_broadcast_for_their_small_files(spark):
    n = scratch.SMALL_ROWS + 1
    many = scratch.cut(spark.range(n).withColumn("v", F.lit("the same")), "many")
    few, none = scratch.cut(spark.range(10), "few"), scratch.cut(spark.range(10).where("id > 10"), "none")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(many.join(spark.range(10 * n), "id"))
    assert "BroadcastHashJoin" not in plan(spark.range(10 * n).join(many.groupBy("id").count(), "id"))
    assert "BroadcastHashJoin" in plan(many.join(F.broadcast(few), "id"))
    assert "BroadcastHashJoin" in plan(spark.range(10 * n).join(few, "id"))
    assert (many.count(), few.count(), none.count()) == (n, 10, 0)
