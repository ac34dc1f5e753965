from lineweave.plans import fixtures


def test_many_parts_are_not_broadcast(spark, tmp_path):
    for t, n, cols in (
        ("part", fixtures.HELD_ROWS + 1, "id as p_partkey, 'red cup' as p_name, 'B' as p_brand, 'T' as p_type, cast(id % 50 as int) as p_size, 1.5D as p_retailprice"),
        ("lineitem", 10, "id as l_orderkey, id as l_partkey, id as l_suppkey, 1 as l_linenumber, 1.0D as l_quantity, 1.0D as l_extendedprice, timestamp'1995-01-01' as l_shipdate"),
    ):
        spark.range(n).selectExpr(*cols.split(", ")).write.parquet(f"{tmp_path}/{t}.parquet")
    bom = fixtures.fixture(spark, str(tmp_path), "bom")
    plan = bom._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    assert bom.count() == 10
