"""The plans of the queries that ask for a physical operator."""

import pytest

from basalt.plans import physical

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "parts"),
    [
        ("scan_vectorized", ["ColumnarToRow", "PushedFilters: [IsNotNull(l_quantity)"]), ("scan_fallback", ["ColumnarToRow"]), ("scan_adaptive", ["AdaptiveSparkPlan"]),
        ("join_parallel_hash", ["ShuffledHashJoin"]), ("join_spilling", ["SortMergeJoin"]), ("join_adaptive", ["AdaptiveSparkPlan"]),
        ("agg_hash", ["HashAggregate"]), ("agg_sort", ["SortAggregate"]), ("sort_external", ["rangepartitioning", "Sort"]),
    ],
)
def test_plans(spark, name, parts):
    text = plan(getattr(physical, name)(spark, SF))
    assert all(p in text for p in parts), text


def test_a_scan_has_many_tasks(spark, tmp_path):
    rows = spark.range(100_000).selectExpr("id", "cast(id % 3 as string) AS l_returnflag")
    rows.repartition(6).write.parquet(f"file://{tmp_path}/lineitem.parquet")
    out = physical.scan_parallel(spark, f"file://{tmp_path}")
    assert out.agg({"n": "sum"}).first()[0] == 100_000
    assert spark.read.parquet(f"file://{tmp_path}/lineitem.parquet").rdd.getNumPartitions() > 1
