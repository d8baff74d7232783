import pytest
from pyspark.sql import types as T

from basalt import advisor
from basalt.cache import PlanCache
from basalt.catalog import Index
from basalt.stats import selectivity
from basalt.types import spark_type


def test_types():
    assert spark_type("decimal(12, 2)") == T.DecimalType(12, 2)
    assert spark_type("NUMERIC") == T.DecimalType(10, 0)
    assert spark_type("varchar") == T.StringType()
    assert spark_type("VARCHAR(5)") == T.VarcharType(5)
    assert spark_type("double  precision") == T.DoubleType()
    with pytest.raises(ValueError):
        spark_type("xml")


def test_plan_cache_evicts_the_oldest():
    cache = PlanCache(2)
    for k in "abac":
        cache.get(k, lambda: k)
    assert (cache.stats.hits, cache.stats.misses, cache.stats.evictions) == (1, 3, 1)
    cache.get("a", lambda: 0)
    assert cache.stats.hits == 2


def test_selectivity():
    bounds = [0.0, 10.0, 20.0, 30.0, 40.0]
    assert selectivity(bounds, 10, 30) == 0.5
    assert selectivity(bounds, None, 5) == 0.125
    assert selectivity([], 1, 2) == 1.0


def test_advisor():
    p = advisor.Pattern("orders", ("o_custkey",), ("o_orderdate",), ("o_totalprice",))
    best = advisor.recommend([p] * 6)[0]
    assert (best.kind, best.columns, best.include, best.priority) == ("covering", ("o_custkey", "o_orderdate"), ("o_totalprice",), "high")
    index = Index("i", "orders", ["o_custkey", "o_orderdate"])
    assert advisor.recommend([p], [index]) == []
    assert advisor.matches_prefix(index, {"o_custkey"}, {"o_orderdate"}) == 2
    assert not advisor.usable(Index("j", "orders", ["a"], where="x > 1"), {"a"}, set())


def test_stream_drops_late_rows(spark):
    from basalt.streaming.windows import late_filtered

    out = late_filtered(spark, "/root/testdata/sf0.001/events.parquet", "1 hour", "10 minutes")
    assert 0 < out.count()
