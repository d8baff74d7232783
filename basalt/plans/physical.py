"""Queries that ask for a physical operator: which scan, join, aggregate, sort
or exchange carries them out is Spark's, and ``tests/test_physical.py`` holds
each against its plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.plans.registry import query
from basalt.plans.relational import col, t

_SHIP = "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, CAST(max(l_shipdate) AS DATE) AS last FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 50000 GROUP BY o_orderpriority"


def _shipped(orders, items):
    joined = orders.filter("o_totalprice > 50000").join(items, col("l_orderkey") == col("o_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.max("l_shipdate").cast("date").alias("last"))


@query("scan_parallel", "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag")
def scan_parallel(s, d):
    """File splits scanned by many tasks; partial counts meet after the scan."""
    return t(s, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("scan_vectorized", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.05")
def scan_vectorized(s, d):
    """Column batches from the Parquet reader into generated code."""
    return t(s, d, "lineitem").filter("l_quantity > 45 AND l_discount < 0.05D").select("l_orderkey", "l_linenumber")


@query("scan_fallback", "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.25)) > 0")
def scan_fallback(s, d):
    """An expression over whole lists, behind the same batches."""
    return t(s, d, "embeddings").filter("exists(embedding, x -> x > 0.25)").select("vec_id")


@query("scan_adaptive", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)")
def scan_adaptive(s, d):
    """A semi-join whose build side is sized at run time."""
    few = t(s, d, "orders").filter("o_totalprice > 300000").select("o_orderkey")
    return t(s, d, "lineitem").join(few, col("l_orderkey") == col("o_orderkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query("join_parallel_hash", _SHIP)
def join_parallel_hash(s, d):
    """Both sides are dealt by the key; each task builds a hash table of its part."""
    return _shipped(t(s, d, "orders").hint("shuffle_hash"), t(s, d, "lineitem"))


@query("join_spilling", _SHIP)
def join_spilling(s, d):
    """Sorted runs that spill, merged by key."""
    return _shipped(t(s, d, "orders").hint("merge"), t(s, d, "lineitem"))


@query("join_adaptive", _SHIP)
def join_adaptive(s, d):
    """The join is chosen again at run time, from the sizes of its inputs."""
    return _shipped(t(s, d, "orders"), t(s, d, "lineitem"))


@query("agg_hash", "SELECT l_suppkey, sum(CAST(l_quantity AS DECIMAL(18, 2))) AS q FROM lineitem GROUP BY l_suppkey")
def agg_hash(s, d):
    return t(s, d, "lineitem").groupBy("l_suppkey").agg(F.sum(col("l_quantity").cast("decimal(18, 2)")).alias("q"))


@query("agg_sort", "SELECT l_suppkey, max(l_linestatus) AS status FROM lineitem GROUP BY l_suppkey")
def agg_sort(s, d):
    """A buffer of strings has no fixed width: groups are sorted."""
    return t(s, d, "lineitem").groupBy("l_suppkey").agg(F.max("l_linestatus").alias("status"))


@query("sort_external", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber")
def sort_external(s, d):
    """Ranges sorted by one task each, in runs that spill."""
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")


@query("exchange_by_key", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS spent FROM orders GROUP BY o_custkey")
def exchange_by_key(s, d):
    """One exchange by the key serves both the count and the sum of its join."""
    dealt = t(s, d, "orders").repartition("o_custkey")
    n = dealt.groupBy("o_custkey").agg(F.count("*").alias("n"))
    spent = dealt.groupBy("o_custkey").agg(F.sum(col("o_totalprice").cast("decimal(18, 2)")).alias("spent"))
    return n.join(spent, "o_custkey")
