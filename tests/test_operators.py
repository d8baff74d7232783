import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from basalt.functions import scalar as S
from basalt.operators import aggregate as A
from basalt.operators import join as J
from basalt.operators import scan, sort
from basalt.operators.windows import running_total


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "k int, v string"), spark.createDataFrame([(1, "X"), (3, "Z"), (4, "W")], "k2 int, w string")


@pytest.mark.parametrize(
    ("how", "wanted"),
    [
        ("inner", [(1, "A", 1, "X"), (3, "C", 3, "Z")]),
        ("left", [(1, "A", 1, "X"), (2, "B", None, None), (3, "C", 3, "Z")]),
        ("right", [(None, None, 4, "W"), (1, "A", 1, "X"), (3, "C", 3, "Z")]),
        ("full", [(None, None, 4, "W"), (1, "A", 1, "X"), (2, "B", None, None), (3, "C", 3, "Z")]),
        ("left_semi", [(1, "A"), (3, "C")]),
        ("left_anti", [(2, "B")]),
    ],
)
def test_joins(sides, how, wanted):
    left, right = sides
    assert rows(J.join(left, right, {"k": "k2"}, how)) == wanted
    if how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(J.salted(left, right, {"k": "k2"}, 3, how)) == wanted


def test_outer_join_keeps_rows_that_fail_the_residual(sides):
    left, right = sides
    out = J.join(left, right, {"k": "k2"}, "left", right["w"] == "X")
    assert rows(out) == [(1, "A", 1, "X"), (2, "B", None, None), (3, "C", None, None)]


def test_semi_and_anti_make_up_the_input(sides):
    left, right = sides
    assert J.semi(left, right, {"k": "k2"}).count() + J.anti(left, right, {"k": "k2"}).count() == left.count()


@pytest.mark.parametrize(("other", "n"), [([(1,), (None,)], 0), ([], 3), ([(1,)], 1)])
def test_null_aware_anti(spark, other, n):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    right = spark.createDataFrame(other, "b int")
    assert J.null_aware_anti(left, right, "a", "b").count() == n


def test_group_by_null(spark):
    df = spark.createDataFrame([("Sales", 100), ("Sales", 200), ("HR", 150), ("HR", None), (None, 1)], "dept string, pay bigint")
    out = A.aggregate(df, ["dept"], {"n": F.count("*"), "k": F.count("pay"), "total": A.sum_double("pay")})
    assert rows(out) == [(None, 1, 1, 1.0), ("HR", 2, 1, 150.0), ("Sales", 2, 2, 300.0)]
    assert rows(A.salted_sum(df, ["dept"], "pay", 3)) == [(None, 1), ("HR", 150), ("Sales", 300)]


def test_sort_puts_nulls_low_and_top_agrees(spark):
    df = spark.createDataFrame([(3,), (None,), (1,), (2,)], "a int")
    assert [r.a for r in sort.sort(df, "a").collect()] == [None, 1, 2, 3]
    assert [r.a for r in sort.sort(df, "a DESC").collect()] == [3, 2, 1, None]
    assert sort.top(df, 2, "a DESC").collect() == sort.sort(df, "a DESC").limit(2).collect()
    assert [r.a for r in sort.top(df, 2, "a", offset=1).collect()] == [1, 2]


def test_running_total_over_partitions(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    got = {r.id: r.t for r in running_total(df, "id", "v", "t").collect()}
    total = 0
    for i in range(1000):
        total += i % 7
        assert got[i] == total


def test_scan_pushes_filters_and_prunes_columns(spark):
    df = scan.index_range(scan.table(spark, "/root/testdata/sf0.001", "lineitem"), "l_orderkey", 10, 20).select("l_orderkey", "l_quantity")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_orderkey), GreaterThanOrEqual(l_orderkey,10)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_functions(spark):
    df = spark.createDataFrame([(" \t né ", -2.5, 9)], "s string, x double, n int")
    one = df.select(
        S.trim("s").alias("t"), S.ltrim("s").alias("lt"), S.length("s", in_bytes=True).alias("b"), S.round_("x").alias("r"), S.substring(F.lit("abcdef"), -3, 2).alias("sub"),
        S.substring(F.lit("abc"), 0, 2).alias("zero"), S.sqrt("n").alias("q"), S.power("n", 2).alias("p"), S.concat("s", F.lit(None)).alias("none"), S.mod("n", 4).alias("m"),
    ).first()
    assert (one.t, one.lt, one.b, one.r, one["sub"], one.zero, one.q, one.p, one.none, one.m) == ("né", "né ", 9, -3.0, "de", "ab", 3.0, 81.0, None, 1)


@pytest.mark.parametrize("make", [lambda: S.sqrt(F.lit(-1)), lambda: S.power(F.lit(10.0), 400), lambda: S.mod(F.lit(1), 0)])
def test_function_errors(spark, make):
    with pytest.raises(PySparkException):
        spark.range(1).select(make()).collect()


def test_broadcast_only_under_the_limit(spark):
    df = spark.range(10)
    assert "broadcast" in J.small_side(df)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in J.small_side(df, limit=1)._jdf.queryExecution().analyzed().toString()
