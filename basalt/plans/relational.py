"""Queries for scans, predicates, joins, aggregation, sorting and functions.

Every oracle is DuckDB SQL over the same tables; casts there give Spark's types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.functions import scalar as S
from basalt.operators import aggregate as A
from basalt.operators import join as J
from basalt.operators import scan, sort
from basalt.plans.registry import query

col = F.col


def t(spark: SparkSession, d: str, name: str, alias: str | None = None) -> DataFrame:
    return scan.table(spark, d, name, alias)


# ---- scans ----


@query("scan_table", "SELECT r_regionkey, r_name FROM region")
def scan_table(s, d):
    return t(s, d, "region")


@query("scan_filter_project", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'")
def scan_filter_project(s, d):
    return t(s, d, "orders").filter((col("o_totalprice") > 200000) & (col("o_orderstatus") == "O")).select("o_orderkey", (col("o_totalprice") * 2).alias("twice"))


@query("index_range", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900 AND o_orderstatus <> 'P'")
def index_range(s, d):
    return scan.index_range(t(s, d, "orders"), "o_orderkey", 100, 900, col("o_orderstatus") != "P", high_open=True).select("o_orderkey", "o_custkey")


@query("composite_index", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity BETWEEN 45 AND 50")
def composite_index(s, d):
    return scan.composite_prefix(t(s, d, "lineitem"), {"l_returnflag": "R", "l_linestatus": "F"}, "l_quantity", 45, 50).select("l_orderkey", "l_linenumber", "l_quantity")


@query("index_only", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey <= 100")
def index_only(s, d):
    return scan.covering(t(s, d, "customer"), ["c_custkey", "c_mktsegment"], col("c_custkey") <= 100)


@query("bitmap_and", "SELECT p_partkey FROM part WHERE p_size > 20 AND p_type = 'PROMO' AND p_retailprice > 900")
def bitmap_and(s, d):
    return t(s, d, "part").filter(scan.bitmap_and(col("p_size") > 20, col("p_type") == "PROMO", col("p_retailprice") > 900)).select("p_partkey")


@query("bitmap_or", "SELECT p_partkey FROM part WHERE p_size = 1 OR p_type = 'ECONOMY' OR p_brand = 'Brand#3'")
def bitmap_or(s, d):
    return t(s, d, "part").filter(scan.bitmap_or(col("p_size") == 1, col("p_type") == "ECONOMY", col("p_brand") == "Brand#3")).select("p_partkey")


@query("values_rows", "SELECT * FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) v(id, name)")
def values_rows(s, d):
    return scan.values(s, [(1, "a"), (2, None), (3, "c")], "id int, name string")


@query("select_without_from", "SELECT 1 + 2 AS three, 'x' || 'y' AS xy")
def select_without_from(s, d):
    return s.sql("SELECT 1 + 2 AS three, 'x' || 'y' AS xy")


# ---- predicates ----


@query("compare_ops", "SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size < 10 AS lt, p_size <= 10 AS le, p_size > 10 AS gt, p_size >= 10 AS ge FROM part")
def compare_ops(s, d):
    c = col("p_size")
    return t(s, d, "part").select("p_partkey", (c == 10).alias("eq"), (c != 10).alias("ne"), (c < 10).alias("lt"), (c <= 10).alias("le"), (c > 10).alias("gt"), (c >= 10).alias("ge"))


@query(
    "bool_logic",
    "SELECT s_suppkey, (s_acctbal > 0 AND s_nationkey < 10) OR NOT (s_suppkey > 50) AS flag, (nullif(s_nationkey, 7) > 5) AND false AS n1, (nullif(s_nationkey, 7) > 5) OR s_suppkey > 10 AS n2 FROM supplier",
)
def bool_logic(s, d):
    n = F.nullif(col("s_nationkey"), F.lit(7)) > 5
    flag = ((col("s_acctbal") > 0) & (col("s_nationkey") < 10)) | ~(col("s_suppkey") > 50)
    return t(s, d, "supplier").select("s_suppkey", flag.alias("flag"), (n & F.lit(False)).alias("n1"), (n | (col("s_suppkey") > 10)).alias("n2"))


@query("is_null", "SELECT c_custkey, nullif(c_nationkey, 3) IS NULL AS missing, nullif(c_nationkey, 3) IS NOT NULL AS present FROM customer")
def is_null(s, d):
    n = F.nullif(col("c_nationkey"), F.lit(3))
    return t(s, d, "customer").select("c_custkey", n.isNull().alias("missing"), n.isNotNull().alias("present"))


@query("between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.06")
def between(s, d):
    return t(s, d, "lineitem").filter(col("l_discount").between(0.05, 0.06)).select("l_orderkey", "l_linenumber")


@query("not_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity NOT BETWEEN 2 AND 49")
def not_between(s, d):
    return t(s, d, "lineitem").filter(~col("l_quantity").between(2, 49)).select("l_orderkey", "l_linenumber")


@query("in_list", "SELECT n_name FROM nation WHERE n_nationkey IN (1, 3, 5, 99)")
def in_list(s, d):
    return t(s, d, "nation").filter(col("n_nationkey").isin(1, 3, 5, 99)).select("n_name")


@query("not_in_list", "SELECT n_name FROM nation WHERE nullif(n_nationkey, 7) NOT IN (1, 3, 5)")
def not_in_list(s, d):
    return t(s, d, "nation").filter(~F.nullif(col("n_nationkey"), F.lit(7)).isin(1, 3, 5)).select("n_name")


@query("in_list_with_null", "SELECT n_nationkey, n_nationkey IN (1, NULL) AS hit FROM nation")
def in_list_with_null(s, d):
    return t(s, d, "nation").select("n_nationkey", F.expr("n_nationkey IN (1, NULL)").alias("hit"))


@query("like_pred", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%blue%' AND p_name LIKE '_____%'")
def like_pred(s, d):
    return t(s, d, "part").filter(col("p_name").like("%blue%") & col("p_name").like("_____%")).select("p_partkey", "p_name")


@query("not_like", "SELECT p_partkey FROM part WHERE p_name NOT LIKE 'red%'")
def not_like(s, d):
    return t(s, d, "part").filter(~col("p_name").like("red%")).select("p_partkey")


@query("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE WHEN o_totalprice > 300000 THEN 1 END AS flag FROM orders")
def case_searched(s, d):
    p = col("o_totalprice")
    return t(s, d, "orders").select("o_orderkey", S.case((p > 300000, "high"), (p > 100000, "mid"), otherwise="low").alias("band"), S.case((p > 300000, 1)).alias("flag"))


@query("case_simple", "SELECT o_orderkey, CASE nullif(o_orderstatus, 'P') WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS word FROM orders")
def case_simple(s, d):
    return t(s, d, "orders").select("o_orderkey", S.simple_case(F.nullif(col("o_orderstatus"), F.lit("P")), ("O", "open"), ("F", "done"), otherwise="other").alias("word"))


@query("derived_table", "SELECT seg, CAST(n AS BIGINT) AS n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) x WHERE n > 10")
def derived_table(s, d):
    return A.aggregate(t(s, d, "customer"), [col("c_mktsegment").alias("seg")], {"n": F.count("*")}).filter("n > 10")


@query("params", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000.0 AND o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1996-01-01'")
def params(s, d):
    from basalt.engine import Engine

    e = Engine(s, "")
    e.register("orders", t(s, d, "orders"))
    return e.query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > $1 AND o_orderpriority = $2 AND o_orderdate >= TIMESTAMP '1996-01-01'", (250000.0, "1-URGENT"))


# ---- subqueries ----


def sql(s: SparkSession, d: str, text: str, *names: str) -> DataFrame:
    """A query through the engine's dialect, over views of the tables it names."""
    from basalt.engine import Engine

    e = Engine(s, "")
    for n in names:
        e.register(n, t(s, d, n))
    return e.query(text)


def both(name: str, text: str, *names: str) -> None:
    """Registers a query whose text both engines read."""
    query(name, text)(lambda s, d: sql(s, d, text, *names))


both("exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)", "customer", "orders")
both("not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)", "customer", "orders")
both("exists_in_select_list", "SELECT n_nationkey, EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal < 0) AS owing FROM nation n", "nation", "supplier")
both("in_subquery", "SELECT s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", "supplier", "nation")
both("not_in_subquery", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)", "part", "lineitem")
both("not_in_subquery_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 3000) OR n_nationkey NOT IN (SELECT nullif(s_nationkey, 5) FROM supplier)", "nation", "supplier")
both("in_or_exists", "SELECT c_custkey FROM customer c WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)", "customer", "nation", "orders")
both("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)", "orders")
both("scalar_subquery_empty", "SELECT r_regionkey, (SELECT max(n_nationkey) FROM nation WHERE n_regionkey = 77) AS none FROM region", "region", "nation")
both("correlated_scalar", "SELECT p_partkey, p_retailprice FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)", "part")
both("correlated_scalar_select", "SELECT n_nationkey, (SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS customers FROM nation n", "nation", "customer")


# ---- joins ----


@query("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def join_inner(s, d):
    o = t(s, d, "orders").filter("o_totalprice > 300000").select("o_orderkey", "o_custkey")
    return J.join(o, t(s, d, "customer"), {"o_custkey": "c_custkey"}).select("o_orderkey", "c_name")


LEFT = "customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 350000) o ON c_custkey = o_custkey AND o_orderstatus = 'O'"


@query("join_left", f"SELECT c_custkey, o_orderkey FROM {LEFT}")
def join_left(s, d):
    o = t(s, d, "orders").filter("o_totalprice > 350000")
    return J.join(t(s, d, "customer"), o, {"c_custkey": "o_custkey"}, "left", col("o_orderstatus") == "O").select("c_custkey", "o_orderkey")


@query("join_right", "SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 350000) o RIGHT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def join_right(s, d):
    o = t(s, d, "orders").filter("o_totalprice > 350000")
    return J.join(o, t(s, d, "customer"), {"o_custkey": "c_custkey"}, "right", col("c_acctbal") > 0).select("o_orderkey", "c_custkey")


@query("join_full", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey + 3")
def join_full(s, d):
    c = t(s, d, "customer").withColumn("k", col("c_custkey") + 3)
    return J.join(t(s, d, "supplier"), c, {"s_suppkey": "k"}, "full").select("s_suppkey", "c_custkey")


@query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(s, d):
    return J.join(t(s, d, "region"), t(s, d, "nation"), how="cross").select("r_name", "n_name")


both("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'", "nation", "region")


@query("join_theta", "SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
def join_theta(s, d):
    a, b = t(s, d, "nation", "a"), t(s, d, "nation", "b")
    return a.join(b, (col("a.n_nationkey") < col("b.n_nationkey")) & (col("a.n_regionkey") != col("b.n_regionkey"))).select(col("a.n_nationkey").alias("low"), col("b.n_nationkey").alias("high"))


PS = "SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, sum(l_quantity) AS ps_availqty, min(l_extendedprice / l_quantity) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey"


@query("join_multi_key", f"SELECT l_orderkey, l_linenumber, ps_availqty FROM lineitem JOIN ({PS}) ps ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey WHERE l_quantity > 48")
def join_multi_key(s, d):
    line = t(s, d, "lineitem")
    ps = line.groupBy(col("l_partkey").alias("ps_partkey"), col("l_suppkey").alias("ps_suppkey")).agg(F.sum("l_quantity").alias("ps_availqty"))
    big = line.filter("l_quantity > 48")
    return J.join(big, ps, {"l_partkey": "ps_partkey", "l_suppkey": "ps_suppkey"}).select("l_orderkey", "l_linenumber", "ps_availqty")


@query("join_self", "SELECT a.s_suppkey AS one, b.s_suppkey AS other FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def join_self(s, d):
    a, b = t(s, d, "supplier", "a"), t(s, d, "supplier", "b")
    return a.join(b, (col("a.s_nationkey") == col("b.s_nationkey")) & (col("a.s_suppkey") < col("b.s_suppkey"))).select(col("a.s_suppkey").alias("one"), col("b.s_suppkey").alias("other"))


@query("join_merge", "SELECT o_orderkey, CAST(count(*) AS BIGINT) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def join_merge(s, d):
    return J.merge_join(t(s, d, "orders"), t(s, d, "lineitem"), {"o_orderkey": "l_orderkey"}).groupBy("o_orderkey").agg(F.count("*").alias("lines"))


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 100000)")
def join_semi(s, d):
    return J.semi(t(s, d, "customer"), t(s, d, "orders").filter("o_orderstatus = 'P' AND o_totalprice > 100000"), {"c_custkey": "o_custkey"}).select("c_custkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 100000)")
def join_anti(s, d):
    return J.anti(t(s, d, "customer"), t(s, d, "orders").filter("o_orderstatus = 'P' AND o_totalprice > 100000"), {"c_custkey": "o_custkey"}).select("c_custkey")


@query("join_anti_null_aware", "SELECT c_custkey FROM customer WHERE nullif(c_nationkey, 4) NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def join_anti_null_aware(s, d):
    c = t(s, d, "customer").withColumn("k", F.nullif(col("c_nationkey"), F.lit(4)))
    return J.null_aware_anti(c, t(s, d, "supplier").filter("s_acctbal > 5000"), "k", "s_nationkey").select("c_custkey")


@query("join_semi_theta", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM supplier WHERE s_acctbal > p_retailprice * 4 AND s_nationkey < 9)")
def join_semi_theta(s, d):
    p, x = t(s, d, "part"), t(s, d, "supplier").filter("s_nationkey < 9")
    return J.semi(p, x, residual=x["s_acctbal"] > p["p_retailprice"] * 4).select("p_partkey")


@query("join_salted", "SELECT o_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 400000")
def join_salted(s, d):
    return J.salted(t(s, d, "lineitem"), t(s, d, "orders").filter("o_totalprice > 400000"), {"l_orderkey": "o_orderkey"}, 4).select("o_orderkey", "l_linenumber")


# ---- aggregation ----


@query(
    "agg_global",
    "SELECT CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS total, round(avg(l_discount), 6) AS mean, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem",
)
def agg_global(s, d):
    return A.aggregate(t(s, d, "lineitem"), [], {"n": F.count("*"), "total": F.round(A.sum_double("l_quantity"), 2), "mean": F.round(F.avg("l_discount"), 6), "first": F.min("l_shipdate"), "last": F.max("l_shipdate")})


@query("agg_empty", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(o_orderkey) AS BIGINT) AS k, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, min(o_orderkey) AS low FROM orders WHERE o_orderkey < 0")
def agg_empty(s, d):
    return A.aggregate(t(s, d, "orders").filter("o_orderkey < 0"), [], {"n": F.count("*"), "k": F.count("o_orderkey"), "total": A.sum_double("o_totalprice"), "mean": F.avg("o_totalprice"), "low": F.min("o_orderkey")})


@query("agg_group", "SELECT o_orderpriority, o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority, o_orderstatus")
def agg_group(s, d):
    return A.aggregate(t(s, d, "orders"), ["o_orderpriority", "o_orderstatus"], {"n": F.count("*"), "total": F.round(F.sum("o_totalprice"), 2)})


@query("agg_group_expr", "SELECT CAST(extract(year FROM o_orderdate) AS INTEGER) AS y, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def agg_group_expr(s, d):
    return A.aggregate(t(s, d, "orders"), [S.extract("YEAR", "o_orderdate").alias("y")], {"mean": F.round(F.avg("o_totalprice"), 4)})


@query("agg_group_null", "SELECT nullif(c_mktsegment, 'BUILDING') AS seg, CAST(count(*) AS BIGINT) AS n, CAST(count(nullif(c_nationkey, 1)) AS BIGINT) AS k FROM customer GROUP BY 1")
def agg_group_null(s, d):
    return A.aggregate(t(s, d, "customer"), [F.nullif(col("c_mktsegment"), F.lit("BUILDING")).alias("seg")], {"n": F.count("*"), "k": F.count(F.nullif(col("c_nationkey"), F.lit(1)))})


@query("agg_distinct_count", "SELECT l_returnflag, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, round(sum(DISTINCT l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag")
def agg_distinct_count(s, d):
    return A.aggregate(t(s, d, "lineitem"), ["l_returnflag"], {"suppliers": F.count_distinct("l_suppkey"), "parts": F.count_distinct("l_partkey"), "q": F.round(F.sum_distinct(col("l_quantity")), 2)})


@query("agg_minmax", "SELECT p_brand, min(p_name) AS a, max(p_name) AS z, min(p_size) AS lo, max(p_retailprice) AS hi FROM part GROUP BY p_brand")
def agg_minmax(s, d):
    return A.aggregate(t(s, d, "part"), ["p_brand"], {"a": F.min("p_name"), "z": F.max("p_name"), "lo": F.min("p_size"), "hi": F.max("p_retailprice")})


@query("agg_stddev", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sd FROM lineitem GROUP BY l_returnflag")
def agg_stddev(s, d):
    return A.aggregate(t(s, d, "lineitem"), ["l_returnflag"], {"sd": F.round(A.stddev("l_quantity"), 6)})


@query("agg_having", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND sum(o_totalprice) > 1000000")
def agg_having(s, d):
    out = A.aggregate(t(s, d, "orders"), ["o_custkey"], {"n": F.count("*"), "total": F.sum("o_totalprice")}, (col("n") > 15) & (col("total") > 1000000))
    return out.drop("total")


@query("agg_expr", "SELECT l_linestatus, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity), 6) AS unit, CAST(count(*) AS BIGINT) + 1 AS n1 FROM lineitem GROUP BY l_linestatus")
def agg_expr(s, d):
    return A.aggregate(t(s, d, "lineitem"), ["l_linestatus"], {"unit": F.round(F.sum(col("l_extendedprice") * (1 - col("l_discount"))) / F.sum("l_quantity"), 6), "n1": F.count("*") + 1})


@query("agg_having_subquery", "SELECT s_nationkey, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY s_nationkey HAVING sum(s_acctbal) > (SELECT avg(s_acctbal) FROM supplier)")
def agg_having_subquery(s, d):
    return sql(s, d, "SELECT s_nationkey, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY s_nationkey HAVING sum(s_acctbal) > (SELECT avg(s_acctbal) FROM supplier)", "supplier")


@query("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct(s, d):
    return A.distinct(t(s, d, "orders"), ["o_orderstatus", "o_orderpriority"])


# ---- sort and limit ----


@query("sort_nulls", "SELECT c_custkey, nullif(c_nationkey, 5) AS k FROM customer ORDER BY k ASC NULLS FIRST, c_custkey DESC NULLS LAST")
def sort_nulls(s, d):
    rows = t(s, d, "customer").select("c_custkey", F.nullif(col("c_nationkey"), F.lit(5)).alias("k"))
    return sort.sort(rows, "k", "c_custkey DESC")


@query("sort_multi", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey DESC, s_acctbal, s_suppkey")
def sort_multi(s, d):
    return sort.sort(t(s, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_nationkey DESC", "s_acctbal", "s_suppkey")


@query("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 100")
def limit_offset(s, d):
    return sort.limit(sort.sort(t(s, d, "orders").select("o_orderkey"), "o_orderkey"), 25, 100)


@query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(s, d):
    return sort.top(t(s, d, "orders").select("o_orderkey", "o_totalprice"), 10, "o_totalprice DESC", "o_orderkey")


# ---- functions ----


@query("substring", "SELECT p_partkey, substring(p_name FROM 1 FOR 3) AS head, substring(p_name FROM 3) AS tail, substring(p_name FROM 100 FOR 5) AS beyond FROM part")
def substring(s, d):
    return t(s, d, "part").select("p_partkey", S.substring("p_name", 1, 3).alias("head"), S.substring("p_name", 3).alias("tail"), S.substring("p_name", 100, 5).alias("beyond"))


@query(
    "extract",
    "SELECT event_id, CAST(extract(year FROM ts) AS INTEGER) AS y, CAST(extract(month FROM ts) AS INTEGER) AS mo, CAST(extract(day FROM ts) AS INTEGER) AS d, CAST(extract(hour FROM ts) AS INTEGER) AS h, CAST(extract(minute FROM ts) AS INTEGER) AS mi, CAST(extract(second FROM ts) AS INTEGER) AS se FROM events",
)
def extract(s, d):
    return t(s, d, "events").select("event_id", *[S.extract(f, "ts").alias(n) for f, n in (("YEAR", "y"), ("MONTH", "mo"), ("DAY", "d"), ("HOUR", "h"), ("MINUTE", "mi"), ("SECOND", "se"))])


@query("concat", "SELECT p_partkey, p_brand || ':' || nullif(p_type, 'PROMO') AS tag FROM part")
def concat(s, d):
    return t(s, d, "part").select("p_partkey", S.concat("p_brand", F.lit(":"), F.nullif(col("p_type"), F.lit("PROMO"))).alias("tag"))


@query("arith", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_linenumber / 2 AS half, l_linenumber % 3 AS third, -l_linenumber AS minus, l_linenumber + l_orderkey - 1 AS plus FROM lineitem")
def arith(s, d):
    n = col("l_linenumber")
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", (col("l_extendedprice") * (1 - col("l_discount"))).alias("net"), (n / 2).alias("half"), (n % 3).alias("third"), (-n).alias("minus"), (n + col("l_orderkey") - 1).alias("plus"))


@query(
    "date_interval",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS m, CAST(CAST(o_orderdate AS DATE) - INTERVAL 10 DAY AS DATE) AS d, o_orderdate + INTERVAL 90 MINUTE AS t, CAST(CAST(o_orderdate AS DATE) + INTERVAL 14 MONTH + INTERVAL 3 DAY AS DATE) AS md FROM orders",
)
def date_interval(s, d):
    day = col("o_orderdate").cast("date")
    return t(s, d, "orders").select("o_orderkey", S.add_interval(day, months=1).alias("m"), S.add_interval(day, days=-10).alias("d"), S.add_interval("o_orderdate", seconds=5400).alias("t"), S.add_interval(day, months=14, days=3).alias("md"))


@query("date_literals", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-03-01' AND o_orderdate < DATE '1996-03-01' + INTERVAL 1 MONTH + INTERVAL 2 DAY")
def date_literals(s, d):
    return sql(s, d, "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '03/01/1996' AND o_orderdate < DATE '1996-03-01' + INTERVAL '1 month 2 days'", "orders")


@query("date_diff", "SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS INTEGER) AS days FROM orders")
def date_diff(s, d):
    return t(s, d, "orders").select("o_orderkey", S.days_between(F.lit("2002-01-01").cast("date"), col("o_orderdate").cast("date")).alias("days"))


@query(
    "str_funcs",
    "SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS n, CAST(strlen(p_name) AS BIGINT) AS bytes, upper(p_name) AS up, lower(p_brand) AS low, trim('  ' || p_type || ' ') AS t, ltrim(' ' || p_type || ' ') AS lt, rtrim(' ' || p_type || ' ') AS rt FROM part",
)
def str_funcs(s, d):
    padded = lambda a, b: F.concat(F.lit(a), col("p_type"), F.lit(b))
    return t(s, d, "part").select(
        "p_partkey", S.length("p_name").alias("n"), S.length("p_name", in_bytes=True).alias("bytes"), S.upper("p_name").alias("up"), S.lower("p_brand").alias("low"),
        S.trim(padded("  ", " ")).alias("t"), S.ltrim(padded(" ", " ")).alias("lt"), S.rtrim(padded(" ", " ")).alias("rt"),
    )


@query(
    "num_funcs",
    "SELECT s_suppkey, abs(s_acctbal) AS a, round(s_acctbal, 1) AS r, CAST(floor(s_acctbal) AS DOUBLE) AS f, CAST(ceil(s_acctbal) AS DOUBLE) AS c, s_suppkey % 7 AS m, CAST(pow(s_nationkey, 2) AS DOUBLE) AS p, round(sqrt(s_suppkey), 9) AS q FROM supplier",
)
def num_funcs(s, d):
    return t(s, d, "supplier").select(
        "s_suppkey", S.absolute("s_acctbal").alias("a"), S.round_("s_acctbal", 1).alias("r"), S.floor("s_acctbal").alias("f"), S.ceil("s_acctbal").alias("c"),
        S.mod("s_suppkey", 7).alias("m"), S.power("s_nationkey", 2).alias("p"), F.round(S.sqrt("s_suppkey"), 9).alias("q"),
    )


@query("coalesce_nullif", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), nullif(n_nationkey, 2), -1) AS v, nullif(n_name, 'NATION_3') AS nm FROM nation")
def coalesce_nullif(s, d):
    return t(s, d, "nation").select("n_nationkey", S.coalesce(F.nullif(col("n_regionkey"), F.lit(1)), F.nullif(col("n_nationkey"), F.lit(2)), F.lit(-1)).alias("v"), S.nullif("n_name", "NATION_3").alias("nm"))


@query("cast_types", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_totalprice AS DECIMAL(18, 2)) AS d, CAST(o_orderkey AS DOUBLE) AS f, CAST(o_orderdate AS DATE) AS day FROM orders")
def cast_types(s, d):
    return sql(s, d, "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS s, CAST(o_totalprice AS DECIMAL(18, 2)) AS d, CAST(o_orderkey AS DOUBLE) AS f, CAST(o_orderdate AS DATE) AS day FROM orders", "orders")


@query("interval_times", "SELECT n_nationkey, TIMESTAMP '2020-01-01 00:00:00' + INTERVAL 6 HOUR * n_nationkey AS at FROM nation")
def interval_times(s, d):
    return t(s, d, "nation").select("n_nationkey", (F.lit("2020-01-01").cast("timestamp_ntz") + F.expr("INTERVAL '6' HOUR * n_nationkey")).alias("at"))


# ---- statistics ----


@query(
    "analyze_stats",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(count(*) AS BIGINT) AS row_count, CAST(count(*) - count({c}) AS BIGINT) AS null_count, CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count, CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value FROM orders"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    ),
)
def analyze_stats(s, d):
    from basalt.stats import column_statistics

    return column_statistics(t(s, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], exact=True).drop("bounds")


# ---- versions ----


def _versions(s, d):
    """Two versions of each order line of some orders, made by rule."""
    o = t(s, d, "orders").select(col("o_orderkey").alias("id"), col("o_totalprice").alias("v"))
    first = o.select("id", F.lit(1).alias("created"), F.when(col("id") % 3 == 0, 5).alias("deleted"), "v")
    second = o.filter("id % 3 = 0 AND id % 2 = 0").select("id", F.lit(5).alias("created"), F.lit(None).cast("int").alias("deleted"), (col("v") + 1).alias("v"))
    return first.unionByName(second)


_VERSIONS = (
    "(SELECT o_orderkey AS id, 1 AS created, CASE WHEN o_orderkey % 3 = 0 THEN 5 END AS deleted, o_totalprice AS v FROM orders"
    " UNION ALL SELECT o_orderkey, 5, NULL, o_totalprice + 1 FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0) x"
)


@query("mvcc_asof", f"SELECT id, v FROM {_VERSIONS} WHERE created <= 6 AND (deleted IS NULL OR deleted > 6)")
def mvcc_asof(s, d):
    return _versions(s, d).filter("created <= 6 AND (deleted IS NULL OR deleted > 6)").select("id", "v")


@query("latest_version", f"SELECT id, created, v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created DESC) AS n FROM {_VERSIONS}) y WHERE n = 1")
def latest_version(s, d):
    w = Window.partitionBy("id").orderBy(col("created").desc())
    return _versions(s, d).withColumn("n", F.row_number().over(w)).filter("n = 1").select("id", "created", "v")
