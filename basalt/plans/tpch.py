"""TPC-H queries, adapted to the columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.plans.registry import query


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "tpch_q1",
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
           round(sum(l_extendedprice), 2) AS sum_base_price,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
           round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
           round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price,
           round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL '90' DAY
    GROUP BY l_returnflag, l_linestatus
    """,
)
def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        line.filter(F.col("l_shipdate") <= F.expr("DATE '1998-12-01' - INTERVAL '90' DAY"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(price), 2).alias("sum_disc_price"),
            F.round(F.sum(price * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


Q3 = """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
  AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10
"""


@query("tpch_q3", Q3)
def q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.lit("1998-03-15").cast("date")
    customer = load(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = load(spark, sf_dir, "orders").filter(F.col("o_orderdate") < cut).select("o_orderkey", "o_custkey", "o_orderdate")
    line = load(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") > cut)
    wanted = orders.join(customer, orders.o_custkey == customer.c_custkey, "left_semi")
    return (
        line.join(wanted, line.l_orderkey == wanted.o_orderkey)
        .groupBy("l_orderkey", "o_orderdate")
        .agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
        .orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey")
        .limit(10)
        .select("l_orderkey", "revenue", "o_orderdate")
    )


@query(
    "tpch_q6",
    """
    SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
    WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24
    """,
)
def q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem")
    day = F.col("l_shipdate")
    kept = line.filter((day >= F.lit("1996-01-01").cast("date")) & (day < F.lit("1997-01-01").cast("date")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return kept.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


#: The tables have no partsupp; its rows are derived from lineitem.
PS = """
(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, sum(l_quantity) AS ps_availqty, min(l_extendedprice / l_quantity) AS ps_supplycost
 FROM lineitem GROUP BY l_partkey, l_suppkey)
"""

#: The other queries, in text that both engines read.  Columns that the tables
#: lack are left out; windows lie where the data are.
TEXTS = {
    "tpch_q2": f"""
        SELECT s_acctbal, s_name, n_name, p_partkey FROM part, supplier, {PS} ps, nation, region
        WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size = 15 AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
          AND ps_supplycost = (SELECT min(ps2.ps_supplycost) FROM {PS} ps2, supplier s2, nation n2, region r2
              WHERE p_partkey = ps2.ps_partkey AND s2.s_suppkey = ps2.ps_suppkey AND s2.s_nationkey = n2.n_nationkey AND n2.n_regionkey = r2.r_regionkey AND r2.r_name = 'EUROPE')
        ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "tpch_q4": """
        SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS order_count FROM orders
        WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01'
          AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '60' DAY)
        GROUP BY o_orderpriority""",
    "tpch_q5": """
        SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
          AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY n_name""",
    "tpch_q7": """
        SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue FROM (
            SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS INTEGER) AS l_year, l_extendedprice * (1 - l_discount) AS volume
            FROM supplier, lineitem, orders, customer, nation n1, nation n2
            WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
              AND ((n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6'))) shipping
        GROUP BY supp_nation, cust_nation, l_year""",
    "tpch_q8": """
        SELECT o_year, round(sum(CASE WHEN nation = 'NATION_6' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
            SELECT CAST(extract(year FROM o_orderdate) AS INTEGER) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
            FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
            WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
              AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey
              AND o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND p_type = 'ECONOMY') all_nations
        GROUP BY o_year""",
    "tpch_q9": f"""
        SELECT nation, o_year, round(sum(amount), 2) AS sum_profit FROM (
            SELECT n_name AS nation, CAST(extract(year FROM o_orderdate) AS INTEGER) AS o_year, l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity AS amount
            FROM part, supplier, lineitem, {PS} ps, orders, nation
            WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey
              AND s_nationkey = n_nationkey AND p_name LIKE '%blue%') profit
        GROUP BY nation, o_year""",
    "tpch_q10": """
        SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
        GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q11": f"""
        SELECT ps_partkey, round(sum(ps_supplycost * ps_availqty), 2) AS value FROM {PS} ps, supplier WHERE ps_suppkey = s_suppkey AND s_nationkey = 7
        GROUP BY ps_partkey HAVING sum(ps_supplycost * ps_availqty) > (SELECT sum(ps_supplycost * ps_availqty) * 0.001 FROM {PS} ps, supplier WHERE ps_suppkey = s_suppkey AND s_nationkey = 7)""",
    "tpch_q12": """
        SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
               CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
        FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' GROUP BY l_returnflag""",
    "tpch_q13": """
        SELECT c_count, CAST(count(*) AS BIGINT) AS custdist FROM (
            SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '1-%' GROUP BY c_custkey) c_orders
        GROUP BY c_count""",
    "tpch_q14": """
        SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
        FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1995-09-01' AND l_shipdate < DATE '1995-10-01'""",
    "tpch_q15": """
        WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total_revenue FROM lineitem
                         WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue)""",
    "tpch_q16": f"""
        SELECT p_brand, p_type, p_size, CAST(count(DISTINCT ps_suppkey) AS BIGINT) AS supplier_cnt FROM {PS} ps, part
        WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#4' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
          AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size""",
    "tpch_q17": """
        SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem, part
        WHERE p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity < (SELECT 0.9 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""",
    "tpch_q18": """
        SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS qty FROM customer, orders, lineitem
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 300) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
        GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
    "tpch_q19": """
        SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem, part
        WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity >= 1 AND l_quantity <= 21 AND p_size BETWEEN 1 AND 25)
           OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity >= 10 AND l_quantity <= 30 AND p_size BETWEEN 1 AND 35)
           OR (p_partkey = l_partkey AND p_brand = 'Brand#3' AND l_quantity >= 20 AND l_quantity <= 40 AND p_size BETWEEN 1 AND 45)""",
    "tpch_q20": f"""
        SELECT s_name FROM supplier, nation WHERE s_suppkey IN (
            SELECT ps_suppkey FROM {PS} ps WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'blue%')
              AND ps_availqty > (SELECT 1.2 * sum(l_quantity) / 2 FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'))
          AND s_nationkey = n_nationkey AND n_nationkey < 12""",
    "tpch_q21": """
        SELECT s_name, CAST(count(*) AS BIGINT) AS numwait FROM supplier, lineitem l1, orders
        WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_returnflag = 'R'
          AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
          AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
        GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "tpch_q22": """
        SELECT cntrycode, CAST(count(*) AS BIGINT) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM (
            SELECT substring(c_name FROM 1 FOR 9) AS cntrycode, c_acctbal FROM customer
            WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00)
              AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)) custsale
        GROUP BY cntrycode""",
}


def _text_query(name: str, text: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from basalt.engine import Engine

        engine = Engine(spark, "")
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
            engine.register(t, load(spark, sf_dir, t))
        return engine.query(text)

    query(name, text)(run)


for _name, _text in TEXTS.items():
    _text_query(_name, _text)
