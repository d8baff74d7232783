"""Extensions beyond the core dialect: set operations, CTEs, window functions,
grouping sets, and stream processing of the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.operators import scan
from basalt.operators import windows as W
from basalt.plans.registry import query
from basalt.plans.relational import both, col, t

both("ext_cte", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE n > 15) SELECT c_name, CAST(n AS BIGINT) AS n FROM top JOIN customer ON c_custkey = o_custkey", "orders", "customer")
both("ext_recursive_cte", "WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")


@query("ext_union", "SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier")
def ext_union(s, d):
    return t(s, d, "nation").select(col("n_nationkey").alias("k")).union(t(s, d, "supplier").select("s_nationkey")).distinct()


@query("ext_union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier")
def ext_union_all(s, d):
    return t(s, d, "nation").select(col("n_nationkey").alias("k")).unionByName(t(s, d, "supplier").select(col("s_nationkey").alias("k")))


@query("ext_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def ext_intersect(s, d):
    return t(s, d, "customer").select(col("c_nationkey").alias("k")).intersect(t(s, d, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("ext_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def ext_except(s, d):
    return t(s, d, "nation").select(col("n_nationkey").alias("k")).subtract(t(s, d, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("ext_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def ext_except_all(s, d):
    return t(s, d, "customer").select(col("c_nationkey").alias("k")).exceptAll(t(s, d, "supplier").select("s_nationkey"))


@query(
    "ext_window_rank",
    "SELECT c_custkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER v AS INTEGER) AS rk, CAST(dense_rank() OVER v AS INTEGER) AS dr, CAST(ntile(4) OVER w AS INTEGER) AS q FROM customer"
    " WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey), v AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)",
)
def ext_window_rank(s, d):
    w = Window.partitionBy("c_nationkey").orderBy(col("c_acctbal").desc(), "c_custkey")
    v = Window.partitionBy("c_nationkey").orderBy("c_mktsegment")
    return t(s, d, "customer").select("c_custkey", F.row_number().over(w).alias("rn"), F.rank().over(v).alias("rk"), F.dense_rank().over(v).alias("dr"), F.ntile(4).over(w).alias("q"))


@query(
    "ext_window_frame",
    "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3,"
    " round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 7) AS mean, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS head FROM orders",
)
def ext_window_frame(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(s, d, "orders").select(
        "o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last3"),
        F.round(F.avg("o_totalprice").over(Window.partitionBy("o_custkey")), 7).alias("mean"), F.first("o_orderkey").over(w).alias("head"),
    )


@query("ext_window_lag", "SELECT o_orderkey, lag(o_orderkey) OVER w AS prev, lead(o_orderkey, 2) OVER w AS next2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def ext_window_lag(s, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(s, d, "orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("prev"), F.lead("o_orderkey", 2).over(w).alias("next2"))


@query("ext_window_range", "SELECT n_nationkey, CAST(count(*) OVER (ORDER BY n_nationkey RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS near FROM nation")
def ext_window_range(s, d):
    return t(s, d, "nation").select("n_nationkey", F.count("*").over(Window.orderBy("n_nationkey").rangeBetween(-2, 1)).alias("near"))


@query("ext_running_total", "SELECT o_orderkey, CAST(sum(o_custkey) OVER (ORDER BY o_orderkey) AS BIGINT) AS running FROM orders")
def ext_running_total(s, d):
    """A running total over all rows by range partitions, not in one task."""
    return W.running_total(t(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", "running").select("o_orderkey", "running")


@query("ext_rollup", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def ext_rollup(s, d):
    return t(s, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("ext_cube", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(s, d):
    return t(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("q"))


@query("ext_stream_tumbling", "SELECT date_trunc('hour', ts) AS hour, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_stream_tumbling(s: SparkSession, d: str) -> DataFrame:
    """Hourly counts by Structured Streaming: the events are read as a stream,
    aggregated in event-time windows and collected when the input is used up."""
    from basalt.streaming import windows as S

    return S.tumbling_counts(s, f"{d}/events.parquet", "1 hour")


_DML = "SELECT o_orderkey AS id, o_custkey AS cust, o_totalprice AS price FROM orders"


def _engine(s: SparkSession, d: str):
    """A database with a parent and a child table made of customers and orders."""
    from basalt.engine import Engine
    from basalt.sources.folders import fresh

    e = Engine(s, fresh(s, "basalt-db"))
    e.register("customer", t(s, d, "customer"))
    e.register("orders", t(s, d, "orders"))
    e.sql("CREATE TABLE cust (id BIGINT PRIMARY KEY, name TEXT NOT NULL)")
    e.sql("CREATE TABLE ord (id BIGINT, cust BIGINT REFERENCES cust(id) ON DELETE CASCADE, price DOUBLE CHECK (price > 0))")
    e.sql("INSERT INTO cust SELECT c_custkey, c_name FROM customer")
    e.sql(f"INSERT INTO ord (id, cust, price) {_DML}")
    return e


@query("dml_insert", f"{_DML} UNION ALL SELECT 100000000, 1, 5.5")
def dml_insert(s, d):
    e = _engine(s, d)
    e.sql("INSERT INTO ord VALUES (100000000, $1, 5.5)", (1,))
    return e.sql("SELECT id, cust, price FROM ord")


@query("dml_update", f"SELECT id, cust, CASE WHEN cust % 2 = 0 THEN price * 2 + 1 ELSE price END AS price FROM ({_DML}) x")
def dml_update(s, d):
    e = _engine(s, d)
    e.sql("UPDATE ord SET price = price * 2 + 1 WHERE cust % 2 = 0")
    return e.sql("SELECT id, cust, price FROM ord")


@query("dml_delete", f"SELECT id, cust, price FROM ({_DML}) x WHERE NOT (price > 100000 AND id % 3 = 0)")
def dml_delete(s, d):
    e = _engine(s, d)
    e.sql("DELETE FROM ord WHERE price > 100000 AND id % 3 = 0")
    return e.sql("SELECT id, cust, price FROM ord")


@query("dml_delete_cascade", f"SELECT id, cust, price FROM ({_DML}) x WHERE cust % 5 <> 0")
def dml_delete_cascade(s, d):
    e = _engine(s, d)
    e.sql("DELETE FROM cust WHERE id % 5 = 0")
    return e.sql("SELECT id, cust, price FROM ord")


@query("ext_dml_returning", f"SELECT id, price + 1 AS price FROM ({_DML}) x WHERE cust < 500")
def ext_dml_returning(s, d):
    return _engine(s, d).sql("UPDATE ord SET price = price + 1 WHERE cust < 500 RETURNING id, price")


@query("txn_rollback", _DML)
def txn_rollback(s, d):
    e = _engine(s, d)
    e.sql("BEGIN")
    e.sql("DELETE FROM ord")
    e.sql("ROLLBACK")
    return e.sql("SELECT id, cust, price FROM ord")


@query("txn_snapshot", _DML)
def txn_snapshot(s, d):
    """A repeatable read does not see what another session commits meanwhile."""
    e = _engine(s, d)
    reader = e.session()
    reader.sql("BEGIN ISOLATION LEVEL REPEATABLE READ")
    e.sql("DELETE FROM ord WHERE id < 100")
    return reader.sql("SELECT id, cust, price FROM ord")


@query("ddl_alter", f"SELECT id, price, 'new' AS note FROM ({_DML}) x")
def ddl_alter(s, d):
    e = _engine(s, d)
    e.sql("ALTER TABLE ord ADD COLUMN note TEXT DEFAULT 'new'")
    e.sql("ALTER TABLE ord DROP COLUMN cust")
    return e.sql("SELECT * FROM ord")


@query("vacuum_live_rows", f"SELECT id, cust, price FROM ({_DML}) x WHERE id % 4 <> 0")
def vacuum_live_rows(s, d):
    e = _engine(s, d)
    e.sql("DELETE FROM ord WHERE id % 4 = 0")
    e.sql("VACUUM ord")
    return e.sql("SELECT id, cust, price FROM ord")


@query("copy_csv_roundtrip", "SELECT p_partkey, p_name, nullif(p_type, 'PROMO') AS p_type, p_retailprice FROM part")
def copy_csv_roundtrip(s, d):
    from basalt.sources import copy
    from basalt.sources.folders import fresh

    rows = t(s, d, "part").select("p_partkey", "p_name", F.nullif(col("p_type"), F.lit("PROMO")).alias("p_type"), "p_retailprice")
    path = fresh(s, "basalt-csv")
    copy.write_csv(rows, path, header=True)
    return copy.read_csv(s, path, rows.schema, header=True)


@query("copy_text_roundtrip", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type || chr(9) || chr(92) || chr(10) || 'x' END AS odd, value FROM events")
def copy_text_roundtrip(s, d):
    from basalt.sources import copy
    from basalt.sources.folders import fresh

    odd = F.when(col("event_id") % 7 != 0, F.concat("event_type", F.lit("\t\\\nx")))
    rows = t(s, d, "events").select("event_id", odd.alias("odd"), "value")
    path = fresh(s, "basalt-text")
    copy.write_text(rows, path)
    return copy.read_text(s, path, rows.schema)


@query("check_violations", "SELECT s_suppkey, s_acctbal FROM supplier WHERE NOT (s_acctbal > 0)")
def check_violations(s, d):
    from basalt.constraints import check_violations as found

    return found(t(s, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal > 0")


@query("fk_violations", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)")
def fk_violations(s, d):
    from basalt.constraints import foreign_key_violations as found

    return found(t(s, d, "orders"), t(s, d, "customer").filter("c_nationkey <> 3"), ["o_custkey"], ["c_custkey"]).select("o_orderkey")


@query("unique_violations", "SELECT s_nationkey, CAST(count(*) AS BIGINT) AS count FROM supplier GROUP BY s_nationkey HAVING count(*) > 1")
def unique_violations(s, d):
    from basalt.constraints import unique_violations as found

    return found(t(s, d, "supplier"), ["s_nationkey"])


@query("prepared_statement", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 2 AND n_nationkey > 5")
def prepared_statement(s, d):
    from basalt.engine import Engine

    e = Engine(s, "")
    e.register("nation", t(s, d, "nation"))
    e.sql("PREPARE pick (INT, INT) AS SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = $1 AND n_nationkey > $2")
    return e.sql("EXECUTE pick (2, 5)")


@query("result_cache", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus")
def result_cache(s, d):
    from basalt.cache import ResultCache

    cache = ResultCache()
    make = lambda: t(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    cache.get("q", frozenset(["orders"]), make)
    return cache.get("q", frozenset(["orders"]), make)


@query("plan_cache_stats", "SELECT CAST(1 AS BIGINT) AS hits, CAST(2 AS BIGINT) AS misses, CAST(2 AS BIGINT) AS size, CAST(0 AS BIGINT) AS evictions, 1.0 / 3 AS hit_rate, CAST(100 AS BIGINT) AS max_size")
def plan_cache_stats(s, d):
    from basalt.engine import Engine

    e = Engine(s, "")
    e.register("nation", t(s, d, "nation"))
    for _ in range(2):
        e.query("SELECT count(*) FROM nation")
    return e.query("SELECT * FROM plan_cache_stats")


@query("index_layout", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 100 AND 200")
def index_layout(s, d):
    """Rows laid out by a key: range partitions, sorted, so that a range reads few row groups."""
    from basalt.operators.sort import sorted_within
    from basalt.sources.folders import fresh

    path = fresh(s, "basalt-layout")
    sorted_within(t(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey").write.parquet(path)
    return scan.index_range(s.read.parquet(path), "o_custkey", 100, 200)


@query("select_star", "SELECT * FROM supplier")
def select_star(s, d):
    return t(s, d, "supplier")


both("select_star_and_alias", "SELECT s.*, s_acctbal * 2 AS twice FROM supplier AS s", "supplier")
both("join_using", "SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS r_regionkey FROM nation) n JOIN region USING (r_regionkey)", "nation", "region")
both("join_natural", "SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS r_regionkey FROM nation) n NATURAL JOIN region", "nation", "region")
both("ext_lateral", "SELECT r_name, n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) x", "region", "nation")
both("ext_grouping_sets", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", "orders")
both("ext_agg_filter", "SELECT o_orderstatus, CAST(count(*) FILTER (WHERE o_totalprice > 200000) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus", "orders")


@query("ext_truncate", "SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey < 0")
def ext_truncate(s, d):
    e = _engine(s, d)
    e.sql("TRUNCATE TABLE ord")
    return e.sql("SELECT count(*) AS n FROM ord")


@query("ext_serial", "SELECT CAST(row_number() OVER () AS INTEGER) AS id FROM orders")
def ext_serial(s, d):
    """SERIAL columns number rows without gaps, over any number of partitions."""
    e = _engine(s, d)
    e.sql("CREATE TABLE numbered (id SERIAL, price DOUBLE)")
    e.register("wide", t(s, d, "orders").repartition(7))
    e.sql("INSERT INTO numbered (price) SELECT o_totalprice FROM wide")
    return e.sql("SELECT id FROM numbered")


@query("dml_delete_set_null", f"SELECT id, CASE WHEN cust % 5 = 0 THEN NULL ELSE cust END AS cust FROM ({_DML}) x")
def dml_delete_set_null(s, d):
    e = _engine(s, d)
    e.sql("CREATE TABLE loose (id BIGINT, cust BIGINT REFERENCES cust(id) ON DELETE SET NULL)")
    e.sql("INSERT INTO loose SELECT id, cust FROM ord")
    e.sql("DELETE FROM cust WHERE id % 5 = 0")
    return e.sql("SELECT id, cust FROM loose")


@query("ddl_unique_index", "SELECT 'refused' AS outcome")
def ddl_unique_index(s, d):
    from basalt.constraints import ConstraintError

    e = _engine(s, d)
    e.sql("CREATE UNIQUE INDEX one ON ord USING BTREE (id)")
    try:
        e.sql("INSERT INTO ord SELECT id, cust, price FROM ord")
        outcome = "accepted"
    except ConstraintError:
        outcome = "refused"
    return scan.values(s, [(outcome,)], "outcome string")


@query("partial_index_layout", f"SELECT id, price FROM ({_DML}) x WHERE price > 150000")
def partial_index_layout(s, d):
    e = _engine(s, d)
    e.sql("CREATE INDEX dear ON ord (id) INCLUDE (price) WHERE price > 150000")
    return e.layout("dear")


@query("index_advice", "SELECT * FROM (VALUES ('orders', 'covering', 'o_custkey,o_orderdate', 'o_totalprice', 'high')) v(table_name, kind, columns, include, priority)")
def index_advice(s, d):
    from basalt.advisor import Pattern, recommend

    made = recommend([Pattern("orders", ("o_custkey",), ("o_orderdate",), ("o_totalprice",))] * 6)
    return scan.values(s, [(r.table, r.kind, ",".join(r.columns), ",".join(r.include), r.priority) for r in made], "table_name string, kind string, columns string, include string, priority string")


@query("explain_analyze_rows", "SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_totalprice > 100000")
def explain_analyze_rows(s, d):
    """The row count that EXPLAIN ANALYZE tells."""
    from basalt.engine import Engine

    e = Engine(s, "")
    e.register("orders", t(s, d, "orders"))
    plan = e.sql("EXPLAIN ANALYZE SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")
    return plan.filter("plan LIKE 'Rows: %'").select(F.regexp_extract("plan", r"Rows: (\d+)", 1).cast("bigint").alias("n"))


@query("version_history", f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN id % 4 = 0 THEN 1 END) AS BIGINT) AS gone FROM ({_DML}) x")
def version_history(s, d):
    e = _engine(s, d)
    e.sql("DELETE FROM ord WHERE id % 4 = 0")
    return e.tables["ord"].history().agg(F.count("*").alias("n"), F.count("_deleted").alias("gone"))


@query("time_travel", _DML)
def time_travel(s, d):
    e = _engine(s, d)
    before = e.tables["ord"].version()
    e.sql("UPDATE ord SET price = 1")
    return e.query("SELECT id, cust, price FROM ord", as_of={"ord": before})


@query("portal_fetch", "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 8")
def portal_fetch(s, d):
    """Two partial fetches of a bound statement."""
    from basalt.engine import Engine

    e = Engine(s, "")
    e.register("nation", t(s, d, "nation"))
    e.prepare("all", "SELECT n_nationkey FROM nation WHERE n_nationkey >= $1 ORDER BY n_nationkey")
    portal = e.bind("all", (0,))
    return scan.values(s, [tuple(r) for r in portal.fetch(5) + portal.fetch(3)], "n_nationkey int")


# ---- transactions ----


@query("txn_two_inserts_delete", f"{_DML} UNION ALL SELECT 100000002, 2, 2.5")
def txn_two_inserts_delete(s, d):
    """Two writes of one transaction have row keys of their own."""
    e = _engine(s, d)
    for text in ("BEGIN", "INSERT INTO ord VALUES (100000001, 1, 1.5)", "INSERT INTO ord VALUES (100000002, 2, 2.5)", "COMMIT", "DELETE FROM ord WHERE id = 100000001"):
        e.sql(text)
    return e.sql("SELECT id, cust, price FROM ord")


@query("txn_insert_update", f"SELECT id, cust, CASE WHEN cust = 1 THEN price + 1 ELSE price END AS price FROM ({_DML} UNION ALL SELECT 100000001, 1, 1.5) x")
def txn_insert_update(s, d):
    """A transaction updates what it inserted itself."""
    e = _engine(s, d)
    for text in ("BEGIN", "INSERT INTO ord VALUES (100000001, 1, 1.5)", "UPDATE ord SET price = price + 1 WHERE cust = 1", "COMMIT"):
        e.sql(text)
    return e.sql("SELECT id, cust, price FROM ord")


def _second_fails(e, first: str, second: str) -> None:
    """Two sessions change a table in transactions at once; the second to commit is refused."""
    from basalt.constraints import ConstraintError
    from basalt.engine import SerializationError

    other = e.session()
    for one, text in ((e, first), (other, second)):
        one.sql("BEGIN")
        one.sql(text)
    e.sql("COMMIT")
    try:
        other.sql("COMMIT")
    except (SerializationError, ConstraintError):
        return
    raise AssertionError("both transactions were committed")


@query("txn_two_writers", f"SELECT id, cust, CASE WHEN cust % 2 = 0 THEN price + 1 ELSE price END AS price FROM ({_DML}) x")
def txn_two_writers(s, d):
    """Of two updates of the same rows the first to commit wins."""
    e = _engine(s, d)
    _second_fails(e, "UPDATE ord SET price = price + 1 WHERE cust % 2 = 0", "UPDATE ord SET price = 7 WHERE cust % 4 = 0")
    return e.sql("SELECT id, cust, price FROM ord")


@query("txn_pk_two_writers", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 100000001, 'first'")
def txn_pk_two_writers(s, d):
    """A primary key holds over two transactions that insert it at once."""
    e = _engine(s, d)
    _second_fails(e, "INSERT INTO cust VALUES (100000001, 'first')", "INSERT INTO cust VALUES (100000001, 'second')")
    return e.sql("SELECT id, name FROM cust")


@query("txn_read_committed", f"SELECT id, cust, price FROM ({_DML}) x WHERE id >= 100")
def txn_read_committed(s, d):
    """Each statement of a read-committed transaction sees what is committed by then."""
    e = _engine(s, d)
    reader = e.session()
    reader.sql("BEGIN")
    reader.sql("SELECT count(*) FROM ord")
    e.sql("DELETE FROM ord WHERE id < 100")
    return reader.sql("SELECT id, cust, price FROM ord")


# ---- statements ----


@query("dml_update_cascade", f"SELECT id, CASE WHEN cust % 5 = 0 THEN cust + 100000000 ELSE cust END AS cust FROM ({_DML}) x")
def dml_update_cascade(s, d):
    e = _engine(s, d)
    e.sql("CREATE TABLE follows (id BIGINT, cust BIGINT REFERENCES cust(id) ON UPDATE CASCADE)")
    e.sql("INSERT INTO follows SELECT id, cust FROM ord")
    e.sql("DELETE FROM ord")
    e.sql("UPDATE cust SET id = id + 100000000 WHERE id % 5 = 0")
    return e.sql("SELECT id, cust FROM follows")


def _copy_statement(s, d, how: str):
    """All rows of a table through COPY TO and COPY FROM."""
    from basalt.sources.folders import fresh

    e, path = _engine(s, d), fresh(s, "basalt-copy")
    e.sql(f"COPY ord TO '{path}' WITH {how}")
    e.sql("CREATE TABLE again (id BIGINT, cust BIGINT, price DOUBLE)")
    e.sql(f"COPY again FROM '{path}' WITH {how}")
    return e.sql("SELECT id, cust, price FROM again")


@query("copy_text_statement", _DML)
def copy_text_statement(s, d):
    return _copy_statement(s, d, "(FORMAT TEXT)")


@query("copy_csv_statement", _DML)
def copy_csv_statement(s, d):
    return _copy_statement(s, d, "(FORMAT CSV, HEADER, DELIMITER '|')")


@query("copy_binary_statement", _DML)
def copy_binary_statement(s, d):
    return _copy_statement(s, d, "(FORMAT BINARY)")


@query("ddl_drop_table", "SELECT c_custkey AS id, c_name AS name FROM customer")
def ddl_drop_table(s, d):
    """A dropped table is gone, its name is free and its parent no longer held."""
    e = _engine(s, d)
    e.sql("DROP TABLE ord")
    e.sql("DROP TABLE cust")
    e.sql("CREATE TABLE cust (id BIGINT, name TEXT)")
    e.sql("INSERT INTO cust SELECT c_custkey, c_name FROM customer")
    return e.sql("SELECT id, name FROM cust")


@query("ddl_drop_index", f"{_DML} UNION ALL {_DML}")
def ddl_drop_index(s, d):
    """Rows that a unique index would refuse, after it is dropped."""
    e = _engine(s, d)
    e.sql("CREATE UNIQUE INDEX one ON ord (id)")
    e.sql("DROP INDEX one")
    e.sql("INSERT INTO ord SELECT id, cust, price FROM ord")
    return e.sql("SELECT id, cust, price FROM ord")


@query("deallocate", "SELECT n_name FROM nation WHERE n_regionkey = 3")
def deallocate(s, d):
    """A prepared statement's name is free again after DEALLOCATE."""
    from basalt.engine import Engine

    e = Engine(s, "")
    e.register("nation", t(s, d, "nation"))
    e.sql("PREPARE pick (INT) AS SELECT n_name FROM nation WHERE n_nationkey = $1")
    e.sql("DEALLOCATE pick")
    e.sql("PREPARE pick (INT) AS SELECT n_name FROM nation WHERE n_regionkey = $1")
    return e.sql("EXECUTE pick (3)")


@query("explain_delete", f"{_DML}")
def explain_delete(s, d):
    """EXPLAIN of a change changes nothing."""
    e = _engine(s, d)
    e.sql("EXPLAIN DELETE FROM ord WHERE price > 1000").collect()
    return e.sql("SELECT id, cust, price FROM ord")


@query("sql_functions", "SELECT s_suppkey, sqrt(s_suppkey) AS q, CAST(pow(s_nationkey, 2) AS DOUBLE) AS p, CAST(floor(s_acctbal) AS DOUBLE) AS f, CAST(ceil(s_acctbal) AS DOUBLE) AS c, trim(' ' || s_name || ' ') AS t, substring(s_name, 1, 4) AS head, CAST(length(s_name) AS BIGINT) AS n FROM supplier")
def sql_functions(s, d):
    """The dialect's functions in SQL text follow its rules."""
    from basalt.engine import Engine

    e = Engine(s, "")
    e.register("supplier", t(s, d, "supplier"))
    return e.sql("SELECT s_suppkey, sqrt(s_suppkey) AS q, power(s_nationkey, 2) AS p, floor(s_acctbal) AS f, ceil(s_acctbal) AS c, trim(' ' || s_name || ' ') AS t, substring(s_name FROM 0 FOR 4) AS head, length(s_name) AS n FROM supplier")


@query("sql_interval_factor", "SELECT n_nationkey, TIMESTAMP '2020-01-31 00:00:00' + INTERVAL 2 MONTH + INTERVAL 4 DAY AS twice FROM nation")
def sql_interval_factor(s, d):
    """A factor of a mixed interval holds for all its units."""
    from basalt.engine import Engine

    e = Engine(s, "")
    e.register("nation", t(s, d, "nation"))
    return e.sql("SELECT n_nationkey, TIMESTAMP '2020-01-31 00:00:00' + INTERVAL '1 month 2 days' * 2 AS twice FROM nation")
