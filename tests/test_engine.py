import datetime

import pytest

from basalt.constraints import ConstraintError
from basalt.engine import Engine, SerializationError
from basalt.sources.versioned import CommitConflict


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.fixture()
def db(spark, folder):
    e = Engine(spark, folder)
    e.sql("CREATE TABLE departments (id INTEGER PRIMARY KEY, name VARCHAR(10) NOT NULL)")
    e.sql("CREATE TABLE employees (id SERIAL, name TEXT DEFAULT 'x', dept INT REFERENCES departments(id) ON DELETE CASCADE, age INT CHECK (age BETWEEN 0 AND 120))")
    e.sql("INSERT INTO departments VALUES (1, 'eng'), (2, 'hr')")
    e.sql("INSERT INTO employees (name, dept, age) VALUES ('a', 1, 30), ('b', 1, 40), ('c', 2, NULL)")
    return e


def test_insert_defaults_serial_and_returning(db):
    assert rows(db.sql("SELECT id FROM employees")) == [(1,), (2,), (3,)]
    assert rows(db.sql("INSERT INTO employees (dept) VALUES (2) RETURNING id, name")) == [(4, "x")]


@pytest.mark.parametrize(
    "text",
    [
        "INSERT INTO employees (dept) VALUES (9)",
        "INSERT INTO departments VALUES (1, 'dup')",
        "INSERT INTO departments VALUES (7, NULL)",
        "UPDATE employees SET age = 200",
        "UPDATE departments SET id = 5 WHERE id = 1",
    ],
)
def test_constraints_refuse(db, text):
    before = rows(db.sql("SELECT * FROM employees")), rows(db.sql("SELECT * FROM departments"))
    with pytest.raises(ConstraintError):
        db.sql(text)
    assert before == (rows(db.sql("SELECT * FROM employees")), rows(db.sql("SELECT * FROM departments")))


def test_varchar_length(db):
    with pytest.raises(Exception, match="too long"):
        db.sql("INSERT INTO departments VALUES (3, 'far too long a name')")


def test_update_with_subquery_and_parameters(db):
    db.sql("UPDATE employees SET age = age + $1 WHERE dept IN (SELECT id FROM departments WHERE name = 'eng')", (5,))
    assert rows(db.sql("SELECT name, age FROM employees")) == [("a", 35), ("b", 45), ("c", None)]


def test_delete_ignores_unknown(db):
    db.sql("DELETE FROM employees WHERE age > 30")
    assert rows(db.sql("SELECT name FROM employees")) == [("a",), ("c",)]


def test_cascade(db):
    db.sql("DELETE FROM departments WHERE id = 1")
    assert rows(db.sql("SELECT name FROM employees")) == [("c",)]


@pytest.mark.parametrize(("action", "left"), [("SET NULL", [(1, None)]), ("SET DEFAULT", [(1, 2)])])
def test_set_actions(spark, folder, action, left):
    e = Engine(spark, folder)
    e.sql("CREATE TABLE p (id INT PRIMARY KEY)")
    e.sql(f"CREATE TABLE c (id INT, p INT DEFAULT 2, FOREIGN KEY (p) REFERENCES p (id) ON DELETE {action})")
    e.sql("INSERT INTO p VALUES (1), (2)")
    e.sql("INSERT INTO c VALUES (1, 1)")
    e.sql("DELETE FROM p WHERE id = 1")
    assert rows(e.sql("SELECT id, p FROM c")) == left


def test_restrict_and_cycles(spark, folder):
    e = Engine(spark, folder)
    e.sql("CREATE TABLE p (id INT PRIMARY KEY, up INT)")
    e.catalog.get("p").foreign_keys.append(__import__("basalt.catalog", fromlist=["ForeignKey"]).ForeignKey("up", ["up"], "p", ["id"], "CASCADE"))
    e.sql("INSERT INTO p VALUES (1, NULL)")
    e.sql("INSERT INTO p VALUES (2, 1)")
    e.sql("INSERT INTO p VALUES (3, 2)")
    e.sql("UPDATE p SET up = 3 WHERE id = 1")  # a cycle
    e.sql("CREATE TABLE c (p INT REFERENCES p(id))")
    e.sql("INSERT INTO c VALUES (2)")
    with pytest.raises(ConstraintError):
        e.sql("DELETE FROM p WHERE id = 2")
    e.sql("TRUNCATE TABLE c")
    e.sql("DELETE FROM p WHERE id = 2")
    assert rows(e.sql("SELECT * FROM p")) == []


def test_transactions(db):
    other = db.session()
    db.sql("BEGIN")
    db.sql("DELETE FROM employees WHERE id = 1")
    assert db.sql("SELECT * FROM employees").count() == 2
    assert other.sql("SELECT * FROM employees").count() == 3
    db.sql("COMMIT")
    assert other.sql("SELECT * FROM employees").count() == 2
    other.sql("BEGIN ISOLATION LEVEL REPEATABLE READ")
    db.sql("INSERT INTO employees (dept) VALUES (1)")
    assert other.sql("SELECT * FROM employees").count() == 2
    other.sql("ROLLBACK")
    assert other.sql("SELECT * FROM employees").count() == 3


def test_read_committed_sees_each_commit(db):
    other = db.session()
    other.sql("BEGIN ISOLATION LEVEL READ COMMITTED")
    assert other.sql("SELECT * FROM employees").count() == 3
    db.sql("DELETE FROM employees WHERE id = 1")
    assert other.sql("SELECT * FROM employees").count() == 2


def test_serializable_conflict(db):
    other = db.session()
    other.sql("BEGIN ISOLATION LEVEL SERIALIZABLE")
    other.sql("UPDATE employees SET age = 1 WHERE id = 1")
    db.sql("UPDATE employees SET age = 2 WHERE id = 1")
    with pytest.raises(SerializationError):
        other.sql("COMMIT")
    assert rows(db.sql("SELECT age FROM employees WHERE id = 1")) == [(2,)]


def test_log_refuses_a_taken_version(db):
    table = db.tables["employees"]
    with pytest.raises(CommitConflict):
        table.commit(0, {"add": [], "remove": []})


def test_time_travel_history_and_vacuum(db):
    table = db.tables["employees"]
    at = table.version()
    db.sql("UPDATE employees SET name = 'z' WHERE id = 1")
    assert rows(table.snapshot(at).select("name")) == [("a",), ("b",), ("c",)]
    assert table.history().filter("_deleted IS NOT NULL").count() == 1
    done = db.sql("VACUUM employees").first()
    assert (done.rows_before, done.rows_removed, done.rows_after) == (4, 1, 3)
    assert rows(db.sql("SELECT name FROM employees")) == [("b",), ("c",), ("z",)]


def test_vacuum_leaves_open_snapshots(db):
    other = db.session()
    other.sql("BEGIN ISOLATION LEVEL REPEATABLE READ")
    db.sql("DELETE FROM employees")
    db.sql("VACUUM employees")
    assert other.sql("SELECT * FROM employees").count() == 3


def test_alter(db):
    db.sql("ALTER TABLE employees ADD COLUMN note TEXT DEFAULT 'n'")
    db.sql("INSERT INTO employees (dept, note) VALUES (1, NULL)")
    assert rows(db.sql("SELECT id, note FROM employees")) == [(1, "n"), (2, "n"), (3, "n"), (4, None)]
    db.sql("ALTER TABLE employees DROP COLUMN note")
    assert "note" not in db.sql("SELECT * FROM employees").columns


def test_indexes(db):
    db.sql("CREATE UNIQUE INDEX one ON employees USING BTREE (name) INCLUDE (age)")
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO employees (name, dept) VALUES ('a', 1)")
    assert db.layout("one").columns == ["name", "age"]
    db.sql("DROP INDEX one")
    db.sql("INSERT INTO employees (name, dept) VALUES ('a', 1)")
    with pytest.raises(ConstraintError):
        db.sql("CREATE UNIQUE INDEX one ON employees (name)")


def test_drop(db):
    with pytest.raises(ValueError):
        db.sql("DROP TABLE departments")
    db.sql("DROP TABLE employees")
    db.sql("DROP TABLE IF EXISTS employees")
    with pytest.raises(Exception):
        db.sql("SELECT * FROM employees").collect()


def test_prepared(db):
    db.sql("PREPARE q (INT) AS SELECT name FROM employees WHERE id = $1")
    assert rows(db.sql("EXECUTE q (2)")) == [("b",)]
    assert rows(db.run("q", (3,))) == [("c",)]
    with pytest.raises(ValueError):
        db.run("q")
    db.sql("DEALLOCATE q")
    with pytest.raises(KeyError):
        db.sql("EXECUTE q (1)")


@pytest.mark.parametrize("how", ["(FORMAT CSV, HEADER)", "(FORMAT TEXT)", "(FORMAT BINARY)", "(FORMAT CSV, DELIMITER '|')"])
def test_copy_round_trip(db, tmp_path, how):
    before = rows(db.sql("SELECT * FROM employees"))
    db.sql(f"COPY employees TO 'file://{tmp_path}/out' WITH {how}")
    db.sql("DELETE FROM employees")
    db.sql(f"COPY employees FROM 'file://{tmp_path}/out' WITH {how}")
    assert rows(db.sql("SELECT * FROM employees")) == before


def test_copy_fixtures(spark, folder, tmp_path):
    e = Engine(spark, folder)
    e.sql("CREATE TABLE people (id INTEGER, name VARCHAR(50), age INTEGER)")
    (tmp_path / "t").write_text("1\tJohn\t30\n2\tJa\\tne\t25\n3\t\\N\t\\N\n\\.\n")
    e.sql(f"COPY people FROM 'file://{tmp_path}/t'")
    assert rows(e.sql("SELECT * FROM people")) == [(1, "John", 30), (2, "Ja\tne", 25), (3, None, None)]
    e.sql("CREATE TABLE flags (id INTEGER, name VARCHAR(50), active BOOLEAN)")
    (tmp_path / "c").write_text("id,name,active\n1,Alice,true\n2,Bob,false\n3,Charlie,\n")
    e.sql(f"COPY flags FROM 'file://{tmp_path}/c' (FORMAT CSV, HEADER)")
    assert rows(e.sql("SELECT * FROM flags")) == [(1, "Alice", True), (2, "Bob", False), (3, "Charlie", None)]


def test_explain_analyze_statistics(db):
    plan = [r.plan for r in db.sql("EXPLAIN ANALYZE SELECT count(*) FROM employees").collect()]
    assert plan[0].startswith("Rows: 1") and any("HashAggregate" in p for p in plan)
    got = {r.column_name: r for r in db.sql("ANALYZE employees (id, age)").collect()}
    assert (got["age"].null_count, got["id"].distinct_count, got["id"].max_value) == (1, 3, "3")


def test_semantics(db):
    one = db.sql("SELECT DATE '2020-01-31' + INTERVAL '1 month' AS d, 7 / 2 AS h, 1 IN (2, NULL) AS n, (SELECT age FROM employees WHERE id = 99) AS s").first()
    assert (one.d, one.h, one.n, one.s) == (datetime.date(2020, 2, 29), 3.5, None, None)
    assert rows(db.sql("SELECT id FROM employees e WHERE EXISTS (SELECT 1 FROM departments d WHERE d.id = e.dept AND d.name = 'hr')")) == [(3,)]
    with pytest.raises(Exception):
        db.sql("SELECT (SELECT id FROM employees)").collect()


def test_result_cache_follows_changes(db):
    assert db.cached("SELECT count(*) AS n FROM employees").first().n == 3
    db.cached("SELECT count(*) AS n FROM employees")
    assert db.results.stats.hits == 1
    db.sql("DELETE FROM employees WHERE id = 1")
    assert db.cached("SELECT count(*) AS n FROM employees").first().n == 2


def test_rows_of_one_transaction_have_keys_of_their_own(db):
    db.sql("CREATE TABLE t (id INT PRIMARY KEY, v INT)")
    for text in ("BEGIN", "INSERT INTO t VALUES (1, 10)", "INSERT INTO t VALUES (2, 20)", "COMMIT", "DELETE FROM t WHERE id = 1"):
        db.sql(text)
    assert rows(db.sql("SELECT * FROM t")) == [(2, 20)]
    for text in ("BEGIN", "INSERT INTO t VALUES (3, 10)", "UPDATE t SET v = 11 WHERE id = 3"):
        db.sql(text)
    assert rows(db.sql("SELECT * FROM t")) == [(2, 20), (3, 11)]
    db.sql("COMMIT")
    assert rows(db.sql("SELECT * FROM t")) == [(2, 20), (3, 11)]


def two_writers(db, first, second, level="READ COMMITTED"):
    other = db.session()
    for e, text in ((db, first), (other, second)):
        e.sql(f"BEGIN ISOLATION LEVEL {level}")
        e.sql(text)
    db.sql("COMMIT")
    other.sql("COMMIT")


@pytest.mark.parametrize("level", ["READ COMMITTED", "REPEATABLE READ", "SERIALIZABLE"])
def test_two_writers_of_one_row(db, level):
    with pytest.raises(SerializationError):
        two_writers(db, "UPDATE employees SET age = 1 WHERE id = 1", "UPDATE employees SET age = 2 WHERE id = 1", level)
    assert rows(db.sql("SELECT age FROM employees WHERE id = 1")) == [(1,)]


def test_two_writers_of_different_rows(db):
    two_writers(db, "UPDATE employees SET age = 1 WHERE id = 1", "DELETE FROM employees WHERE id = 2")
    assert rows(db.sql("SELECT id, age FROM employees")) == [(1, 1), (3, None)]


@pytest.mark.parametrize(
    ("first", "second"),
    [
        ("INSERT INTO departments VALUES (9, 'a')", "INSERT INTO departments VALUES (9, 'b')"),
        ("DELETE FROM departments WHERE id = 2", "INSERT INTO employees (dept) VALUES (2)"),
        ("INSERT INTO employees (dept) VALUES (2)", "UPDATE departments SET id = 8 WHERE id = 2"),
    ],
)
def test_constraints_hold_at_commit(db, first, second):
    db.sql("DELETE FROM employees")
    with pytest.raises(ConstraintError):
        two_writers(db, first, second)
    assert rows(db.sql("SELECT dept FROM employees WHERE dept NOT IN (SELECT id FROM departments)")) == []
    assert rows(db.sql("SELECT id FROM departments GROUP BY id HAVING count(*) > 1")) == []


def test_serializable_checks_what_was_read(db):
    other = db.session()
    other.sql("BEGIN ISOLATION LEVEL SERIALIZABLE")
    other.sql("SELECT count(*) FROM employees")
    other.sql("INSERT INTO departments VALUES (5, 'x')")
    db.sql("INSERT INTO employees (dept) VALUES (1)")
    with pytest.raises(SerializationError):
        other.sql("COMMIT")


def test_a_failing_statement_leaves_the_transaction(db):
    db.sql("BEGIN")
    db.sql("INSERT INTO departments VALUES (5, 'x')")
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO departments VALUES (5, 'y')")
    db.sql("COMMIT")
    assert rows(db.sql("SELECT * FROM departments WHERE id = 5")) == [(5, "x")]


def test_a_crash_between_tables_leaves_nothing(db):
    from basalt.sources.versioned import LogStore

    db.sql("BEGIN")
    db.sql("DELETE FROM departments WHERE id = 1")  # cascades
    staged = db.transaction.staged
    assert set(staged) == {"departments", "employees"}
    entry = {k: staged["employees"][k] for k in ("add", "remove")} | {"txn": "crashed", "home": f"{db.folder}/transactions"}
    db.tables["employees"].commit(db.tables["employees"].tip(), entry)
    db.sql("ROLLBACK")
    assert db.sql("SELECT * FROM employees").count() == 3
    db.sql("UPDATE employees SET age = 50 WHERE id = 1")  # the writer behind it aborts it
    assert rows(db.sql("SELECT id, age FROM employees")) == [(1, 50), (2, 40), (3, None)]
    assert not LogStore(db.spark, f"{db.folder}/transactions").create("crashed", "committed")


@pytest.mark.parametrize(("action", "left"), [("CASCADE", [(1, 7)]), ("SET NULL", [(1, None)]), ("SET DEFAULT", [(1, 2)])])
def test_update_actions(spark, folder, action, left):
    e = Engine(spark, folder)
    e.sql("CREATE TABLE p (id INT PRIMARY KEY)")
    e.sql(f"CREATE TABLE c (id INT, p INT DEFAULT 2, FOREIGN KEY (p) REFERENCES p (id) ON DELETE CASCADE ON UPDATE {action})")
    e.sql("INSERT INTO p VALUES (1), (2)")
    e.sql("INSERT INTO c VALUES (1, 1)")
    e.sql("UPDATE p SET id = 7 WHERE id = 1")
    assert rows(e.sql("SELECT id, p FROM c")) == left
    assert rows(e.sql("SELECT id FROM p")) == [(2,), (7,)]


def test_vacuum_collects_what_it_had_to_keep(db):
    other = db.session()
    other.sql("BEGIN ISOLATION LEVEL REPEATABLE READ")
    db.sql("DELETE FROM employees WHERE id = 1")
    db.sql("VACUUM employees")
    assert other.sql("SELECT * FROM employees").count() == 3
    other.sql("ROLLBACK")
    db.sql("VACUUM employees")
    log = db.tables["employees"].log
    assert len(list(log.fs.listStatus(log.jvm.org.apache.hadoop.fs.Path(f"{db.tables['employees'].folder}/data")))) == 1
    assert db.tables["employees"].history().count() == 2


def test_explain_of_changes(db):
    plan = [r.plan for r in db.sql("EXPLAIN DELETE FROM employees WHERE age > 30").collect()]
    assert plan[0] == "Delete on employees" and any("Filter" in p for p in plan)
    assert db.sql("SELECT * FROM employees").count() == 3
    plan = [r.plan for r in db.sql("EXPLAIN ANALYZE INSERT INTO employees (dept) SELECT id FROM departments").collect()]
    assert plan[0].startswith("Rows: 2") and db.sql("SELECT * FROM employees").count() == 5


def test_partial_unique_index(db):
    db.sql("CREATE UNIQUE INDEX some ON employees (name) WHERE age > 10")
    db.sql("INSERT INTO employees (name, dept, age) VALUES ('a', 1, 5)")
    with pytest.raises(ConstraintError):
        db.sql("INSERT INTO employees (name, dept, age) VALUES ('a', 1, 50)")
