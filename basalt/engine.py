"""The engine: SQL statements over versioned tables and views.

Queries go to Catalyst as they are, after the dialect's rewrites; statements
that Spark has no counterpart for on plain files (UPDATE, DELETE, constraints,
transactions, COPY, prepared statements) are carried out here with DataFrames.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import islice
from operator import and_, or_
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt import constraints, dialect, stats
from basalt.cache import PlanCache, ResultCache
from basalt.catalog import Catalog, Column, ForeignKey, Index, Table
from basalt.dialect import Token, find, render, split_at, to_spark, tokens, unquote
from basalt.sources import copy as files
from basalt.sources.versioned import ROW_KEY, SYSTEM, CommitConflict, LogStore, VersionedTable
from basalt.types import SERIALS, spark_type, stored_type

WRITE_ATTEMPTS, COMMIT_ATTEMPTS = 5, 20
LEVELS = {"READ UNCOMMITTED", "READ COMMITTED", "REPEATABLE READ", "SERIALIZABLE"}


class SerializationError(RuntimeError):
    """Concurrent transactions changed the same rows (or, when serializable, tables)."""


@dataclass
class Transaction:
    """Snapshot versions and staged changes of an open transaction."""

    level: str
    versions: dict[str, int]  # at BEGIN
    staged: dict[str, dict[str, Any]] = field(default_factory=dict)  # table -> add, remove: folders; base: version they were made at
    seen: dict[str, int] = field(default_factory=dict)  # versions that the current statement reads
    read: dict[str, int] = field(default_factory=dict)  # earliest version read of each table

    @property
    def fixed(self) -> bool:
        return self.level in ("REPEATABLE READ", "SERIALIZABLE")


@dataclass
class Prepared:
    text: str
    statement: list[Token]
    types: list[str]


class Portal:
    """A bound statement whose rows are fetched in parts; Spark sends one
    partition at a time."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self._left = None

    def describe(self) -> list[tuple[str, str]]:
        return self.rows.dtypes

    def fetch(self, n: int | None = None) -> list[Any]:
        """The next ``n`` rows, or all that are left."""
        if self._left is None:
            self._left = self.rows.toLocalIterator()
        return list(self._left if n is None else islice(self._left, n))


class Engine:
    """A database in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.catalog = Catalog()
        self.tables: dict[str, VersionedTable] = {}
        self.views: dict[str, DataFrame] = {}
        self.prepared: dict[str, Prepared] = {}
        self.plans, self.results = PlanCache(), ResultCache()
        self.statistics: dict[str, DataFrame] = {}
        self.transaction: Transaction | None = None
        self.open: list[Transaction] = []

    # ---- sessions on the same database ----

    def session(self) -> Engine:
        """Another connection: same tables, its own transaction and statements."""
        other = Engine(self.spark, self.folder)
        other.catalog, other.tables, other.views, other.open = self.catalog, self.tables, self.views, self.open
        return other

    def register(self, name: str, rows: DataFrame) -> None:
        """Makes a DataFrame readable under a name."""
        self.views[self.catalog.key(name)] = rows

    # ---- reading ----

    def _version(self, key: str) -> int:
        """The version of a table that the current statement reads: one for a
        statement, and in fixed snapshots one for the transaction."""
        t = self.transaction
        if key not in t.seen:
            t.seen[key] = t.versions[key] if t.fixed and key in t.versions else self.tables[key].version()
        t.read.setdefault(key, t.seen[key])
        return t.seen[key]

    def snapshot(self, name: str, keys: bool = False) -> DataFrame:
        """Rows of a table as the current statement sees them."""
        key = self.catalog.key(name)
        if not self.transaction:
            return self.tables[key].snapshot(None, None, keys)
        return self.tables[key].snapshot(self._version(key), self.transaction.staged.get(key), keys)

    def _bind(self, ts: list[Token], as_of: dict[str, int] | None = None) -> frozenset[str]:
        """Creates the views that a query's words name; returns the tables among them."""
        words = {self.catalog.key(unquote(t)) for t in ts if t.kind in ("word", "quoted", "tick")}
        used = []
        for key in words & {*self.tables, *self.views, "plan_cache_stats"}:
            if key in self.tables:
                rows = self.tables[key].snapshot(as_of[key]) if as_of and key in as_of else self.snapshot(key)
                used.append(key)
            else:
                rows = self.views[key] if key in self.views else self.plans.view(self.spark)
            rows.createOrReplaceTempView(key)
        return frozenset(used)

    def query(self, sql: str | list[Token], params: list[Any] | tuple = (), as_of: dict[str, int] | None = None) -> DataFrame:
        ts = tokens(sql) if isinstance(sql, str) else sql
        text = self.plans.get(tuple(t.text for t in ts), lambda: to_spark(ts))
        self._bind(ts, as_of)
        args = {f"p{i}": v for i, v in enumerate(params, 1) if f":p{i}" in text}
        return self.spark.sql(text, args=args) if args else self.spark.sql(text)

    def cached(self, sql: str) -> DataFrame:
        """A query's result from the result cache, while its tables are unchanged."""
        ts = tokens(sql)
        names = {self.catalog.key(unquote(t)) for t in ts if t.kind in ("word", "quoted")} & set(self.tables)
        key = (tuple(t.text for t in ts), tuple(sorted((n, self.tables[n].version()) for n in names)))
        return self.results.get(key, frozenset(names), lambda: self.query(ts))

    # ---- statements ----

    def sql(self, text: str, params: list[Any] | tuple = ()) -> DataFrame:
        """Runs a statement; statements without rows return their row count."""
        return self.execute(tokens(text), params)

    def execute(self, ts: list[Token], params: list[Any] | tuple = ()) -> DataFrame:
        if not ts:
            raise ValueError("empty statement")
        head = [t.text.upper() for t in ts[:3]] + ["", ""]
        if self.transaction and not self.transaction.fixed:
            self.transaction.seen = {}  # every statement reads what is committed by now
        if head[0] in ("SELECT", "WITH", "VALUES", "("):
            return self.query(ts, params)
        handlers = {
            ("CREATE", "TABLE"): self._create_table, ("DROP", "TABLE"): self._drop_table, ("ALTER", "TABLE"): self._alter_table, ("CREATE", "INDEX"): self._create_index,
            ("CREATE", "UNIQUE"): self._create_index, ("DROP", "INDEX"): self._drop_index,
        }
        if handler := handlers.get((head[0], head[1])):
            self.plans.clear()
            return handler(ts)
        single = {
            "INSERT": lambda: self._write(self._insert, ts, params), "UPDATE": lambda: self._write(self._update, ts, params),
            "DELETE": lambda: self._write(self._delete, ts, params), "TRUNCATE": lambda: self._write(self._truncate, ts), "COPY": lambda: self._write(self._copy, ts), "ANALYZE": lambda: self._analyze(ts), "VACUUM": lambda: self._vacuum(ts), "PREPARE": lambda: self._prepare(ts),
            "EXECUTE": lambda: self._execute(ts), "DEALLOCATE": lambda: self._deallocate(ts), "EXPLAIN": lambda: self._explain(ts, params),
            "BEGIN": lambda: self._begin(ts), "START": lambda: self._begin(ts), "COMMIT": self._commit, "END": self._commit, "ROLLBACK": self._rollback,
        }
        if head[0] not in single:
            raise ValueError(f"unsupported statement {head[0]}")
        return single[head[0]]()

    def _done(self, what: str, n: int = 0) -> DataFrame:
        return self.spark.createDataFrame([(what, n)], "status string, rows bigint")

    # ---- transactions ----

    def _begin(self, ts: list[Token]) -> DataFrame:
        words = " ".join(t.text.upper() for t in ts)
        level = next((x for x in sorted(LEVELS) if x in words), "READ COMMITTED")
        if self.transaction:
            raise RuntimeError("a transaction is open already")
        self._start(level)
        return self._done("BEGIN")

    def _start(self, level: str) -> None:
        self.transaction = Transaction(level, {k: t.version() for k, t in self.tables.items()})
        self.open.append(self.transaction)

    def _write(self, statement: Callable, *args) -> DataFrame:
        """Runs a statement that changes tables: all of it or nothing.

        Outside a transaction it is one of its own, and runs again on what is
        committed by then if another writer changed the same rows meanwhile.
        """
        if t := self.transaction:
            before = {k: v | {"add": [*v["add"]], "remove": [*v["remove"]]} for k, v in t.staged.items()}
            try:
                return statement(*args)
            except Exception:
                t.staged = before
                raise
        for left in reversed(range(WRITE_ATTEMPTS)):
            self._start("READ COMMITTED")
            try:
                out = statement(*args)
                self._commit()
                return out
            except SerializationError:
                if not left:
                    raise
            finally:
                self._close()
        raise AssertionError("not reached")

    def _commit(self) -> DataFrame:
        """Checks the staged changes against what was committed meanwhile, and
        makes them visible at once.

        A row that another transaction removed or updated since it was read is
        a conflict, at every level.  Constraints are checked again where a table
        that they involve has moved on.  Serializable transactions that write
        also need every table that they read to be as it was.
        """
        t = self._close()
        staged = {k: v for k, v in t.staged.items() if v["add"] or v["remove"]} if t else {}
        if not staged:
            return self._done("COMMIT")
        for _ in range(COMMIT_ATTEMPTS):
            tips = {k: self.tables[k].tip() for k in staged}
            self._check(t, staged)
            if len(staged) == 1:
                ((key, entry),) = staged.items()
                made = self._try(key, tips, {"add": entry["add"], "remove": entry["remove"]})
            else:
                home, name = f"{self.folder}/transactions", uuid.uuid4().hex
                made = all(self._try(k, tips, {"add": e["add"], "remove": e["remove"], "txn": name, "home": home}) for k, e in sorted(staged.items()))
                made = LogStore(self.spark, home).create(name, "committed" if made else "aborted") and made
            if made:
                for key in staged:
                    self.results.invalidate(key)
                return self._done("COMMIT")
        raise CommitConflict(f"too many writers on {', '.join(staged)}")

    def _try(self, key: str, tips: dict[str, int], entry: dict) -> bool:
        try:
            self.tables[key].commit(tips[key], entry)
        except CommitConflict:
            return False
        return True

    def _check(self, t: Transaction, staged: dict[str, dict]) -> None:
        """Raises if staged changes cannot follow what is committed by now."""
        now = {k: table.version() for k, table in self.tables.items()}
        for key in t.read if t.level == "SERIALIZABLE" else ():
            if now.get(key) != t.read[key]:
                raise SerializationError(f"could not serialize access to {key}")
        for key, entry in staged.items():
            if key not in self.tables:
                raise SerializationError(f"table {key} was dropped")
            table = self.tables[key]
            theirs = table.removed_since(entry["base"]) if entry["remove"] else []
            if theirs and not table.keys(entry["remove"]).join(table.keys(theirs), list(ROW_KEY), "left_semi").isEmpty():
                raise SerializationError(f"could not serialize access to {key}: a concurrent change")
        moved = {k for k, v in now.items() if v != t.read.get(k, v)}
        final = lambda name: self.tables[self.catalog.key(name)].snapshot(None, staged.get(self.catalog.key(name)))
        for key, entry in staged.items():
            meta, table = self.catalog.get(key), self.tables[key]
            near = {key, *(self.catalog.key(fk.parent) for fk in meta.foreign_keys)}
            if entry["add"] and moved & near:
                rows = table.rows(entry["add"], entry["remove"], table.schema()).select(*meta.names)
                constraints.validate(meta, rows, final(key), final, self.catalog)
            for child, fk in self.catalog.children(key) if entry["remove"] else ():
                if moved & {key, self.catalog.key(child.name)}:
                    gone = table.rows(table._live(None)[0] + entry["add"], [], table.schema()).join(table.keys(entry["remove"]), list(ROW_KEY), "left_semi")
                    touched = constraints.referring(final(child.name), gone, fk)
                    if not constraints.foreign_key_violations(touched, final(key), fk.columns, fk.parent_columns).isEmpty():
                        raise constraints.ConstraintError(f"foreign key {fk.name} of table {child.name} is violated")

    def _rollback(self) -> DataFrame:
        self._close()
        return self._done("ROLLBACK")

    def _close(self) -> Transaction | None:
        t, self.transaction = self.transaction, None
        if t in self.open:
            self.open.remove(t)
        return t

    def _change(self, name: str, add: list[DataFrame] = (), remove: list[DataFrame] = ()) -> None:
        """Stages rows to add and keys to remove in the open transaction."""
        key = self.catalog.key(name)
        table = self.tables[key]
        entry = self.transaction.staged.setdefault(key, {"add": [], "remove": [], "base": self._version(key)})
        entry["add"] = entry["add"] + [table.stage_rows(a) for a in add]
        entry["remove"] = entry["remove"] + [table.stage_deletes(r) for r in remove]

    # ---- definitions ----

    def _create_table(self, ts: list[Token]) -> DataFrame:
        at = 2 + 3 * (ts[2].is_("IF"))
        name = unquote(ts[at])
        if at > 2 and self.catalog.key(name) in self.tables:
            return self._done("CREATE TABLE")
        table = Table(name, [])
        for part in split_at(ts[at + 2 : -1]):
            if part[0].is_("CONSTRAINT"):
                self._table_constraint(table, part[2:], unquote(part[1]))
            elif part[0].is_("PRIMARY", "UNIQUE", "FOREIGN", "CHECK"):
                self._table_constraint(table, part, None)
            else:
                self._column(table, part)
        for c in table.primary_key:
            table.column(c).nullable = False
        self.catalog.add(table)
        fields = [T.StructField(c.name, stored_type(c.type), True) for c in table.columns]
        key = self.catalog.key(name)
        self.tables[key] = VersionedTable.create(self.spark, f"{self.folder}/{key}-{uuid.uuid4().hex[:8]}", T.StructType(fields))
        return self._done("CREATE TABLE")

    def _column(self, table: Table, part: list[Token]) -> None:
        end = find(part, "NOT", "NULL", "DEFAULT", "PRIMARY", "UNIQUE", "CHECK", "REFERENCES", start=1)
        kind = render(part[1:end])
        column = Column(unquote(part[0]), spark_type(kind), serial=kind.upper() in SERIALS)
        column.nullable = not column.serial
        table.columns.append(column)
        i = end
        while i < len(part):
            t = part[i]
            if t.is_("NOT"):
                column.nullable, i = False, i + 2
            elif t.is_("NULL"):
                i += 1
            elif t.is_("DEFAULT"):
                stop = find(part, "NOT", "NULL", "PRIMARY", "UNIQUE", "CHECK", "REFERENCES", start=i + 2)
                column.default, i = to_spark(part[i + 1 : stop]), stop
            elif t.is_("PRIMARY"):
                table.primary_key, i = [column.name], i + 2
            elif t.is_("UNIQUE"):
                table.unique.append([column.name])
                i += 1
            elif t.is_("CHECK"):
                end = dialect._match(part, i + 1)
                table.checks[f"{table.name}_{column.name}_check"] = to_spark(part[i + 2 : end])
                i = end + 1
            else:  # REFERENCES
                i = self._references(table, part, i, [column.name], None)

    def _table_constraint(self, table: Table, part: list[Token], name: str | None) -> None:
        names = lambda at: [unquote(x[0]) for x in split_at(part[at + 1 : dialect._match(part, at)])]
        if part[0].is_("PRIMARY"):
            table.primary_key = names(2)
        elif part[0].is_("UNIQUE"):
            table.unique.append(names(1))
        elif part[0].is_("CHECK"):
            table.checks[name or f"{table.name}_check{len(table.checks) + 1}"] = to_spark(part[2 : dialect._match(part, 1)])
        else:
            columns = names(2)
            self._references(table, part, dialect._match(part, 2) + 1, columns, name)

    def _references(self, table: Table, part: list[Token], at: int, columns: list[str], name: str | None) -> int:
        parent = unquote(part[at + 1])
        i = at + 2
        targets: list[str] = []
        if i < len(part) and part[i].text == "(":
            end = dialect._match(part, i)
            targets, i = [unquote(x[0]) for x in split_at(part[i + 1 : end])], end + 1
        actions = {"DELETE": "NO ACTION", "UPDATE": "NO ACTION"}
        while i < len(part) and part[i].is_("ON"):
            two = part[i + 2].is_("SET", "NO")
            said = " ".join(t.text.upper() for t in part[i + 2 : i + 3 + two])
            actions[part[i + 1].text.upper()] = said
            i += 3 + two
        targets = targets or self.catalog.get(parent).primary_key
        table.foreign_keys.append(ForeignKey(name or f"{table.name}_{columns[0]}_fkey", columns, parent, targets, actions["DELETE"], actions["UPDATE"]))
        return i

    def _drop_table(self, ts: list[Token]) -> DataFrame:
        optional = ts[2].is_("IF")
        name = unquote(ts[4 if optional else 2])
        key = self.catalog.key(name)
        if optional and key not in self.tables:
            return self._done("DROP TABLE")
        self.catalog.drop(name)
        self.results.invalidate(key)
        self.spark.catalog.dropTempView(key)
        del self.tables[key]
        return self._done("DROP TABLE")

    def _alter_table(self, ts: list[Token]) -> DataFrame:
        table = self.catalog.get(unquote(ts[2]))
        stored = self.tables[self.catalog.key(table.name)]
        base = stored.tip()
        schema = stored.schema()
        rest = ts[5:] if ts[4].is_("COLUMN") else ts[4:]
        if ts[3].is_("ADD"):
            probe = Table(table.name, [])
            self._column(probe, rest)
            new = probe.columns[0]
            if new.name.lower() in (c.lower() for c in table.names):
                raise ValueError(f"column {new.name} already exists")
            if not new.nullable and new.default is None and not stored.snapshot().isEmpty():
                raise constraints.ConstraintError(f"column {new.name} would be NULL in existing rows")
            meta = {"added": base + 1} | ({"default": new.default} if new.default else {})
            schema = schema.add(T.StructField(new.name, stored_type(new.type), True, meta))
            table.columns.append(new)
            table.checks |= probe.checks
        elif ts[3].is_("DROP"):
            column = table.column(unquote(rest[0]))
            if len(table.columns) == 1:
                raise ValueError("the last column cannot be dropped")
            table.columns.remove(column)
            schema = T.StructType([f for f in schema.fields if f.name != column.name])
        else:
            raise ValueError("ALTER TABLE takes ADD or DROP")
        stored.commit(base, {"schema": json.loads(schema.json()), "add": [], "remove": []})
        self.results.invalidate(self.catalog.key(table.name))
        return self._done("ALTER TABLE")

    def _create_index(self, ts: list[Token]) -> DataFrame:
        """Indexes are advice: a unique one is a constraint, and all of them
        tell ``layout`` how rows should lie.  They never change a result."""
        unique = ts[1].is_("UNIQUE")
        at = 2 + unique
        at += 3 * ts[at].is_("IF")
        name, on = unquote(ts[at]), find(ts, "ON")
        table = self.catalog.get(unquote(ts[on + 1]))
        i = on + 2
        if ts[i].is_("USING"):
            if not ts[i + 1].is_("BTREE", "HASH"):
                raise ValueError(f"unknown index method {ts[i + 1].text}")
            i += 2
        end = dialect._match(ts, i)
        columns = [table.column(unquote(p[0])).name for p in split_at(ts[i + 1 : end])]
        include, where, i = [], None, end + 1
        while i < len(ts):
            if ts[i].is_("INCLUDE"):
                stop = dialect._match(ts, i + 1)
                include, i = [table.column(unquote(p[0])).name for p in split_at(ts[i + 2 : stop])], stop + 1
            elif ts[i].is_("USING"):
                i += 2
            elif ts[i].is_("WHERE"):
                where, i = to_spark(ts[i + 1 :]), len(ts)
            else:
                raise ValueError(f"cannot read {ts[i].text} in CREATE INDEX")
        if name.lower() in self.catalog.indexes:
            raise ValueError(f"index {name} already exists")
        rows = self.snapshot(table.name)
        if unique and not constraints.unique_violations(rows.filter(where) if where else rows, columns).isEmpty():
            raise constraints.ConstraintError(f"index {name} would not be unique")
        self.catalog.indexes[name.lower()] = Index(name, table.name, columns, unique, include, where)
        return self._done("CREATE INDEX")

    def _drop_index(self, ts: list[Token]) -> DataFrame:
        at = 2 + 2 * ts[2].is_("IF")
        if self.catalog.indexes.pop(unquote(ts[at]).lower(), None) is None and at == 2:
            raise KeyError(f"index {unquote(ts[at])} does not exist")
        return self._done("DROP INDEX")

    def layout(self, index: str) -> DataFrame:
        """The table's rows laid out by an index: ranges of its columns in
        partitions of their own, sorted, with the columns it covers only if it
        includes any.  Written as Parquet, its footers then prune row groups."""
        i = self.catalog.indexes[index.lower()]
        rows = self.snapshot(i.table)
        rows = rows.filter(i.where) if i.where else rows
        rows = rows.select(*i.columns, *i.include) if i.include else rows
        return rows.repartitionByRange(*i.columns).sortWithinPartitions(*i.columns)

    # ---- changes ----

    def _returning(self, ts: list[Token], rows: DataFrame) -> tuple[list[Token], list[Token]]:
        at = find(ts, "RETURNING")
        return ts[:at], ts[at + 1 :]

    def _result(self, rows: DataFrame, wanted: list[Token], what: str, n: int) -> DataFrame:
        if not wanted:
            return self._done(what, n)
        name = f"returning_{uuid.uuid4().hex[:8]}"
        rows.createOrReplaceTempView(name)
        return self.spark.sql(f"SELECT {to_spark(wanted)} FROM {name}")

    def _insert(self, ts: list[Token], params: list[Any] | tuple) -> DataFrame:
        ts, wanted = self._returning(ts, None)
        table = self.catalog.get(unquote(ts[2]))
        i, columns = 3, table.names
        if ts[3].text == "(" and not ts[4].is_("SELECT", "WITH", "VALUES"):
            end = dialect._match(ts, 3)
            columns, i = [table.column(unquote(p[0])).name for p in split_at(ts[4:end])], end + 1
        source = self.query(ts[i:], params)
        if len(source.columns) != len(columns):
            raise ValueError(f"INSERT has {len(columns)} columns and {len(source.columns)} values")
        # Written once, so that what is checked is what is stored.
        place = self._scratch(source.toDF(*[f"c{k}" for k in range(len(columns))]).withColumns({"_p": F.spark_partition_id(), "_n": F.monotonically_increasing_id()}))
        given = {c: F.col(f"c{k}") for k, c in enumerate(columns)}
        rows = self._complete(table, place, given)
        n = rows.count()
        whole = self.snapshot(table.name).unionByName(rows)
        constraints.validate(table, rows, whole, self.snapshot, self.catalog)
        self._change(table.name, add=[rows])
        return self._result(rows, wanted, "INSERT", n)

    def _complete(self, table: Table, rows: DataFrame, given: dict[str, Any]) -> DataFrame:
        """All columns of a table from the given ones, defaults and serials."""
        out = []
        for c in table.columns:
            kind = stored_type(c.type)
            if c.name in given:
                value = given[c.name]
            elif c.serial:
                top = self.snapshot(table.name).agg(F.coalesce(F.max(c.name), F.lit(0)).alias("top")).first()["top"]
                # numbers run on from partition to partition, without gathering rows in one task
                before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
                starts = rows.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
                rows = rows.join(starts, "_p")
                value = F.row_number().over(Window.partitionBy("_p").orderBy("_n")) + F.col("_start") + F.lit(top)
            else:
                value = F.expr(c.default) if c.default else F.lit(None)
            value = value.cast(kind)
            if isinstance(c.type, T.VarcharType):
                value = F.when(F.length(value) <= c.type.length, value).when(value.isNotNull(), F.raise_error(F.lit(f"value too long for column {c.name}")).cast("string"))
            out.append(value.alias(c.name))
        return rows.select(*out)

    def _scratch(self, rows: DataFrame) -> DataFrame:
        path = f"{self.folder}/scratch/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _matching(self, table: Table, where: list[Token], params: list[Any] | tuple) -> DataFrame:
        """Rows, with their keys, for which a condition is true."""
        rows = self.snapshot(table.name, keys=True)
        key = self.catalog.key(table.name)
        self._bind(where)
        rows.createOrReplaceTempView(key)
        if not where:
            return rows
        args = {f"p{i}": v for i, v in enumerate(params, 1)}
        text = f"SELECT * FROM {key} WHERE {to_spark(where)}"
        args = {k: v for k, v in args.items() if f":{k}" in text}
        return self.spark.sql(text, args=args) if args else self.spark.sql(text)

    def _update(self, ts: list[Token], params: list[Any] | tuple) -> DataFrame:
        ts, wanted = self._returning(ts, None)
        table = self.catalog.get(unquote(ts[1]))
        at = find(ts, "WHERE")
        hit = self._matching(table, ts[at + 1 :], params)
        key = self.catalog.key(table.name)
        updates = {}
        for part in split_at(ts[3:at]):
            updates[table.column(unquote(part[0])).name] = to_spark(part[2:])
        hit.createOrReplaceTempView(f"{key}__hit")
        self._bind([t for t in ts[3:at] if self.catalog.key(unquote(t)) != key])
        shown = [f"CAST({updates[c.name]} AS {stored_type(c.type).simpleString()}) AS `{c.name}`" if c.name in updates else f"{key}.`{c.name}`" for c in table.columns]
        shown += [f"{key}.{k}" for k in ROW_KEY] + [f"{key}.`{c}` AS `_old_{i}`" for i, c in enumerate(table.names)]
        text = f"SELECT {', '.join(shown)} FROM {key}__hit AS {key}"
        args = {f"p{i}": v for i, v in enumerate(params, 1) if f":p{i}" in text}
        new = self._scratch(self.spark.sql(text, args=args) if args else self.spark.sql(text))
        n = new.count()
        if n:
            self._replace(table, new, set(updates))
        return self._result(new.select(*table.names), wanted, "UPDATE", n)

    def _replace(self, table: Table, new: DataFrame, updated: set[str]) -> None:
        """Stages new versions of rows (with ``_old_i`` values and row keys), after
        checks, and carries out the actions of foreign keys that refer to them."""
        keys, rows = new.select(*ROW_KEY), new.select(*table.names)
        left = self.snapshot(table.name, keys=True).join(keys, list(ROW_KEY), "left_anti").select(*table.names)
        follow = [(child, fk) for child, fk in self.catalog.children(table.name) if set(fk.parent_columns) & updated]
        itself = [fk for child, fk in follow if child.name == table.name]
        if itself and any(fk.on_update not in ("NO ACTION", "RESTRICT") for fk in itself):
            raise constraints.ConstraintError(f"ON UPDATE {itself[0].on_update} of a table on itself is not carried out")
        whole = left.unionByName(rows)
        constraints.validate(table, rows, whole, lambda name: whole if self.catalog.key(name) == self.catalog.key(table.name) else self.snapshot(name), self.catalog)
        self._change(table.name, add=[rows], remove=[keys])
        for child, fk in follow:
            old = [F.col(f"_old_{table.names.index(c)}") for c in fk.parent_columns]
            changed = [~o.eqNullSafe(F.col(c)) for o, c in zip(old, fk.parent_columns)]
            moved = new.filter(reduce(or_, changed)).select(*[o.alias(f"_from_{i}") for i, o in enumerate(old)], *[F.col(c).alias(f"_to_{i}") for i, c in enumerate(fk.parent_columns)])
            # a key that another row has by now still has its parent
            held = self.snapshot(table.name).select(*[F.col(c).alias(f"_from_{i}") for i, c in enumerate(fk.parent_columns)])
            moved = moved.join(held, [f"_from_{i}" for i in range(len(old))], "left_anti")
            hit = self.snapshot(child.name, keys=True)
            hit = self._scratch(hit.join(moved, reduce(and_, [hit[c] == moved[f"_from_{i}"] for i, c in enumerate(fk.columns)])))
            if hit.isEmpty():
                continue
            if fk.on_update in ("NO ACTION", "RESTRICT"):
                raise constraints.ConstraintError(f"foreign key {fk.name} of table {child.name} forbids the update")
            fill = {
                "CASCADE": lambda c, i=fk.columns: F.col(f"_to_{i.index(c)}"), "SET NULL": lambda c: F.lit(None),
                "SET DEFAULT": lambda c: F.expr(child.column(c).default or "NULL"),
            }[fk.on_update]
            shown = [(fill(c.name).cast(stored_type(c.type)) if c.name in fk.columns else F.col(c.name)).alias(c.name) for c in child.columns]
            self._replace(child, hit.select(*shown, *ROW_KEY, *[F.col(c).alias(f"_old_{i}") for i, c in enumerate(child.names)]), set(fk.columns))

    def _delete(self, ts: list[Token], params: list[Any] | tuple) -> DataFrame:
        ts, wanted = self._returning(ts, None)
        table = self.catalog.get(unquote(ts[2]))
        at = find(ts, "WHERE")
        gone = self._scratch(self._matching(table, ts[at + 1 :], params))
        n = gone.count()
        follow = constraints.cascade(self.catalog, table.name, gone, lambda t: self.snapshot(t, keys=True))
        for child, action, rows, fk in follow:
            rows = self._scratch(rows)
            if action == "CASCADE":
                self._change(child, remove=[rows])
            else:
                other = self.catalog.get(child)
                fill = {c: F.expr(other.column(c).default or "NULL") if action == "SET DEFAULT" else F.lit(None) for c in fk.columns}
                new = rows.select(*[fill[c.name].cast(stored_type(c.type)).alias(c.name) if c.name in fill else F.col(c.name) for c in other.columns])
                constraints.validate(other, new, new, lambda t: self._without(t, table.name, gone), self.catalog)
                self._change(child, add=[new], remove=[rows])
        if n:
            self._change(table.name, remove=[gone])
        return self._result(gone.drop(*SYSTEM), wanted, "DELETE", n)

    def _without(self, name: str, table: str, gone: DataFrame) -> DataFrame:
        rows = self.snapshot(name, keys=True)
        if self.catalog.key(name) == self.catalog.key(table):
            rows = rows.join(gone.select(*ROW_KEY), list(ROW_KEY), "left_anti")
        return rows

    def _truncate(self, ts: list[Token]) -> DataFrame:
        name = unquote(ts[2] if ts[1].is_("TABLE") else ts[1])
        return self._delete(tokens(f'DELETE FROM "{name}"'), ())

    def _copy(self, ts: list[Token]) -> DataFrame:
        """COPY t [(columns)] FROM|TO 'path' [WITH] [(FORMAT x, HEADER, DELIMITER 'c')]."""
        table = self.catalog.get(unquote(ts[1]))
        i, columns = 2, table.names
        if ts[2].text == "(":
            end = dialect._match(ts, 2)
            columns, i = [table.column(unquote(p[0])).name for p in split_at(ts[3:end])], end + 1
        into = ts[i].is_("FROM")
        path = unquote(ts[i + 1])
        words = [t for t in ts[i + 2 :] if not t.is_("WITH") and t.text not in "(),"]
        said = [t.text.upper() if t.kind == "word" else unquote(t) for t in words]
        kind = next((k for k in ("CSV", "BINARY", "TEXT") if k in said), "TEXT")
        header = "HEADER" in said and said[min(said.index("HEADER") + 1, len(said) - 1)] not in ("FALSE", "OFF")
        mark = said[said.index("DELIMITER") + 1] if "DELIMITER" in said else {"CSV": ",", "TEXT": "\t"}.get(kind, "")
        schema = T.StructType([T.StructField(c, stored_type(table.column(c).type)) for c in columns])
        if not into:
            rows = self.snapshot(table.name).select(*columns)
            {"CSV": lambda: files.write_csv(rows, path, mark, header), "TEXT": lambda: files.write_text(rows, path, mark), "BINARY": lambda: files.write_binary(rows, path)}[kind]()
            return self._done("COPY", rows.count())
        read = {"CSV": lambda: files.read_csv(self.spark, path, schema, mark, header), "TEXT": lambda: files.read_text(self.spark, path, schema, mark), "BINARY": lambda: files.read_binary(self.spark, path, schema)}
        rows = read[kind]().withColumns({"_p": F.spark_partition_id(), "_n": F.monotonically_increasing_id()})
        rows = self._complete(table, self._scratch(rows), {c: F.col(c) for c in columns})
        constraints.validate(table, rows, self.snapshot(table.name).unionByName(rows), self.snapshot, self.catalog)
        self._change(table.name, add=[rows])
        return self._done("COPY", rows.count())

    # ---- utilities ----

    def _analyze(self, ts: list[Token]) -> DataFrame:
        at = 1 + (len(ts) > 1 and ts[1].is_("TABLE"))
        names = [unquote(ts[at])] if len(ts) > at else list(self.tables)
        columns = [unquote(p[0]) for p in split_at(ts[at + 2 : -1])] if len(ts) > at + 1 else None
        out = None
        for name in names:
            rows = self.snapshot(name) if self.catalog.key(name) in self.tables else self.views[self.catalog.key(name)]
            made = stats.column_statistics(rows, columns).withColumn("table_name", F.lit(name))
            self.statistics[self.catalog.key(name)] = made
            out = made if out is None else out.unionByName(made)
        return out if out is not None else self._done("ANALYZE")

    def _vacuum(self, ts: list[Token]) -> DataFrame:
        rest = [t for t in ts[1:] if not t.is_("ANALYZE", "TABLE")]
        rows = []
        for name in [unquote(rest[0])] if rest else list(self.tables):
            key = self.catalog.key(name)
            needed = [v for t in self.open for v in (t.versions.get(key), t.seen.get(key)) if v is not None]  # what open snapshots read
            done = self.tables[key].vacuum(needed)
            rows.append((name, done["rows_before"], done["rows_removed"], done["rows_after"], done["folders_before"], done["folders_after"]))
        if any(t.is_("ANALYZE") for t in ts):
            self._analyze([Token("word", "ANALYZE"), *rest])
        return self.spark.createDataFrame(rows, "table_name string, rows_before bigint, rows_removed bigint, rows_after bigint, folders_before bigint, folders_after bigint")

    def _prepare(self, ts: list[Token]) -> DataFrame:
        at = find(ts, "AS")
        types = [render(p) for p in split_at(ts[3 : at - 1])] if at > 2 and ts[2].text == "(" else []
        self.prepare(unquote(ts[1]), render(ts[at + 1 :]), ts[at + 1 :], types)
        return self._done("PREPARE")

    def prepare(self, name: str, text: str, statement: list[Token] | None = None, types: list[str] = ()) -> None:
        if name in self.prepared:
            raise ValueError(f"prepared statement {name} already exists")
        self.prepared[name] = Prepared(text, statement or tokens(text), list(types))

    def run(self, name: str, params: list[Any] | tuple = ()) -> DataFrame:
        """Binds parameters to a prepared statement and executes it."""
        p = self.prepared[name]
        wanted = max([int(t.text[1:]) for t in p.statement if t.kind == "param"], default=0)
        if len(params) < wanted:
            raise ValueError(f"statement {name} takes {wanted} parameters, not {len(params)}")
        return self.execute(p.statement, params)

    def bind(self, name: str, params: list[Any] | tuple = ()) -> Portal:
        """A portal over a prepared statement."""
        return Portal(self.run(name, params))

    def _execute(self, ts: list[Token]) -> DataFrame:
        name = unquote(ts[1])
        given = split_at(ts[3 : dialect._match(ts, 2)]) if len(ts) > 2 else []
        types = self.prepared[name].types
        shown = [f"CAST({to_spark(g)} AS {stored_type(spark_type(types[i])).simpleString()})" if i < len(types) else to_spark(g) for i, g in enumerate(given)]
        values = list(self.spark.sql(f"SELECT {', '.join(shown)}").first()) if shown else []
        return self.run(name, values)

    def _deallocate(self, ts: list[Token]) -> DataFrame:
        name = unquote(ts[-1])
        if name.upper() == "ALL":
            self.prepared.clear()
        elif self.prepared.pop(name, None) is None:
            raise KeyError(f"prepared statement {name} does not exist")
        return self._done("DEALLOCATE")

    def _explain(self, ts: list[Token], params: list[Any] | tuple) -> DataFrame:
        """EXPLAIN [ANALYZE] [VERBOSE] [(options)] statement: plan lines; with
        ANALYZE the statement runs first and its rows and time are told."""
        i, analyze, as_json, verbose = 1, False, False, False
        while ts[i].is_("ANALYZE", "VERBOSE") or ts[i].text == "(" and not ts[i + 1].is_("SELECT", "WITH"):
            if ts[i].text == "(":
                end = dialect._match(ts, i)
                words = {t.text.upper() for t in ts[i:end]}
                analyze, verbose, as_json, i = analyze or "ANALYZE" in words, verbose or "VERBOSE" in words, "JSON" in words, end + 1
            else:
                analyze, verbose, i = analyze or ts[i].is_("ANALYZE"), verbose or ts[i].is_("VERBOSE"), i + 1
        import time

        ts, lines, began = ts[i:], [], time.perf_counter()
        if ts[0].is_("INSERT", "UPDATE", "DELETE"):
            rows, what = self._source(ts, params)
            lines.append(what)
            if analyze:
                n = self.execute(ts, params).first()["rows"]
        else:
            rows = self.query(ts, params)
            if analyze:
                n = rows.count()
        if analyze:
            lines.insert(0, f"Rows: {n}; time: {(time.perf_counter() - began) * 1000:.1f} ms")
        execution = rows._jdf.queryExecution()
        plan = execution.explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended" if verbose else "formatted"))
        if as_json:
            return self.spark.createDataFrame([(execution.optimizedPlan().toJSON(),)], "plan string")
        return self.spark.createDataFrame([(x,) for x in [*lines, *plan.rstrip().split("\n")]], "plan string")

    def _source(self, ts: list[Token], params: list[Any] | tuple) -> tuple[DataFrame, str]:
        """The rows that a changing statement reads, and what it does with them."""
        ts = ts[: find(ts, "RETURNING")]
        name = unquote(ts[1] if ts[0].is_("UPDATE") else ts[2])
        if ts[0].is_("INSERT"):
            at = dialect._match(ts, 3) + 1 if ts[3].text == "(" and not ts[4].is_("SELECT", "WITH", "VALUES") else 3
            return self.query(ts[at:], params), f"Insert on {name}"
        rows = self._matching(self.catalog.get(name), ts[find(ts, "WHERE") + 1 :], params)
        return rows, f"{ts[0].text.capitalize()} on {name}"
