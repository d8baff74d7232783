"""Versioned tables: append-only files, delete marks and a commit log.

A table is a folder.  Every write of rows has an id of its own (``_w``) and
numbers its rows (``_i``), so that a row's key is unique whatever transaction
wrote it; ``_v`` is the version whose columns the row was written with.
Delete files name the keys of removed rows.  A snapshot at version n is the
data of commits up to n without the rows that commits up to n removed:
inserts, updates and deletes write only what they change, whatever the table's
size.  A commit is one small log file whose name is its version; creating it is
atomic, so of two writers one sees a conflict.

A transaction over several tables puts an entry that names the transaction in
each table's log; they count once its single record in the database's
transaction log says so.  A writer that meets an undecided entry records it as
aborted first, so a crash half way leaves nothing visible and blocks nobody.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_KEY = ("_w", "_i")
SYSTEM = (*ROW_KEY, "_v")
KEY_SCHEMA = "_w bigint, _i bigint"


class CommitConflict(RuntimeError):
    """Another transaction committed first."""


class LogStore:
    """Small files of a folder, through Hadoop's file system API."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder
        self.root = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False if it is there already.  The text is complete
        when the name appears: a draft is linked (local files) or renamed, which
        HDFS refuses atomically where the name is taken.  A store without an
        atomic rename needs a single writer."""
        if self.fs.exists(self.path(name)):
            return False
        draft = self.path(f".{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                files, paths = self.jvm.java.nio.file.Files, self.jvm.java.nio.file.Paths
                local = [paths.get(self.fs.makeQualified(p).toUri()) for p in (self.path(name), draft)]
                files.createLink(*local)
                return True
            return bool(self.fs.rename(draft, self.path(name)))
        except Py4JJavaError:  # the name is taken
            return False
        finally:
            if self.fs.exists(draft):
                self.fs.delete(draft, False)

    def names(self) -> list[str]:
        if not self.fs.exists(self.root):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.root) if not s.getPath().getName().startswith("."))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class VersionedTable:
    """One table's snapshots and commits."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.log = LogStore(spark, f"{folder}/log")
        self._entries: dict[int, dict] = {}

    # ---- the log ----

    def _outcome(self, entry: dict) -> str | None:
        """Whether the transaction of an entry was committed or aborted (None: open)."""
        if "txn" not in entry:
            return "committed"
        if "outcome" not in entry:
            log = LogStore(self.spark, entry["home"])
            if not log.fs.exists(log.path(entry["txn"])):
                return None
            entry["outcome"] = log.read(entry["txn"])
        return entry["outcome"]

    def _load(self) -> list[int]:
        for name in self.log.names():
            v = int(name.split(".")[0])
            if v not in self._entries:
                self._entries[v] = json.loads(self.log.read(name)) | {"version": v}
        return sorted(self._entries)

    def commits(self) -> list[dict]:
        """Committed entries, up to the first whose transaction is undecided."""
        out = []
        for v in self._load():
            outcome = self._outcome(self._entries[v])
            if outcome is None:
                break
            if outcome == "committed":
                out.append(self._entries[v])
        return out

    def version(self) -> int:
        done = self.commits()
        return done[-1]["version"] if done else 0

    def tip(self) -> int:
        """The last number of the log, after aborting what is undecided."""
        versions = self._load()
        for v in versions:
            entry = self._entries[v]
            if self._outcome(entry) is None:
                LogStore(self.spark, entry["home"]).create(entry["txn"], "aborted")
        return versions[-1] if versions else 0

    def commit(self, base: int, entry: dict) -> int:
        """Appends an entry as version ``base + 1``, or raises ``CommitConflict``."""
        v = base + 1
        if not self.log.create(f"{v:012d}.json", json.dumps(entry)):
            raise CommitConflict(f"version {v} of {self.folder} is taken")
        return v

    @classmethod
    def create(cls, spark: SparkSession, folder: str, schema: T.StructType) -> VersionedTable:
        table = cls(spark, folder)
        table.commit(0, {"schema": json.loads(schema.json()), "add": [], "remove": []})
        return table

    def schema(self, version: int | None = None) -> T.StructType:
        entry = next(c for c in reversed(self._upto(version)) if "schema" in c)
        return T.StructType.fromJson(entry["schema"])

    def _upto(self, version: int | None) -> list[dict]:
        return [c for c in self.commits() if version is None or c["version"] <= version]

    def _live(self, version: int | None) -> tuple[list[str], list[str]]:
        """Data and delete folders of a snapshot; a rewrite replaces all before it."""
        add: list[str] = []
        remove: list[str] = []
        for c in self._upto(version):
            if c.get("rewrite"):
                add, remove = [], []
            add += c["add"]
            remove += c["remove"]
        return add, remove

    def removed_since(self, base: int) -> list[str]:
        """Delete folders of the commits after a version."""
        return [r for c in self.commits() if c["version"] > base for r in c["remove"]]

    # ---- reading ----

    def keys(self, folders: list[str]) -> DataFrame:
        """The row keys that delete folders name."""
        if not folders:
            return self.spark.createDataFrame([], KEY_SCHEMA)
        return self.spark.read.schema(KEY_SCHEMA).parquet(*[f"{self.folder}/{r}" for r in folders])

    def rows(self, add: list[str], remove: list[str], schema: T.StructType) -> DataFrame:
        """Rows of data folders without those that delete folders name, with the
        system columns.  Columns added after a row was written have their
        default in it."""
        wide = T.StructType([*(T.StructField(f.name, f.dataType) for f in schema.fields), *(T.StructField(k, T.LongType()) for k in SYSTEM)])
        out = self.spark.read.schema(wide).parquet(*[f"{self.folder}/{a}" for a in add]) if add else self.spark.createDataFrame([], wide)
        if remove:
            out = out.join(self.keys(remove), list(ROW_KEY), "left_anti")
        late = {f.name: f.metadata for f in schema.fields if "added" in f.metadata and f.metadata.get("default") is not None}
        for name, meta in late.items():
            out = out.withColumn(name, F.when(F.col("_v") < meta["added"], F.expr(meta["default"]).cast(schema[name].dataType)).otherwise(F.col(name)))
        return out

    def snapshot(self, version: int | None = None, staged: dict | None = None, keys: bool = False) -> DataFrame:
        """Rows visible at a version, with the uncommitted changes ``staged``."""
        add, remove = self._live(version)
        schema = self.schema(version)
        if staged:
            add, remove = add + staged["add"], remove + staged["remove"]
        rows = self.rows(add, remove, schema)
        return rows if keys else rows.select(*schema.fieldNames())

    def history(self) -> DataFrame:
        """All row versions that are still stored, with the version that created
        them (``_created``) and the one that removed them (``_deleted``; null:
        live).  VACUUM forgets removed rows."""
        made, gone = [], []
        for c in self.commits():
            if c.get("rewrite"):
                gone = []
            else:
                made += [(int(a.rpartition("/")[2]), c["version"]) for a in c["add"]]
            gone += [(r, c["version"]) for r in c["remove"]]
        rows = self.rows(self._live(None)[0], [], self.schema())
        born = self.spark.createDataFrame(made, "_w bigint, _created bigint")
        out = rows.join(F.broadcast(born), "_w") if len(made) < 100_000 else rows.join(born, "_w")
        marks = self.spark.createDataFrame([], f"{KEY_SCHEMA}, _deleted bigint")
        for r, v in gone:
            marks = marks.unionByName(self.keys([r]).withColumn("_deleted", F.lit(v).cast("bigint")))
        return out.join(marks.groupBy(*ROW_KEY).agg(F.min("_deleted").alias("_deleted")), list(ROW_KEY), "left")

    # ---- writing ----

    def stage_rows(self, rows: DataFrame) -> str:
        """Writes new rows; they count when a commit names their folder."""
        write = uuid.uuid4().int >> 65
        name = f"data/{write}"
        own = {"_w": F.lit(write).cast("bigint"), "_i": F.monotonically_increasing_id(), "_v": F.lit(self.version()).cast("bigint")}
        rows.withColumns(own).write.parquet(f"{self.folder}/{name}")
        return name

    def stage_deletes(self, keyed: DataFrame) -> str:
        name = f"deletes/{uuid.uuid4().hex}"
        keyed.select(*ROW_KEY).write.parquet(f"{self.folder}/{name}")
        return name

    def vacuum(self, needed: list[int] | None = None) -> dict[str, int]:
        """Rewrites the live snapshot as one commit and deletes the folders that
        neither it nor the snapshots at the versions ``needed`` read, those that
        earlier runs had to keep included."""
        base = self.tip()
        before, removed = self._live(base)
        live = self.rows(before, removed, self.schema())
        total = self.rows(before, [], self.schema()).count()
        name = f"data/{uuid.uuid4().int >> 65}"
        live.write.parquet(f"{self.folder}/{name}")  # rows keep their keys
        left = self.rows([name], [], self.schema()).count()
        now = self.commit(base, {"add": [name], "remove": [], "rewrite": True})
        kept = {f for v in [now, *(needed or [])] for part in self._live(v) for f in part}
        for old in {f for c in self.commits() for f in (*c["add"], *c["remove"])} - kept:
            LogStore(self.spark, self.folder).delete(old)
        return {"version": now, "rows_before": total, "rows_removed": total - left, "rows_after": left, "folders_before": len(before) + len(removed), "folders_after": 1}
