"""Approximate nearest neighbours by cross-polytope hashing.

A fast pseudo-rotation (three rounds of random signs and a Hadamard transform)
turns a unit vector; its hash is the nearest signed axis.  Larger indexes add
further hashes of fewer axes, so that a bucket keeps about ``rows_per_bucket``
rows at any size.  Several tables with rotations of their own are probed, each
in the buckets whose axes lie nearest to the query; candidates are reranked by
exact distance in double precision on the original vectors.

Buckets that share their first axes lie in one shelf of some hundred rows or
more: a query's vector travels once to a shelf, with the numbers of the buckets
that it probes there, and only their rows are reranked.

Equal vectors are searched once and expanded afterwards, and large shelves are
cut into blocks by a hash of the id: a hot vector or a dense cluster never
gathers in one task, and a block returns only its best rows for each query.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm._text import shared_dir

BLOCK_ROWS, SHELF_ROWS = 2048, 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of rows of a power-of-two length."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


class CrossPolytope:
    """Bucket numbers of vectors: mixed radix over the axes of each level.

    ``levels`` has the number of signed axes of each level's hash: the first
    has all, later ones a power of two of them.
    """

    def __init__(self, dim: int, rows: int, tables: int, rows_per_bucket: int, seed: int):
        self.width = 1 << max(0, dim - 1).bit_length()
        self.tables, self.seed = tables, seed
        self.levels = [2 * self.width]
        while rows / math.prod(self.levels) >= 4 * rows_per_bucket:
            wanted = rows / math.prod(self.levels) / rows_per_bucket
            self.levels.append(min(2 * self.width, 1 << int(math.log2(wanted))))
        self.rows, self.buckets_all = rows, math.prod(self.levels)
        self.shelf, kept = self.buckets_all, 1  # buckets of a shelf: those with equal first axes
        for size in self.levels:
            if kept > 1 and rows / (kept * size) < SHELF_ROWS:
                break
            kept *= size
            self.shelf = self.buckets_all // kept

    def _axes(self, x: np.ndarray, table: int):
        """For each level, coordinates along its signed axes."""
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        unit = np.zeros((len(x), self.width))
        unit[:, : x.shape[1]] = x / norm
        for level, size in enumerate(self.levels):
            signs = np.random.default_rng([self.seed, table, level, self.width]).choice([-1.0, 1.0], (3, self.width))
            turned = unit
            for s in signs:
                turned = hadamard(turned * s)
            part = turned[:, : size // 2]
            yield np.concatenate((part, -part), 1)

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for size, axes in zip(self.levels, self._axes(x, table)):
            out = out * size + axes.argmax(1)
        return out

    def probes(self, x: np.ndarray, table: int, share: float, power: float, least_rows: int = 0) -> np.ndarray:
        """The buckets of the nearest axes, ``share`` of a one-level table's;
        their number grows as the number of buckets to ``power``, and is such
        that they are expected to hold ``least_rows`` rows."""
        n = max(1, round(share * self.levels[0] * (self.buckets_all / self.levels[0]) ** power))
        n = min(self.buckets_all, max(n, math.ceil(least_rows * self.buckets_all / max(1, self.rows))))
        code, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for size, axes in zip(self.levels, self._axes(x, table)):
            gap = (axes.max(1, keepdims=True) - axes) ** 2
            code = (code[:, :, None] * size + np.arange(size)).reshape(len(x), -1)
            cost = (cost[:, :, None] + gap[:, None, :]).reshape(len(x), -1)
            if cost.shape[1] > n:
                best = np.argpartition(cost, n - 1, axis=1)[:, :n]
                code, cost = np.take_along_axis(code, best, 1), np.take_along_axis(cost, best, 1)
        return code


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    gap = rows - query
    return np.sqrt((gap * gap).sum(1))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, dim, vec`` of rows with an id and a finite vector that is not zero;
    of several rows with one id the smallest vector counts."""
    vec = F.col(f"`{vector_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), vec.alias("vec")).filter("id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")
    fine = "forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(vec, x -> x <> 0)"
    return rows.filter(fine).groupBy("id").agg(F.min("vec").alias("vec")).select("id", F.size("vec").alias("dim"), "vec")


def search(
    vectors: DataFrame, is_query: str = "id % 100 = 0", k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 8,
    probe_share: float = 0.09, probe_power: float = 0.7, probe_rows: int = 128, rows_per_bucket: int = 32, seed: int = 11,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other rows found for
    each row that ``is_query`` (SQL over ``id``) picks, by Euclidean distance.

    Ties go to the smaller id.  Vectors that are null, empty or zero or hold
    null or non-finite components take no part, nor do rows without an id;
    vectors of different lengths are never neighbours.  A query whose buckets
    hold fewer than ``k`` rows gets its nearest by a scan of all rows of its
    length: all of them, where there are fewer.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    place = shared_dir(spark, "ann")
    rows = usable(vectors, id_col, vector_col)
    # Equal vectors are as near as each other, so the k + 1 smallest ids of each
    # stand for all.  A first pass by partition bounds what one key gathers.
    part = Window.partitionBy("vec", "salt").orderBy("id")
    whole = Window.partitionBy("vec").orderBy("id")
    few = rows.withColumn("asked", F.expr(is_query)).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)))
    queries_of = few.filter("asked").groupBy("vec").agg(F.min("id").alias("one"))
    few = few.withColumn("n", F.row_number().over(part)).filter(F.col("n") <= k + 1)
    few = few.withColumn("n", F.row_number().over(whole)).filter(F.col("n") <= k + 1)
    few = few.withColumn("rep", F.min("id").over(Window.partitionBy("vec"))).drop("asked", "salt")
    few.join(queries_of, "vec", "left").select("id", "dim", "vec", "n", "rep", F.col("one").isNotNull().alias("asked")).write.parquet(f"{place}/rows")
    few = spark.read.parquet(f"{place}/rows")
    sizes = {r["dim"]: r["rows"] for r in few.filter("n = 1").groupBy("dim").agg(F.count("*").alias("rows")).collect()}  # one row for each length of vector
    index = {d: CrossPolytope(d, n, tables, rows_per_bucket, seed) for d, n in sizes.items()}

    def hashed(batches, probing: bool):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                own, one = batch.filter(pa.array(dims == dim)), index[dim]
                x = matrix(own.column("vec"))
                for t in range(tables):
                    if probing:  # the buckets that a row probes in a shelf are one list
                        at = one.probes(x, t, probe_share, probe_power, probe_rows)
                        at.sort(axis=1)
                        row, shelf, code = np.repeat(np.arange(len(x)), at.shape[1]), (at // one.shelf).ravel(), pa.array(at.ravel())
                        heads = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (shelf[1:] != shelf[:-1])))) if len(row) else row
                        codes = pa.ListArray.from_arrays(pa.array(np.append(heads, len(row)), pa.int32()), code)
                        row, shelf = row[heads], shelf[heads]
                    else:
                        codes = pa.array(one.buckets(x, t))
                        row, shelf = np.arange(len(x)), codes.to_numpy() // one.shelf
                    columns = [own.column(c).take(pa.array(row)) for c in ("rep", "dim", "vec")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(row), t, np.int32)), pa.array(shelf), codes], ["rep", "dim", "vec", "t", "shelf", "bucket"])

    kind = dict(few.dtypes)
    schema = f"rep {kind['rep']}, dim int, vec {kind['vec']}, t int, shelf bigint, bucket"
    reps = few.filter("n = 1").select("rep", "dim", "vec", "asked")
    table = reps.drop("asked").mapInArrow(lambda b: hashed(b, False), f"{schema} bigint")
    probes = reps.filter("asked").drop("asked").mapInArrow(lambda b: hashed(b, True), f"{schema} array<bigint>")
    key = ["dim", "t", "shelf"]
    narrow = reps.select("rep", "dim", "vec").mapInArrow(lambda b: (x.select(["dim", "t", "shelf"]) for x in hashed(b, False)), "dim int, t int, shelf bigint")
    narrow.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).write.parquet(f"{place}/blocks")
    blocks = spark.read.parquet(f"{place}/blocks")
    table = table.join(blocks, key).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("blocks")
    blocks = spark.read.parquet(f"{place}/blocks")
    probes = probes.join(blocks, key).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    key.append("block")

    def rerank(asked: pa.Table, rows: pa.Table) -> pa.Table:
        """The k + 1 nearest rows of a block for each query that probes it: of
        all its rows, or of the buckets that the query names."""
        out: list[tuple] = []
        if rows.num_rows and asked.num_rows:
            x, ids = matrix(rows["vec"].combine_chunks()), np.array(rows["rep"].to_pylist())
            named = "bucket" in asked.column_names
            if named:
                order = np.argsort(rows["bucket"].to_numpy(), kind="stable")
                x, ids, held = x[order], ids[order], rows["bucket"].to_numpy()[order]
            probed = asked["bucket"].to_pylist() if named else [None] * asked.num_rows
            for one, q, codes in zip(asked["rep"].to_pylist(), matrix(asked["vec"].combine_chunks()), probed):
                if named:
                    first, last = np.searchsorted(held, codes, "left"), np.searchsorted(held, codes, "right")
                    size = last - first
                    pick = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    near_x, near_ids = x[pick], ids[pick]
                else:
                    near_x, near_ids = x, ids
                d = distances(near_x, q)
                if len(d) > k + 1:
                    near = np.flatnonzero(d <= np.partition(d, k)[k])
                    near = near[np.lexsort((near_ids[near], d[near]))]
                else:
                    near = np.lexsort((near_ids, d))
                out += [(one, near_ids[i].item(), float(d[i])) for i in near[: k + 1]]
        return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate((("q", asked["rep"].type), ("rep", asked["rep"].type), ("dist", pa.float64())))})

    def nearest(found: DataFrame) -> DataFrame:
        found = found.groupBy("q", "rep").agg(F.min("dist").alias("dist"))  # several tables may find a row
        return found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("dist", "rep"))).filter(F.col("n") <= k + 1)

    ranked = f"q {kind['rep']}, rep {kind['rep']}, dist double"
    nearest(probes.groupBy(*key).cogroup(table.groupBy(*key)).applyInArrow(rerank, ranked)).write.parquet(f"{place}/found")
    best = spark.read.parquet(f"{place}/found")
    # Queries whose buckets held fewer rows than they are owed (itself included) scan all rows of their length.
    held = few.groupBy("rep").agg(F.count("*").alias("held"))
    got = best.join(held, "rep").groupBy("q").agg(F.sum("held").alias("got"))
    dims = few.groupBy("dim").agg(F.count("*").alias("all"), F.ceil(F.count_if(F.col("n") == 1) / BLOCK_ROWS).cast("int").alias("blocks"))
    short = reps.filter("asked").join(got, F.col("rep") == F.col("q"), "left").join(dims, "dim")
    short.filter(F.coalesce("got", F.lit(0)) < F.least(F.lit(k + 1), "all")).select("rep", "dim", "vec", "blocks").write.parquet(f"{place}/short")
    short = spark.read.parquet(f"{place}/short")
    if not short.isEmpty():
        parts = short.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"), F.first("blocks").alias("blocks"))
        asked = short.join(parts.drop("blocks"), "dim").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        asked = asked.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
        every = reps.drop("asked").join(parts, "dim").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        every = every.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
        scan = ["dim", "block", "part"]
        sides = [x.select("rep", "vec", *scan).groupBy(*scan) for x in (asked, every)]
        scanned = nearest(sides[0].cogroup(sides[1]).applyInArrow(rerank, ranked))
        best = best.join(short, best.q == short.rep, "left_anti").unionByName(scanned)
    members = few.select("rep", F.col("id").alias("vec_id"))
    listed = best.drop("n").join(members, "rep").groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("dist", "vec_id"))), 1, k + 1).alias("near"))
    # every query row of a vector gets its list, without itself
    asking = rows.filter(F.expr(is_query)).join(few.filter("n = 1 AND asked").select("vec", F.col("rep").alias("q")), "vec").select(F.col("id").alias("query_id"), "q")
    own = asking.join(listed, "q").select("query_id", F.expr(f"slice(filter(near, x -> x.vec_id <> query_id), 1, {k})").alias("near"))
    return own.select("query_id", F.posexplode("near").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.vec_id", F.col("x.dist").alias("score"))


def exact(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Brute force for a stated list of queries, to measure recall: each task
    scans its rows and keeps the k nearest of each query."""
    ids, x = [q for q, _ in queries], np.array([v for _, v in queries], float)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, names = matrix(batch.column("vec")), np.array(batch.column("id").to_pylist())
            out = []
            for one, q in zip(ids, x):
                d = np.where(names == one, np.inf, distances(rows, q))
                out += [(one, names[i].item(), float(d[i])) for i in np.lexsort((names, d))[:k] if d[i] < np.inf]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)] if out else [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query_id", "vec_id", "score"])

    near = usable(vectors, id_col, vector_col).filter(F.col("dim") == x.shape[1]).mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
