"""Shared helpers: table access, shared folders and columnar word tables.

The text operators all follow one shape: a ``mapInArrow`` over ``(id, text)``
splits whole texts into words with Arrow kernels, dictionary-encodes the words
of a slice of documents, does the costly work once per *distinct* word, and
combines the results per document with numpy gathers.  Slices are bounded by
bytes, so memory does not depend on the partition or on how many rows a batch
holds.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
CACHE_WORDS = 150_000
BATCH_BYTES = 16 << 20  # of text that Spark hands to Python at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, prefix: str) -> str:
    """A fresh path in the folder that driver and executors share.

    Uses ``spark.checkpoint.dir`` of the session; only where that is unset
    (single-machine tests) a local temporary folder is made.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="basalt-")
    if "://" not in base and base.startswith("/"):
        base = "file://" + base
    return f"{base.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate rows that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """checkpoint() needs a folder; set one only where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark, "checkpoint"))


def bucket_of(id_col: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus`` (null ids count as '')."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on the bytes of an Arrow batch to ``BATCH_BYTES``:
    with long documents, a batch of the default size and its copies would take
    most of the memory that a Python worker has."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    number = now.rstrip("kmg")
    if not number.isdigit() or not 0 < int(number) * scale <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    n = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(n):
        base = n[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(n, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def release(ended: bool = False) -> None:
    """Hands freed memory back to the machine: a worker is used for many tasks,
    and what it keeps adds to the memory that its executor has.  ``ended``: a
    task is over, so the caches that it has let go are cleared first."""
    if ended:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def map_texts(
    docs: DataFrame, id_col: str, text_col: str, schema: str, make: Callable[[], Callable[[pa.Array, pa.Array], list]], limit: int = SLICE_BYTES
) -> DataFrame:
    """Runs ``make()(ids, texts) -> columns`` over slices of the two columns.

    ``make`` runs once per task, so that caches live as long as the task.
    """
    small_batches(docs.sparkSession)
    out_names = [c.split()[0] for c in schema.split(",")]
    ids = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, "_text", limit):
                columns = work(part.column("_id"), part.column("_text"))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], out_names)
            release()
        work = None
        release(ended=True)

    return ids.mapInArrow(run, schema)


def keep_texts(docs: DataFrame, text_col: str, make: Callable[[], Callable[[pa.Array], np.ndarray]], limit: int = SLICE_BYTES) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose text ``make()`` keeps.

    Works by position, so other columns may have any names; nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches):
        keep = make()
        for batch in batches:
            named = pa.RecordBatch.from_arrays([batch.column(place).cast(pa.string())], ["_text"])
            masks = [np.asarray(keep(part.column("_text")), bool) for part in slices(named, "_text", limit)]
            if masks:
                yield batch.filter(pa.array(np.concatenate(masks)))
            release()
        keep = None
        release(ended=True)

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


class Words:
    """The words of a slice of documents, as codes into a list of distinct words."""

    def __init__(self, lists: pa.ListArray):
        flat = lists.flatten()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        coded = flat.dictionary_encode()
        self.distinct: list[str] = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        if "" in self.distinct:
            keep = codes != self.distinct.index("")
            offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
            codes = codes[keep]
        self.codes, self.offsets = codes, offsets

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of ``values[code]`` over the words of each document."""
        return segment_sums(values[self.codes], self.offsets)


def segment_sums(flat: np.ndarray, offsets: np.ndarray, dtype=None) -> np.ndarray:
    """Sums of ``flat`` along axis 0 between consecutive offsets; empty runs give 0."""
    n = len(offsets) - 1
    dtype = dtype or flat.dtype
    out = np.zeros((n, *flat.shape[1:]), dtype)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.add.reduceat(flat, offsets[full], axis=0, dtype=dtype)
    return out


def space_words(texts: pa.Array) -> Words:
    """Words between runs of the six ASCII white-space characters (null: none)."""
    return Words(pc.ascii_split_whitespace(pc.fill_null(texts, "")))


class Memo:
    """Word -> row of a growing numpy table, filled for unseen words in one call.

    ``fill(words) -> array`` works once per distinct word.  The memo forgets
    everything when it holds more than ``CACHE_WORDS`` words: memory stays
    bounded and results never depend on what it holds.
    """

    def __init__(self, fill: Callable[[list[str]], list | np.ndarray], size: int = CACHE_WORDS):
        self.fill, self.size, self.at, self.rows = fill, size, {}, None

    def look(self, words: list[str]) -> np.ndarray:
        if len(self.at) > self.size:
            self.at, self.rows = {}, None
        new = [w for w in words if w not in self.at]
        if new:
            made = self.fill(new)
            base = 0 if self.rows is None else len(self.rows)
            self.at.update(zip(new, range(base, base + len(new))))
            self.rows = made if self.rows is None else np.concatenate([self.rows, made])
        if not words:
            return np.zeros(0) if self.rows is None else self.rows[:0]
        return self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]
