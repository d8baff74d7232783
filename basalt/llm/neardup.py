"""Near-duplicates by exact Jaccard similarity of word shingles, for the corpus pipeline.

Texts of one multiset of shingles are one node.  SimHash's multi-index tables
(``simhash.links``, over fingerprints of the same shingles) and MinHash bands
propose pairs of nodes, and a pair links when the exact similarity of its
shingle sets reaches the threshold.  64 bits cannot tell 0.8 apart, so the
tables propose the closest copies and the bands all the others: every member of
a bucket is paired with the bucket's smallest and largest member first.  Where
a bucket's members still lie in different components, they are compared within
blocks of it, where sketches screen and the sets decide; a block returns the
links that connect its members, so the rows grow with the members of a bucket,
never with their pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basalt.llm import simhash
from basalt.llm._text import CACHE_WORDS, Memo, drop_dir, release, segment_sums, shared_dir, slices, small_batches, space_words
from basalt.llm.simhash import components, majority

SHINGLE = 5
SIMILARITY = 0.8
# Of pairs at 0.8, 1 - (1 - 0.8 ** 6) ** 32 = 0.99994 share a band; at 0.3, 0.02.
BANDS, ROWS = 32, 6
SLACK = 0.115  # four standard deviations of a sketch's estimate at 0.8
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 1 << 20  # of a bucket's rows, compared with as many others in one call
SLICE_BYTES = 2 << 20  # of text at once; a dozen arrays have a number for each of its shingles
SEED = 42
_RANDOM = np.random.default_rng(SEED)
PLACES = _RANDOM.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ORDERS = _RANDOM.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_memo() -> Memo:
    return Memo(lambda words: np.array([xxhash.xxh64_intdigest(w.encode(), SEED) for w in words], np.uint64))


def shingles(texts: pa.Array, memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)``: hashes of the five-word shingles of lower-cased (A-Z)
    texts, repeats included; a shorter text is one shingle, one without words none."""
    words = space_words(pc.ascii_lower(pc.fill_null(texts, "")))
    hashed = memo.look(words.distinct).astype(np.uint64)[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    n = words.counts
    many = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    bounds = np.concatenate(([0], np.cumsum(many)))
    first = np.repeat(words.offsets[:-1] - bounds[:-1], many) + np.arange(bounds[-1])
    size = np.repeat(np.minimum(n, SHINGLE), many)
    out = np.zeros(bounds[-1], np.uint64)
    for k, place in enumerate(PLACES):
        there = size > k
        out[there] += mix(hashed[first[there] + k] * place)
    return mix(out), bounds


def nodes_of(hashes: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """16 bytes that name each text's multiset of shingles."""
    pair = np.stack([segment_sums(hashes, bounds), segment_sums(mix(hashes ^ PLACES[0]), bounds)], 1)
    return pa.Array.from_buffers(pa.binary(16), len(pair), [None, pa.py_buffer(pair.tobytes())]).cast(pa.binary())


def minima(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The smallest shingle of each text under each order, ``(texts, BANDS, ROWS)``."""
    out = np.zeros((len(bounds) - 1, BANDS, ROWS), np.uint64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        for t, orders in enumerate(ORDERS):
            for r, order in enumerate(orders):
                out[full, t, r] = np.minimum.reduceat(hashes * order, bounds[full])
    return out


def bands_of(hashes: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Keys of the MinHash bands of each text; texts without words have none."""
    full = np.diff(bounds) > 0
    least = minima(hashes, bounds)[full]
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(least), 1))
    for r in range(ROWS):
        keys = mix(keys * PLACES[1] + least[:, :, r])
    offsets = np.concatenate(([0], np.cumsum(np.where(full, BANDS, 0)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))


def sketches_of(hashes: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One byte of each of the minima."""
    low = (minima(hashes, bounds) & np.uint64(255)).astype(np.uint8)
    return pa.array([row.tobytes() for row in low], pa.binary())


def sets_of(hashes: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The sorted distinct shingles of each text, as bytes."""
    return pa.array([np.unique(hashes[a:b]).tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())


def with_columns(docs: DataFrame, text_col: str, columns: dict, once: bool = False) -> DataFrame:
    """``docs`` and further columns ``name -> (type, f(hashes, bounds))`` of the texts' shingles.

    With ``once`` a task leaves out most rows whose first new column it has had
    before: copies of a hot text then cross no shuffle."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches):
        memo, seen = word_memo(), set()
        for batch in batches:
            named = pa.RecordBatch.from_arrays([batch.column(place).cast(pa.string())], ["_text"])
            at = 0
            for part in slices(named, "_text", SLICE_BYTES):
                found = shingles(part.column("_text"), memo)
                own = batch.slice(at, len(part))
                made = pa.RecordBatch.from_arrays([*own.columns, *[f(*found) for _, f in columns.values()]], [*own.schema.names, *columns])
                if once:
                    names = made.column(len(own.columns)).to_pylist()
                    made = made.filter(pa.array([n not in seen and not seen.add(n) for n in names], pa.bool_()))
                    if len(seen) > CACHE_WORDS:
                        seen.clear()
                yield made
                at += len(part)
            release()
        memo, seen = None, None
        release(ended=True)

    schema = T.StructType([*docs.schema.fields, *[T.StructField(name, kind) for name, (kind, _) in columns.items()]])
    return docs.mapInArrow(run, schema)


def sizes_of(hashes: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.array(np.diff(bounds), pa.int64())


NODE = {"node": (T.BinaryType(), nodes_of)}
SIGNED = NODE | {"fp": (T.LongType(), lambda *found: pa.array(majority(*found))), "many": (T.LongType(), sizes_of), "bands": (T.ArrayType(T.LongType()), bands_of)}


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sets have the Jaccard similarity ``SIMILARITY`` or more."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                least, most = sorted((len(x), len(y)))
                both = len(np.intersect1d(x, y, assume_unique=True)) if least >= SIMILARITY * most else 0
                keep.append(both > 0 and both / (len(x) + len(y) - both) >= SIMILARITY)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


class Sets:
    """Shingle sets of a block's rows, as codes into the block's shingles."""

    def __init__(self, column: pa.Array):
        raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in column]
        self.size = np.array([len(x) for x in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        distinct, self.codes = np.unique(np.concatenate([*raw, np.zeros(0, np.uint64)]), return_inverse=True)
        self.mark = np.zeros(len(distinct), bool)

    def similar(self, i: int, js: np.ndarray) -> np.ndarray:
        """Whether the exact similarity of row ``i`` with each of ``js`` reaches the threshold."""
        own = self.codes[self.start[i] : self.start[i] + self.size[i]]
        self.mark[own] = True
        size = self.size[js]
        ends = np.concatenate(([0], np.cumsum(size)))
        both = segment_sums(self.mark[self.codes[np.repeat(self.start[js] - ends[:-1], size) + np.arange(ends[-1])]], ends, np.int64)
        self.mark[own] = False
        return both / np.maximum(len(own) + size - both, 1) >= SIMILARITY


def compare(key: tuple, rows: pa.Table) -> pa.Table:
    """Links that connect what is similar in two blocks of a bucket (or within
    one) and lies in different components; a pair is compared in the first
    bucket that it shares only."""
    t, low, high = (k.as_py() for k in key[1:])
    block = rows["block"].to_numpy()
    nodes, root = rows["node"].combine_chunks(), rows["root"].combine_chunks().dictionary_encode().indices.to_numpy().copy()
    sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
    sets = Sets(rows["set"].combine_chunks())
    others, found = np.flatnonzero(block == high), []
    for i in np.flatnonzero(block == low):
        js = others[(root[others] != root[i]) & ((others > i) | (low != high))]
        least, most = np.minimum(sets.size[js], sets.size[i]), np.maximum(sets.size[js], sets.size[i])
        js = js[least >= SIMILARITY * most]
        for at in range(0, len(js), 1024):
            part = js[at : at + 1024]
            same = sketch[part] == sketch[i]
            near = same.mean(axis=1) >= SIMILARITY - SLACK
            part, same = part[near], same[near]
            part = part[same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == t]
            for j in part[sets.similar(i, part)]:
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    found.append((i, j))
    one, two = np.array(found, np.int64).reshape(-1, 2).T
    return pa.table({"a": nodes.take(pa.array(one)), "b": nodes.take(pa.array(two))})


def proposals(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``a, b``: pairs of nodes that SimHash's tables (``rows``: ``node, fp``) or
    the bands' buckets propose, a few for each node."""
    prints = rows.groupBy("fp").agg(F.min("node").alias("least"))
    same = rows.join(prints, "fp").select(F.col("node").alias("a"), F.col("least").alias("b"))
    one, two = prints.select(F.col("fp").alias("x"), F.col("least").alias("a")), prints.select(F.col("fp").alias("y"), F.col("least").alias("b"))
    linked = simhash.links(prints.select("fp")).toDF("x", "y").join(one, "x").join(two, "y").select("a", "b")
    bands = buckets.select(F.col("node").alias("a"), F.explode(F.array("least", "most")).alias("b"))
    pairs = same.unionByName(linked).unionByName(bands).filter("a != b")
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def groups(plain: DataFrame, rows: DataFrame, text_col: str, place: str) -> DataFrame:
    """``node, root`` of the nodes of ``rows`` (``node, fp, many, bands``) that link."""
    spark = plain.sparkSession
    bucket = Window.partitionBy("key", "t")
    distinct = rows.groupBy("node").agg(F.first("bands").alias("bands"), F.first("many").alias("many"))
    keyed = distinct.select("node", "many", F.posexplode("bands").alias("t", "key"))
    keyed = keyed.withColumn("least", F.min("node").over(bucket)).withColumn("most", F.max("node").over(bucket))
    keyed.filter("least < most").write.parquet(f"{place}/buckets")
    buckets = spark.read.parquet(f"{place}/buckets")
    proposals(rows.select("node", "fp").distinct(), buckets).write.parquet(f"{place}/proposed")
    near = spark.read.parquet(f"{place}/proposed")
    wanted = buckets.select("node").unionByName(near.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    texts = with_columns(plain.select(text_col), text_col, NODE, once=True).join(wanted, "node", "left_semi").dropDuplicates(["node"])
    with_columns(texts, text_col, {"set": (T.BinaryType(), sets_of), "sketch": (T.BinaryType(), sketches_of)}).select("node", "set", "sketch").write.parquet(f"{place}/sets")
    sets = spark.read.parquet(f"{place}/sets")
    verified(near, sets).write.parquet(f"{place}/links0")
    links = spark.read.parquet(f"{place}/links0")
    # What is in one component needs no more comparison; every other pair of a bucket does.
    rooted = buckets.select("key", "t", "node", "many").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.withColumn("low", F.min("root").over(bucket)).withColumn("high", F.max("root").over(bucket)).withColumn("n", F.count("*").over(bucket))
    mixed = mixed.withColumn("blocks", F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.sum("many").over(bucket) / BLOCK_SHINGLES)).cast("int"))
    mixed.filter("low < high AND n > 2").select("key", "t", "node", "root", "blocks").write.parquet(f"{place}/mixed")
    mixed = spark.read.parquet(f"{place}/mixed").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    mixed = mixed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).join(sets, "node")
    mixed = mixed.select("key", "t", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "root", "sketch", "set")
    mixed.groupBy("key", "t", "low", "high").applyInArrow(compare, "a binary, b binary").write.parquet(f"{place}/links1")
    return components(links.unionByName(spark.read.parquet(f"{place}/links1")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates of ``docs``: that with the smallest
    id.  Rows without an id stay.

    Texts are lower-cased (A-Z), split at ASCII white space and shingled by five
    words; those with a Jaccard similarity of 0.8 or more link, and groups are
    what links connect.  Rows of one id with texts of different groups stand for
    themselves; of rows with equal id and shingles one stays, by a hash of all
    columns.
    """
    spark = docs.sparkSession
    place = shared_dir(spark, "neardup")
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    key, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    tie = F.xxhash64(*[c for c, kind in plain.dtypes if "map<" not in kind and kind != "variant"])
    with_columns(plain, text, SIGNED).select(F.col(key).alias("id"), "node", tie.alias("tie"), "fp", "many", "bands").write.parquet(f"{place}/rows")
    rows = spark.read.parquet(f"{place}/rows")
    heads = rows.filter("id IS NOT NULL").groupBy("id", "node", "tie").agg(F.count("*").alias("n"))
    heads = heads.groupBy("node").agg(F.min(F.struct("id", "node", "tie", "n")).alias("head"))
    roots = groups(plain, rows, text, f"{place}/groups")
    heads = heads.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("head").alias("head"))
    heads = heads.select(F.col("head.id").alias("_id"), F.col("head.node").alias("_node"), F.col("head.tie").alias("_tie"), (F.col("head.n") > 1).alias("_again"))
    heads.write.parquet(f"{place}/heads")
    heads = spark.read.parquet(f"{place}/heads")
    for done in ("rows", "groups"):
        drop_dir(spark, f"{place}/{done}")
    known = with_columns(plain, text, NODE).withColumn("tie", tie)
    kept = known.join(heads, (F.col(key) == F.col("_id")) & (F.col("node") == F.col("_node")) & (F.col("tie") == F.col("_tie")))
    once = kept.filter("NOT _again").select(*names)
    repeated = kept.filter("_again").dropDuplicates([key, "node", "tie"]).select(*names)
    return once.unionByName(repeated).unionByName(plain.filter(F.col(key).isNull())).toDF(*docs.columns)
