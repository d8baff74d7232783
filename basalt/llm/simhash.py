"""Near-duplicates by 64-bit SimHash and multi-index hashing.

Fingerprints come from whole texts.  The 64 bits form two segments, and each
segment has a table of buckets: all fingerprints with one value of the segment.
Two fingerprints that differ in at most two bits differ in at most one bit of
some segment, so every fingerprint looks into the bucket of its own value and
into those of the Hamming ball of radius one around it.  Of two values one bit
apart only the one with the bit set looks up the other: a pair is met once, and
the ball costs a row for each set bit.  Complete distances are verified.

A bucket of many fingerprints (a dense cluster of near copies) is not compared
pair by pair: it is split by the other segment, into which its members
enumerate a ball in turn.  Members of such a part are within two bits of each
other and there are 65 at most, so links to its smallest lose no connection and
their number grows with the members, not with their pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm._text import drop_dir, map_texts, segment_sums, shared_dir

WIDTH = 32  # bits of each of the two segments
SEED = 42
BUCKET = 64  # fingerprints of a bucket that are compared pair by pair
PART = 1 << 15  # fingerprints whose keys one task enumerates


def fingerprints_of(texts: pa.Array, shingle: int = 3) -> np.ndarray:
    """int64 fingerprints (the unsigned bits) of whole texts."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.flatten()
    n_words = np.diff(offsets)
    size = pc.binary_length(words).to_numpy().astype(np.int64)
    n_words[n_words == 1] -= size[offsets[:-1][n_words == 1]] == 0  # an empty text splits into one empty word
    # One buffer holds all words, each followed by a space; a shingle is a range of it.
    buffer = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
    buffer = (buffer or "").encode()
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n_shingles = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    bounds = np.concatenate(([0], np.cumsum(n_shingles)))
    within = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n_shingles)
    first = np.repeat(offsets[:-1], n_shingles) + within
    last = first + np.repeat(np.minimum(n_words, shingle), n_shingles) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(buffer[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist())], np.uint64)
    return majority(hashes, bounds)


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """int64 whose bits are set where over half of a text's hashes have them."""
    n = np.diff(bounds)
    step = 1 << 17  # shingles whose bits are spread out at a time
    ones = np.zeros((len(n), 64), np.int64)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + step, "right")) - 1)
        for low in range(int(bounds[at]), int(bounds[to]), step) if to == at + 1 else [int(bounds[at])]:
            high = min(low + step, int(bounds[to])) if to == at + 1 else int(bounds[to])
            bits = np.unpackbits(hashes[low:high].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            if to == at + 1:
                ones[at] += bits.sum(axis=0, dtype=np.int64)
            else:
                ones[at:to] = segment_sums(bits, bounds[at : to + 1] - low, np.int64)
        at = to
    return np.packbits(ones * 2 > n[:, None], axis=1, bitorder="little").view(np.int64)[:, 0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp bigint`` of every row; texts without words have 0."""

    def make():
        return lambda ids, texts: [ids, fingerprints_of(texts, shingle)]

    kind = dict(docs.dtypes)[id_col]
    return map_texts(docs, id_col, text_col, f"doc_id {kind}, fp bigint", make, 4 << 20)


def links(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """``a, b``: verified links among distinct fingerprints that connect all
    that differ in two bits or fewer."""
    spark = distinct.sparkSession
    place = shared_dir(spark, "segments")
    # Each fingerprint becomes some 34 rows, so a few megabytes of them are dealt over many tasks.
    distinct = distinct.select(F.col(fp).alias("fp")).repartition(distinct.count() // PART + 1, "fp")
    mask = (1 << WIDTH) - 1
    value = [f"(shiftrightunsigned(fp, {s * WIDTH}) & {mask}L)" for s in (0, 1)]
    ball = "array(0L), transform(filter(sequence(0, {w} - 1), i -> (shiftrightunsigned(fp, i + {s}) & 1L) = 1), i -> shiftleft(1L, i))"
    balls = [f"transform(concat({ball.format(w=WIDTH, s=s * WIDTH)}), x -> {s << WIDTH}L + ({value[s]} ^ x))" for s in (0, 1)]
    tables = distinct.select("fp", F.expr(f"explode(concat({', '.join(balls)}))").alias("key"))
    # A row is of the bucket if the key is its own value, and else looks into it.
    own = f"key = if(key > {mask}L, {1 << WIDTH}L + {value[1]}, {value[0]})"
    bucket = Window.partitionBy("key")
    sized = tables.withColumn("own", F.expr(own)).withColumn("n", F.count("*").over(bucket)).withColumn("held", F.count_if("own").over(bucket))
    sized.filter("n > 1 AND held > 0").select("key", "fp", "own", "n").write.parquet(f"{place}/met")
    met = spark.read.parquet(f"{place}/met")
    few = met.filter(F.col("n") <= BUCKET).groupBy("key").agg(F.collect_list(F.struct("fp", "own")).alias("rows"))
    near = "filter(rows, y -> (NOT y.own OR y.fp < x.fp) AND y.fp != x.fp AND bit_count(x.fp ^ y.fp) <= 2)"
    pairs = few.select(F.expr(f"explode(flatten(transform(filter(rows, x -> x.own), x -> transform({near}, y -> struct(x.fp AS a, y.fp AS b)))))").alias("p")).select("p.*")
    other = f"if(key > {mask}L, {value[0]}, {value[1]})"
    around = f"if(own, concat(array({other}), transform(sequence(0, {WIDTH} - 1), i -> {other} ^ shiftleft(1L, i))), array({other}))"
    parts = met.filter(F.col("n") > BUCKET).select("key", "fp", F.expr(f"explode({around})").alias("part"))
    parts = parts.groupBy("key", "part").agg(F.collect_set("fp").alias("members")).filter(F.size("members") > 1)
    stars = parts.select(F.explode("members").alias("a"), F.array_min("members").alias("b")).filter("a != b AND bit_count(a ^ b) <= 2")
    ends = [F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")]
    return pairs.unionByName(stars).select(*ends).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: connected components of undirected edges ``a, b``.

    Each round takes the smallest label among a node's neighbours and then the
    label of that label.  Every round is written to the shared folder, so lost
    executors cost one round at most.  Only aggregates by node and joins are
    used: no component or neighbourhood is gathered in one task.
    """
    spark = edges.sparkSession
    place = shared_dir(spark, "components")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both.write.parquet(f"{place}/edges")
    both = spark.read.parquet(f"{place}/edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.lit(True).alias("changed"), F.least("node", "least").alias("root"))
    labels.write.parquet(f"{place}/0")
    k = 0
    while True:
        labels = spark.read.parquet(f"{place}/{k}").select("node", "root")
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        now = labels.join(seen, labels.node == seen.a).select("node", F.col("root").alias("old"), F.least("root", "near").alias("new"))
        up = labels.select(F.col("node").alias("new"), F.col("root").alias("above"))
        now = now.join(up, "new").withColumn("root", F.least("new", "above")).select("node", (F.col("root") != F.col("old")).alias("changed"), "root")
        k += 1
        now.write.parquet(f"{place}/{k}")
        drop_dir(spark, f"{place}/{k - 1}")
        now = spark.read.parquet(f"{place}/{k}")
        if now.filter("changed").isEmpty():
            drop_dir(spark, f"{place}/edges")
            return now.select("node", "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``.

    Texts are lower-cased (A-Z), split at ASCII white space and shingled by
    three words, repeats included; fingerprints that differ in two bits or
    fewer link, and ``component_id`` is the smallest id reachable.  Null, empty
    and blank texts have fingerprint zero and link like any other.  Rows with
    a null id get a component too (null if no other member has an id); repeated
    rows give repeated results; an empty table gives none.
    """
    spark = docs.sparkSession
    place = shared_dir(spark, "simhash")
    fingerprints(docs, id_col, text_col, shingle).write.parquet(f"{place}/docs")
    marked = spark.read.parquet(f"{place}/docs")
    marked.groupBy("fp").agg(F.min("doc_id").alias("least")).write.parquet(f"{place}/distinct")
    distinct = spark.read.parquet(f"{place}/distinct")
    roots = components(links(distinct.select("fp")))
    joined = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = joined.join(least, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
