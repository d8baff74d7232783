"""The pipeline's near-dedup stage: five-word shingles, Jaccard 0.8, against brute force."""

import random

import numpy as np
import pyarrow as pa

from basalt.llm import neardup
from tests.llm.conftest import prose

SCHEMA = "doc_id bigint, text string"


def brute_heads(texts):
    """The smallest place of each group that pairs at 0.8 or more connect."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in (t.lower().split() for t in texts)]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted({root(i) for i in range(len(texts))})


def edited(rng, text, words):
    out = text.split()
    for at in rng.sample(range(len(out)), words):
        out[at] = prose(rng, 1)
    return " ".join(out)


def stage(spark, rows):
    import corpus_pipeline

    return corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")


def test_edited_copies_go(spark):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(120, 300)) for _ in range(40)]
    texts += [edited(rng, texts[i % 40], 1 + i % 9) for i in range(160)] + ["", " ", "one two", "One\ttwo", "one"]
    kept = sorted(r.doc_id for r in stage(spark, list(enumerate(texts))).collect())
    assert kept == brute_heads(texts) and len(kept) < 150


def test_dense_cluster_in_blocks(spark, monkeypatch):
    """Many edits of one text, similar in part only: buckets of several components, cut into blocks."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 16)
    rng = random.Random(6)
    base = prose(rng, 150)
    texts = [edited(rng, base, rng.randint(0, 8)) for _ in range(150)]
    assert sorted(r.doc_id for r in stage(spark, list(enumerate(texts))).collect()) == brute_heads(texts)


def test_sketches_hold_the_bands():
    """Two texts share a band's key where the sketch's bytes of the band are equal."""
    rng = random.Random(8)
    base = prose(rng, 200)
    found = neardup.shingles(pa.array([base, edited(rng, base, 3)]), neardup.word_memo())
    one, two = np.array(neardup.bands_of(*found).to_pylist())
    a, b = (np.frombuffer(s, np.uint8).reshape(neardup.BANDS, neardup.ROWS) for s in neardup.sketches_of(*found).to_pylist())
    assert ((a == b).all(axis=1) == (one == two)).all() and (one == two).any()


def test_odd_rows(spark, odd_docs, no_docs):
    kept = neardup.keep_one(odd_docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd_docs.columns and len(ids) == len(set(ids)) and None in ids
    assert neardup.keep_one(no_docs).count() == 0


def test_texts_of_one_id(spark):
    """(3, A), (3, B), (7, B'): neither text vanishes, and no group goes with another's id."""
    rng = random.Random(10)
    a, b = prose(rng, 150), prose(rng, 150)
    rows = [(3, a), (3, b), (7, edited(rng, b, 2)), (3, b)]
    assert sorted((r.doc_id, r.text) for r in stage(spark, rows).collect()) == sorted([(3, a), (3, b)])


def test_copies_leave_a_task_once(spark):
    docs = spark.createDataFrame([(i, "one text " * 9 + str(i % 3)) for i in range(300)], SCHEMA).coalesce(1)
    assert neardup.with_columns(docs, "text", neardup.NODE, once=True).count() == 3
    assert neardup.with_columns(docs, "text", neardup.NODE).count() == 300
