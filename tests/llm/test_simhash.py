"""Fingerprints, links and components against brute force."""

import random
import re

import xxhash
from pyspark.sql import functions as F

from basalt.llm import simhash
from tests.llm.conftest import prose


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    """Component of each id by all pairs of fingerprints."""
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_fingerprints_and_components(odd_docs, odd_texts):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == len(odd_texts) + 2
    prints = {i: brute_fingerprint(t) for i, t in enumerate(odd_texts)}
    wanted = brute_components(prints)
    for r in rows:
        if r.doc_id is not None:
            assert r.fingerprint == f"{prints[r.doc_id]:016x}"
            assert r.component_id == wanted[r.doc_id]
        else:
            assert r.component_id is None


def test_chains_clusters_and_copies(spark):
    """Links by fingerprint alone: a chain, a dense ball, copies and loners."""
    rng = random.Random(3)
    base = rng.getrandbits(63)
    chain = [base]
    for bit in range(0, 40):
        chain.append(chain[-1] ^ (1 << bit))
    far = rng.getrandbits(63) | 1
    ball = [far] + [far ^ (1 << i) for i in range(64)] + [far ^ (1 << i) ^ (1 << j) for i in range(8) for j in range(i)]
    loners = [rng.getrandbits(64) for _ in range(50)]
    prints = list(dict.fromkeys(chain[::2] + ball + loners))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    edges = simhash.links(df)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    wanted = brute_components({i: p for i, p in enumerate(prints)})
    groups = {}
    for i, root in wanted.items():
        groups.setdefault(root, []).append(signed[i])
    for members in groups.values():
        roots = {got.get(m, m) for m in members}
        assert roots == {min(members)} if len(members) > 1 else roots == set(members)
    # no bucket gives more links than it has members
    assert edges.count() <= 65 * len(prints)


def test_near_copies_are_caught(spark):
    rng = random.Random(9)
    texts = [prose(rng, 400) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[0]) for i in range(20)] + [(200 + i, texts[1] + " end" * (i % 2)) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    by = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert all(by[100 + i] == 0 for i in range(20)) and all(by[200 + i] == 1 for i in range(4))


def test_no_rows(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


def linked(spark, prints):
    """Whether links connect just what brute force connects."""
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint")).collect()
    assert all(bin((e.a ^ e.b) & (1 << 64) - 1).count("1") <= 2 and e.a > e.b for e in edges)
    place = {p: i for i, p in enumerate(signed)}
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for e in edges:
        x, y = sorted((root(place[e.a]), root(place[e.b])))
        parent[y] = x
    assert {i: root(i) for i in range(len(parent))} == brute_components(dict(enumerate(prints)))
    return edges


def test_buckets_of_many_fingerprints(spark):
    """All share a segment, so its one bucket is split by the other segment."""
    rng = random.Random(12)
    for low in (0, 1):
        shift = 32 * low
        base = rng.getrandbits(64)
        other = [rng.getrandbits(32) for _ in range(40)]
        spread = [base & ~(0xFFFFFFFF << shift) | (o ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(32))) << shift for o in other for _ in range(12)]
        beside = [p ^ (1 << rng.randrange(32) + 32 - shift) for p in spread[:150]]
        prints = list(dict.fromkeys(spread + beside))
        assert len(prints) > 10 * simhash.BUCKET / 2
        assert len(linked(spark, prints)) <= 33 * 2 * len(prints)


def test_small_buckets_against_all_pairs(spark, monkeypatch):
    rng = random.Random(13)
    centres = [rng.getrandbits(64) for _ in range(20)]
    prints = list(dict.fromkeys(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(15)))
    linked(spark, prints)
    monkeypatch.setattr(simhash, "BUCKET", 1)  # every bucket split
    linked(spark, prints)


def test_no_pairs_within_a_group(spark):
    """Copies are one fingerprint: they give no links at all."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("same words in every text").alias("text"))
    marked = simhash.fingerprints(docs)
    assert simhash.links(marked.select("fp").distinct()).count() == 0
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {0}
