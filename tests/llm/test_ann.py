"""Nearest neighbours: recall, exact scores, odd vectors."""

import numpy as np
import pytest

from basalt.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, extra string, vec int"


def brute(x, ids, query, k):
    d = ann.distances(x, x[query])
    order = [i for i in np.lexsort((ids, d)) if i != query][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in row], "e", 1) for i, row in zip(ids if ids is not None else range(len(x)), x)], SCHEMA)


def lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def test_hadamard_is_orthonormal():
    h = ann.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))


def test_recall_and_scores(spark):
    x = np.random.default_rng(0).normal(size=(2000, 32)).astype(np.float32).astype(float)
    got = lists(ann.search(frame(spark, x), "id % 50 = 0"))
    ids, found = np.arange(len(x)), []
    for q in range(0, 2000, 50):
        wanted = dict(brute(x, ids, q, 10))
        mine = got[q]
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(s == float(ann.distances(x[v : v + 1], x[q])[0]) for _, v, s in mine)
        found.append(len(wanted.keys() & {v for _, v, _ in mine}) / 10)
    assert np.mean(found) >= 0.9
    truth = lists(ann.exact(frame(spark, x), [(0, x[0].tolist())]))
    assert [v for _, v, _ in truth[0]] == [v for v, _ in brute(x, ids, 0, 10)]


def test_copies_and_ties_are_exact(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 8)), 300, 0), rng.normal(size=(5, 8))]).astype(np.float32).astype(float)
    got = lists(ann.search(frame(spark, x), "id % 100 = 0", k=10))
    for q in (0, 100, 200):
        assert [v for _, v, _ in got[q]] == [v for v in range(12) if v != q][:10]
        assert all(s == 0 for _, _, s in got[q])


def test_dense_cluster_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(1, 16)) + rng.normal(size=(600, 16)) * 1e-3).astype(np.float32).astype(float)
    got = lists(ann.search(frame(spark, x), "id % 200 = 0"))
    for q, mine in got.items():
        assert [v for _, v, _ in mine] == [v for v, _ in brute(x, np.arange(600), q, 10)]


def test_odd_vectors_take_no_part(spark):
    good = [[1.0, 0.0, 0.5], [0.9, 0.1, 0.5], [-1.0, 0.2, 0.1]]
    rows = [(0, good[0], "", 0), (1, good[1], "", 0), (2, good[2], "", 0), (3, None, "", 0), (4, [0.0, 0.0, 0.0], "", 0), (5, [1.0, None, 0.0], "", 0)]
    rows += [(6, [float("nan"), 1.0, 0.0], "", 0), (7, [float("inf"), 1.0, 0.0], "", 0), (8, [], "", 0), (None, good[0], "", 0), (9, [1.0, 2.0], "", 0), (0, good[0], "", 0), (100, None, "", 0)]
    got = lists(ann.search(spark.createDataFrame(rows, SCHEMA), "id % 100 = 0"))
    assert list(got) == [0] and [v for _, v, _ in got[0]] == [1, 2]
    assert ann.search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_indexes_have_more_levels():
    small, large = (ann.CrossPolytope(64, n, 2, 256, 1) for n in (5_000, 50_000_000))
    assert small.levels == [128] and len(large.levels) > 1
    x = np.random.default_rng(3).normal(size=(20, 64))
    probes = large.probes(x, 0, 0.25, 0.7)
    assert probes.shape[1] > 32 and (probes == large.buckets(x, 0)[:, None]).any(1).all()


@pytest.mark.parametrize("k", [1, 3])
def test_fewer_candidates_than_k(spark, k):
    x = np.eye(4)[:3]
    got = lists(ann.search(frame(spark, x), "id = 0", k=k))
    assert len(got[0]) == min(k, 2)


def test_queries_with_few_rows_in_their_buckets_scan_all(spark, monkeypatch):
    """Rare lengths and outliers beside a dense cluster, with the query's own parameters."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 512)
    rng = np.random.default_rng(4)
    sets = [rng.normal(size=(n, dim)) for dim in range(20, 32) for n in (3 + dim % 9,)]
    sets.append(np.concatenate([rng.normal(size=(3, 64)), rng.normal(size=(1, 64)) + rng.normal(size=(2000, 64)) * 1e-3]))
    rows, wanted = [], {}
    for s, x in enumerate(sets):
        x = x.astype(np.float32).astype(float)
        ids = np.concatenate([100 * (3 * s + np.arange(3)), 100_001 + 100_000 * s + 2 * np.arange(len(x) - 3)])
        wanted |= {int(ids[i]): [v for v, _ in brute(x, ids, i, 10)] for i in range(3)}
        rows += [(int(i), [float(v) for v in row], "e", 1) for i, row in zip(ids, x)]
    got = lists(ann.search(spark.createDataFrame(rows, SCHEMA), "id % 100 = 0", k=10))
    assert got.keys() == wanted.keys()
    for q, near in wanted.items():
        assert len(got[q]) == len(near)
        if len(near) < 10:
            assert [v for _, v, _ in got[q]] == near


@pytest.mark.parametrize("rows", [1, 2, 3, 8, 12, 40])
def test_small_tables_return_all_that_are_owed(spark, rows):
    """The query's own parameters: ten neighbours, or all where there are fewer."""
    for dim in (8, 64):
        x = np.random.default_rng(rows).normal(size=(rows, dim)).astype(np.float32).astype(float)
        ids = np.arange(rows) * 50
        got = lists(ann.search(frame(spark, x, ids)))
        wanted = {int(i): brute(x, ids, at, 10) for at, i in enumerate(ids) if i % 100 == 0 and rows > 1}
        assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in wanted.items()}
        if rows <= 11:
            assert {q: [(v, d) for _, v, d in near] for q, near in got.items()} == wanted


@pytest.mark.parametrize(("rows", "per_bucket", "levels"), [(300, 32, 1), (1000, 32, 1), (6000, 4, 2), (6000, 0.5, 2), (6000, 0.05, 3)])
def test_recall_at_several_sizes_and_levels(spark, rows, per_bucket, levels):
    """At the default probes, in data without structure, against brute force."""
    x = np.random.default_rng(rows).normal(size=(rows, 32)).astype(np.float32).astype(float)
    assert len(ann.CrossPolytope(32, rows, 8, per_bucket, 11).levels) == levels
    got = lists(ann.search(frame(spark, x), f"id % {max(1, rows // 40)} = 0", rows_per_bucket=per_bucket))
    hits = [len({v for v, _ in brute(x, np.arange(rows), q, 10)} & {v for _, v, _ in near}) / 10 for q, near in got.items()]
    assert len(hits) >= 40 and np.mean(hits) >= 0.9


def test_shelves_hold_whole_buckets():
    one = ann.CrossPolytope(64, 5_000_000, 2, 32, 1)
    assert len(one.levels) > 2 and 1 < one.shelf < one.buckets_all
    assert one.rows / (one.buckets_all // one.shelf) >= ann.SHELF_ROWS


def test_the_query_against_brute_force(spark):
    """op10 as registered: scores are exact, and recall is 0.9 or more."""
    from basalt.llm.queries import QUERIES

    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = lists(QUERIES["op10_nearest"](spark, folder))
    assert sorted(got) == sorted(int(i) for i in ids if i % 100 == 0)
    hits = []
    for q, near in got.items():
        at = int(np.flatnonzero(ids == q)[0])
        assert [r for r, _, _ in near] == list(range(1, 11))
        assert all(d == float(ann.distances(x[ids == v], x[at])[0]) for _, v, d in near)
        hits.append(len({v for v, _ in brute(x, ids, at, 10)} & {v for _, v, _ in near}) / 10)
    assert np.mean(hits) >= 0.9
    print("recall", np.mean(hits))
