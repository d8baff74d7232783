"""Mixtures: targets are met, and every row is shown as often as it should."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basalt.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    sizes = {"big": 400, "mid": 100, "small": 20, None: 5}
    rows = [(f"{s}-{i}", s, 1 + i % 7) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "doc_id string, source string, n bigint")


def totals(rows):
    return rows.groupBy(F.coalesce("source", F.lit("-")).alias("_key")).agg(F.sum("n").alias("tokens"))


def weights(spark_rows, x):
    t = {r._key: r.tokens for r in spark_rows.collect()}
    power = {k: (v / sum(t.values())) ** x for k, v in t.items()}
    return {k: v / sum(power.values()) for k, v in power.items()}, t


@pytest.mark.parametrize("limit", [1.5, 3.0])
def test_smallest_budget_shows_all_rows_and_keeps_the_limit(docs, limit):
    out = mixing.mix(docs, F.col("n"), max_epochs=limit, rows_per_block=32)
    seen = Counter(r.doc_id for r in out.collect())
    assert len(seen) == docs.count()
    assert max(seen.values()) <= math.ceil(limit)
    x = mixing.exponent(totals(docs), None, limit, None)
    w, t = weights(totals(docs), x)
    per = [w[k] / t[k] for k in t]
    assert max(per) / min(per) == pytest.approx(limit, rel=1e-6)
    shown = Counter()
    for r in out.select(F.coalesce("source", F.lit("-")).alias("k"), "n").collect():
        shown[r.k] += r.n
    for k in w:  # less than a document over
        assert abs(shown[k] / sum(shown.values()) - w[k]) < 0.02


def test_entropy_target(docs):
    x = mixing.exponent(totals(docs), None, None, 0.8)
    w, _ = weights(totals(docs), x)
    assert -sum(p * math.log(p) for p in w.values()) / math.log(len(w)) == pytest.approx(0.8, abs=1e-6)


def test_budget_stops_every_source(docs):
    out = mixing.mix(docs, F.col("n"), budget=600, max_epochs=2.0, rows_per_block=16)
    total = sum(r.n for r in out.collect())
    assert 600 - 4 <= total <= 600 + 4 * 7


def test_streams_have_no_gap_and_no_overlap(docs):
    rows = mixing.mix(docs, F.col("n"), max_epochs=2.0, rows_per_block=16).collect()
    for source in {r.source for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.source == source), key=lambda r: r["_start"]):
            assert r["_start"] == at
            at += r.n


def test_epochs_differ_in_order(docs):
    rows = [r for r in mixing.mix(docs, F.col("n"), max_epochs=2.0, rows_per_block=16).collect() if r.source == "small"]
    orders = [[r.doc_id for r in sorted((r for r in rows if r["_epoch"] == e), key=lambda r: r["_start"])] for e in (0, 1)]
    assert len(orders[1]) > 5 and orders[0][: len(orders[1])] != orders[1]


def test_odd_rows(odd_docs, no_docs):
    out = mixing.schedule(odd_docs, max_epochs=2.0)
    assert out.count() >= odd_docs.count() and out.filter("doc_id IS NULL").count() >= 1
    assert mixing.schedule(no_docs, max_epochs=2.0).count() == 0
    kept = mixing.mix(odd_docs, mixing.word_tokens(), max_epochs=2.0)
    assert set(odd_docs.columns) < set(kept.columns)
    with pytest.raises(ValueError):
        mixing.exponent(totals(no_docs.withColumn("n", F.lit(1))), None, None, None)


def test_weights(docs):
    got = mixing.weights(docs.withColumn("text", F.lit("a b")), target_entropy=0.9, max_epochs=None).collect()
    assert sum(r.weight for r in got) == pytest.approx(1)
    assert [r.source for r in sorted(got, key=lambda r: -r.weight)][0] == "big"
