"""The pipeline's stages against brute force, and the queries' columns."""

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_follow_on_each_other(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = frames[name] = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.count())
        if name != "bpe":
            assert docs.columns == columns
    assert kept[1] <= kept[0] and kept[2] < kept[1] and kept[3] < kept[2] and kept[4] >= kept[3] and kept[5] == kept[4]
    before = {r.doc_id: r.text for r in frames["near_dedup"].collect()}
    assert {r.doc_id for r in frames["source_mix"].select("doc_id").collect()} == set(before)  # nothing is lost
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for r in frames["bpe"].collect():
        assert r.ids == tok.encode(before[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {r.doc_id for r in frames["quality"].select("doc_id").collect()}
    known = [d for d in labels if d in {r.doc_id for r in frames["language_id"].select("doc_id").collect()}]
    assert sum((d in good) == bool(labels[d]) for d in known) / len(known) > 0.95


def test_run_and_registration(spark):
    import __spark_entry__ as entry

    queries = entry.queries()
    assert sorted(int(q[2:].split("_")[0]) for q in queries if q.startswith("op")) == list(range(1, 11))
    assert "pipeline" in queries and "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", ["op2_mixing", "op6_warc"])
def test_oracles(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(rows.columns)
    assert sorted(map(str, map(tuple, rows.select(*names).collect()))) == sorted(map(str, cursor.fetchall()))
