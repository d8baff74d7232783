"""op7_bpe's digests come from the ids and texts that ``encode`` returns."""

import hashlib

import pytest

pytest.importorskip("public_tokenizers")


def test_digests_are_of_encoded_documents(spark, monkeypatch):
    import public_tokenizers
    from pyspark.sql import functions as F

    from basalt.llm import bpe, queries

    real = bpe.encode
    docs = spark.createDataFrame([(1, "One two 3"), (2, None), (None, "<|endoftext|> Ünï x")], "doc_id bigint, text string")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    path = public_tokenizers.path("word_bpe_49k.json")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    wanted = {(r.doc_id, len(r.ids), sha(" ".join(map(str, r.ids))), sha(r.decoded)) for r in real(docs, path).collect()}
    rows = queries.op7_bpe(spark, "")
    assert {tuple(r) for r in rows.collect()} == wanted
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    monkeypatch.setattr(bpe, "encode", lambda *a: real(*a).withColumn("decoded", F.lit("other")))
    assert {r.decoded_sha256 for r in queries.op7_bpe(spark, "").collect()} == {sha("other")}
