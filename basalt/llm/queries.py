"""The queries of the pipeline operators, one ``opN_<name>`` each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import ann, bpe, langid, media, mixing, quality, simhash, token_counts, toxicity, warc
from basalt.llm._text import shared_dir, table

ORACLE_SQL: dict[str, str] = {}


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.schedule(docs, budget=None, max_epochs=2.0)


ORACLE_SQL["op2_mixing"] = r"""
    WITH RECURSIVE
    d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS k,
                 greatest(CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT), 1) AS n_tokens,
                 CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS word
          FROM documents),
    totals AS (SELECT k, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS n FROM d GROUP BY k),
    shares AS (SELECT k, tokens, n, tokens / CAST(sum(tokens) OVER () AS DOUBLE) AS p FROM totals),
    listed AS (SELECT list(p) AS ps FROM shares),
    halving AS (
        SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi, ps FROM listed
        UNION ALL
        SELECT i + 1, CASE WHEN fits THEN lo ELSE mid END, CASE WHEN fits THEN mid ELSE hi END, ps
        FROM (SELECT i, lo, hi, ps, (lo + hi) / 2 AS mid,
                     list_max(list_transform(ps, lambda p: pow(p, (lo + hi) / 2 - 1)))
                     / list_min(list_transform(ps, lambda p: pow(p, (lo + hi) / 2 - 1))) <= 2.0 AS fits
              FROM halving WHERE i < 40)),
    tau AS (SELECT hi AS x FROM halving WHERE i = 40),
    norm AS (SELECT x, sum(pow(p, x)) AS z, min(pow(p, x - 1)) AS least, CAST(sum(tokens) AS DOUBLE) AS t FROM shares, tau GROUP BY x),
    plan AS (SELECT k, tokens, CAST(round(t * z / least * pow(p, x) / z) AS BIGINT) AS quota,
                    greatest(1, CAST(ceil(n / 4096.0) AS BIGINT)) AS blocks FROM shares, norm),
    turns AS (SELECT k, tokens, quota, unnest(range(0, greatest(1, CAST(ceil(quota / tokens) AS BIGINT)))) AS epoch FROM plan),
    shown AS (SELECT d.doc_id, d.source, d.n_tokens, turns.epoch, turns.quota,
                     tokens * epoch + coalesce(sum(n_tokens) OVER (
                         PARTITION BY k, epoch
                         ORDER BY md5(concat_ws('|', k, epoch, word % blocks)), word % blocks, md5(concat_ws('|', doc_id, epoch)), doc_id, n_tokens
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
              FROM d JOIN plan USING (k) JOIN turns USING (k, tokens, quota))
    SELECT doc_id, source, n_tokens, CAST(epoch AS INTEGER) AS epoch, CAST(start AS BIGINT) AS start FROM shown WHERE start < quota
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = media.store(media.media_column(table(spark, sf_dir, "documents")), shared_dir(spark, "media"))
    return media.features(media.store(media.decoded(files), shared_dir(spark, "media-pcm")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return out.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs, public_tokenizers.path("piece_bpe_32k.model")))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), is_query="id % 100 = 0", k=10)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(sha1(h), {5 * i + 1}, 5) AS BIGINT) >> {s}) & 31 AS BIGINT) + 1, 1)"
    for i in range(8)
    for s in (15, 10, 5, 0)
)
ORACLE_SQL["op6_warc"] = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
         g AS (SELECT h, max(page_id) AS m FROM p GROUP BY h)
    SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, g.d AS payload_digest,
           CASE WHEN p.page_id = g.m THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN p.page_id <> g.m THEN g.m END AS refers_to
    FROM p JOIN (SELECT h, m, {_BASE32} AS d FROM g) g ON p.h = g.h
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_mixing, op3_toxicity, op4_media, op5_simhash, op6_warc, op7_bpe, op8_quality, op9_language_id, op10_nearest)
}
