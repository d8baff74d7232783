"""Token counts and BPE against the tokenizers library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from basalt.llm import bpe, token_counts  # noqa: E402

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def test_counts_equal_the_library(odd_docs, odd_texts):
    tok = Tokenizer.from_file(BYTES)
    rows = token_counts.token_counts(odd_docs, BYTES, limit=100).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(odd_texts) + 2
    for i, t in enumerate(odd_texts):
        n = len(tok.encode(t or "", add_special_tokens=False))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 100), repr(t)[:80]
    assert got[None].n_tokens == 3


def test_ids_and_decoded_text_equal_the_library(odd_docs, odd_texts):
    tok = Tokenizer.from_file(WORDS)
    full = {r.doc_id: r for r in bpe.encode(odd_docs, WORDS).collect()}
    for i, t in enumerate(odd_texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        assert (full[i].ids, full[i].decoded) == (ids, decoded), repr(t)[:80]
        assert full[i].n_tokens == len(ids)


def test_empty_tables(no_docs):
    assert token_counts.token_counts(no_docs, BYTES).count() == 0
    assert bpe.encode(no_docs, WORDS).count() == 0


def test_results_do_not_depend_on_the_memo(odd_texts, monkeypatch):
    a = token_counts.PieceCounter(BYTES)
    b = token_counts.PieceCounter(BYTES)
    b.memo.size = 3
    whole = a.counts(pa.array(odd_texts, pa.string()))
    parts = [b.counts(pa.array([t], pa.string()))[0] for t in odd_texts]
    assert np.array_equal(whole, parts)


def test_merges_of_a_pair_that_is_made_again():
    """A symbol that two merges make, and runs of one letter, keep the library's order."""
    coder = bpe.WordBpe(WORDS)
    tok = Tokenizer.from_file(WORDS)
    for word in ("a" * 7, "abab" * 5, "hehehehe", "oooooohhhh", "xyxyx"):
        assert coder.encode([word])[0] == tok.encode(word, add_special_tokens=False).ids


def test_counts_of_loose_texts_and_common_punctuation():
    """Line ends, double spaces, curly quotes, dashes, scripts and unassigned characters."""
    rng = random.Random(7)
    tok = Tokenizer.from_file(BYTES)
    alphabet = ["\n", "  ", "\r\n", "\t", " ", "it's", "\u201cword\u201d", "\u2014", "x\u2019s", "\u6f22\u5b57", "\u00a0", "\u3000", "123", "\u0663", "\u16ee", "\U0001faf8", "\U0001e030", "\u1c89", "e\u0301", "\U00010d4a", "..."]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    got = token_counts.PieceCounter(BYTES).counts(pa.array(texts))
    assert got.tolist() == [len(tok.encode(t, add_special_tokens=False)) for t in texts]


def test_counts_are_the_lengths_of_the_rows():
    merges = token_counts.PieceCounter(BYTES).merges
    words = [b"", b"a", b" the", b"zzzzzzzz", " d\u00e9j\u00e0".encode(), b"hello" * 30]
    assert merges.counts(words).tolist() == np.diff(merges.rows(words)[1]).tolist()
    assert merges.counts([]).tolist() == []


def test_queries_equal_the_library(spark):
    """op1 and op7 as registered, on all documents of the smallest tables."""
    from basalt.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    one, seven = (Tokenizer.from_file(p) for p in (BYTES, WORDS))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in QUERIES["op1_token_counts"](spark, folder).collect():
        assert r.n_tokens == len(one.encode(docs[r.doc_id], add_special_tokens=False))
    for r in QUERIES["op7_bpe"](spark, folder).collect():
        ids = seven.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(seven.decode(ids, skip_special_tokens=False)))
