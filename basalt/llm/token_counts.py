"""Token counts without token ids.

Pieces are counted once per distinct pre-token; a document's count is the sum,
over its pre-tokens, of frequency times pieces.  The distinct pre-tokens and
the frequencies are those of a slice of documents (and of a task's memo), so
nothing is shuffled and a frequent word or a hot source cannot gather rows in
one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from basalt.llm._merges import Merges
from basalt.llm._text import Memo, map_texts, segment_sums

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PieceCounter:
    """Pieces of texts by a byte-level BPE file (see ``token_counts``)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        self.find = regex.compile(PATTERN).findall
        self.added = regex.compile("(" + "|".join(map(regex.escape, self.merges.added)) + ")") if self.merges.added else None
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.alike: dict[str, bool] = {}
        self.memo = Memo(lambda words: self.merges.counts([w.encode() for w in words]))

    def _library(self, text: str) -> list[str]:
        return [text[a:b] for _, (a, b) in self.split(text)]

    def _alike(self, c: str) -> bool:
        """Whether the pattern here and the library's class a character alike:
        their Unicode versions differ on a few."""
        if c not in self.alike:
            beside = [f"a{c}a", f"1{c}1", f"!{c}!", f"a {c} a"]
            self.alike[c] = all(self.find(x) == self._library(x) for x in beside)
        return self.alike[c]

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii() or all(map(self._alike, set(text))):
            return self.find(text)
        return self._library(text)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text: the pieces of its pre-tokens, and one for each
        special string."""
        flat: list[str] = []
        ends, fixed = [0], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts.to_pylist()):
            segments = self.added.split(text) if self.added and text else [text]
            fixed[i] = len(segments) // 2
            for segment in segments[::2]:
                if segment:
                    flat += self.pre_tokens(segment)
            ends.append(len(flat))
        if not flat:
            return fixed
        coded = pa.array(flat).dictionary_encode()
        pieces = self.memo.look(coded.dictionary.to_pylist())
        return fixed + segment_sums(pieces[coded.indices.to_numpy()], np.array(ends))


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    Counts equal those of the ``tokenizers`` library for the file, without
    added begin or end tokens; special strings inside texts count as one token
    each.  Null and empty texts have 0 bytes and 0 tokens.  Repeated rows give
    repeated results; a null id stays null; other columns are not read.  The
    file must exist at ``tokenizer_path`` on every executor.
    """

    def make():
        counter = PieceCounter(tokenizer_path)

        def work(ids, texts):
            size = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            n = counter.counts(texts)
            return [ids, size, n, n > limit]

        return work

    kind = dict(docs.dtypes)[id_col]
    return map_texts(docs, id_col, text_col, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", make)
