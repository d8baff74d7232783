"""BPE encoding and decoding of whole texts by batched merge rounds.

A word is encoded once per slice of documents (see ``_merges``); a document's
ids are gathered from its words.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from basalt.llm._merges import Merges
from basalt.llm._text import Memo, map_texts, space_words

#: Fixed value: the pre-token pattern of the word-end vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SAFE_BELOW = "԰"


class WordBpe:
    """Encoder and decoder for a lower-casing BPE file with word ends."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.find = regex.compile(PATTERN).findall
        self.added = regex.compile("(" + "|".join(map(regex.escape, self.merges.added)) + ")")
        self.path, self._library = path, None
        self.memo = Memo(self._encode)

    def _pre_tokens(self, text: str) -> list[bytes]:
        if not text.isascii() and max(text) >= SAFE_BELOW:  # other scripts, dashes, curly quotes: the library's own tables
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self.path)
            text = self._library.normalizer.normalize_str(text)
            return [text[a:b].encode() for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(text)]
        return [w.encode() for w in self.find(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())]

    def _encode(self, units: list[str]) -> np.ndarray:
        """An array of id tuples, one for each unit; units hold no ASCII white space."""
        parts: list[bytes] = []
        layout: list[list[int]] = []  # of each unit: places in parts, or -1 - id for a special token
        for unit in units:
            row: list[int] = []
            for k, segment in enumerate(self.added.split(unit)):
                if k % 2:
                    row.append(-1 - self.merges.added[segment])
                elif segment:
                    new = self._pre_tokens(segment)
                    row += range(len(parts), len(parts) + len(new))
                    parts += new
            layout.append(row)
        ids, offsets = self.merges.rows(parts)
        ids, offsets = ids.tolist(), offsets.tolist()
        out = np.empty(len(units), object)
        for i, row in enumerate(layout):
            out[i] = tuple(x for p in row for x in (ids[offsets[p] : offsets[p + 1]] if p >= 0 else (-1 - p,)))
        return out

    def decode(self, ids) -> str:
        """Pieces joined by spaces: the file names no decoder of its own."""
        return " ".join(map(self.merges.tokens.__getitem__, ids))

    def words(self, texts: pa.Array):
        """The units of the texts and the id tuple of each distinct unit."""
        words = space_words(texts)
        return words, self.memo.look(words.distinct)

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)``: the ids of all texts in one array."""
        words, rows = self.words(texts)
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((x for row in rows for x in row), np.int32, size.sum())
        start = np.cumsum(size) - size
        got = size[words.codes] if len(rows) else np.zeros(0, np.int64)
        at = np.repeat((start[words.codes] if len(rows) else got) - (np.cumsum(got) - got), got) + np.arange(got.sum())
        return flat[at], np.concatenate(([0], np.cumsum(got)))[words.offsets]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        ids, offsets = self.arrays(pa.array(texts, pa.string()))
        return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids array<int>, decoded`` of every row: the ids of
    the whole text and their decoded text.  Null and empty texts have no ids
    and decode to the empty string; repeated rows and null ids pass through."""

    def make():
        coder = WordBpe(tokenizer_path)

        def work(doc_ids, texts):
            ids, offsets = coder.arrays(texts)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            decoded = [coder.decode(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]
            return [doc_ids, np.diff(offsets), lists, decoded]

        return work

    kind = dict(docs.dtypes)[id_col]
    return map_texts(docs, id_col, text_col, f"doc_id {kind}, n_tokens bigint, ids array<int>, decoded string", make, 2 << 20)
