"""Language identification by segmentation-marginalised unigrams.

Every language has probabilities over the pieces of one fixed public
vocabulary, fitted by expectation-maximisation.  The probability of a word is
the sum over *all* its segmentations into pieces, which the forward algorithm
takes in one pass; a text's is the product over its words.  Words are runs of
letters, lower-cased; pieces never cross them, so each distinct word of a
slice of documents is scored once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm._text import Memo, bucket_of, keep_texts, map_texts, segment_sums, slices, small_batches, space_words

START = "▁"
UNKNOWN = 1e-7  # share of each character that no piece covers
SCALE = 16  # places after which forward sums are scaled: none can leave the range of doubles
CHUNK = 1 << 18  # characters whose pieces are looked up at a time
BASE = np.uint64(0x9E3779B97F4A7C15)
LETTERS = regex.compile(r"\p{L}+")


def vocabulary(path: str) -> list[str]:
    """Lower-cased pieces of letters of a sentencepiece file, in sorted order."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    return sorted({p for p in pieces if p and LETTERS.fullmatch(p.removeprefix(START) or "x")})


def letter_runs(unit: str) -> list[str]:
    return [unit.lower()] if unit.isascii() and unit.isalpha() else [x.lower() for x in LETTERS.findall(unit)]


class Lattice:
    """All places of vocabulary pieces in words, found by rolling hashes."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.keys, self.ids = [], []  # of the pieces of each length, in the order of their hashes
        by_length: list[list[int]] = [[] for _ in range(self.longest)]
        for i, p in enumerate(pieces):
            by_length[len(p) - 1].append(i)
        for own in by_length:
            hashed = np.array([self._hash(pieces[i]) for i in own], np.uint64)
            order = np.argsort(hashed)
            self.keys.append(hashed[order])
            self.ids.append(np.array(own, np.int32)[order] + 1)  # id 0: no piece

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h + ord(c) + 1) * int(BASE) & 0xFFFFFFFFFFFFFFFF
        return h

    def places(self, chars: np.ndarray) -> list[np.ndarray]:
        """``[k - 1][:, i]``: the piece of the ``k`` characters from place ``i`` on."""
        out, h = [], np.zeros(chars.shape, np.uint64)
        for k in range(1, min(self.longest, chars.shape[1]) + 1):
            h = (h[:, : chars.shape[1] + 1 - k] + chars[:, k - 1 :] + np.uint64(1)) * BASE
            keys, ids = self.keys[k - 1], self.ids[k - 1]
            if len(keys):
                at = np.searchsorted(keys, h)
                at[at == len(keys)] = 0
                out.append(np.where(keys[at] == h, ids[at], 0))
            else:
                out.append(np.zeros(h.shape, np.int32))
        return out

    def groups(self, words: list[str]):
        """Yields ``(rows, chars)`` for words of one length each, behind the mark
        of a word's start."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        ranked = size[order]
        at = 0
        while at < len(order):
            n = ranked[at]
            to = min(int(np.searchsorted(ranked, n, "right")), at + max(1, CHUNK // int(n + 1)))
            rows = order[at:to]
            text = "".join(START + words[i] for i in rows)
            yield rows, np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(len(rows), n + 1)
            at = to

    def forward(self, chars: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Logarithms of the summed probability of *all* segmentations of each
        row, for each language.  ``share``: of each piece (row 0: none) and language.

        ``alpha[j]`` sums those of the first j characters.  It needs the last
        ``longest`` sums only, and these are scaled together now and then: rows
        of any length are summed whole.
        """
        n, most = chars.shape[1], self.longest
        window = [np.ones((len(chars), share.shape[1]))]  # alpha of the last places, scaled
        scale = np.zeros((len(chars), share.shape[1]))
        ids: list[np.ndarray] = []
        base = end = 0  # the places whose pieces are known
        for j in range(1, n + 1):
            if j > end:
                base = max(0, j - most)
                end = min(n, base + max(CHUNK // max(1, len(chars)), 2 * most))
                ids = self.places(chars[:, base:end])
            total = window[-1] * UNKNOWN  # any character may stand alone
            for k in range(1, min(most, j) + 1):
                start = j - k - base
                if k <= len(ids) and 0 <= start < ids[k - 1].shape[1]:
                    piece = ids[k - 1][:, start]
                    hit = np.flatnonzero(piece)
                    if len(hit) * 2 > len(piece):
                        total += window[-k] * share[piece]
                    elif len(hit):
                        total[hit] += window[-k][hit] * share[piece[hit]]
            window = [*window[-most + 1 :], total] if most > 1 else [total]
            if j % SCALE == 0:
                scale += np.log(total)
                window = [w / total for w in window]
        return scale + np.log(window[-1])

    def log_probability(self, words: list[str], share: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), share.shape[1]))
        for rows, chars in self.groups(words):
            out[rows] = self.forward(chars, share)
        return out

    def _sums(self, ids: list[np.ndarray], share: np.ndarray, n: int, back: bool) -> tuple[np.ndarray, np.ndarray]:
        """Forward (or backward) sums at every place of rows of one language, and
        the logarithms by which they are scaled."""
        rows, scaled = len(ids[0]), n >= SCALE
        sums, logs = np.zeros((n + 1, rows)), np.zeros((n + 1, rows))
        sums[n if back else 0] = 1
        for step in range(1, n + 1):
            j = n - step if back else step
            one = j + 1 if back else j - 1
            logs[j] = logs[one]
            total = sums[one] * UNKNOWN
            for k in range(1, min(len(ids), step) + 1):
                other, start = (j + k, j) if back else (j - k, j - k)
                piece = ids[k - 1][:, start]
                hit = np.flatnonzero(piece)
                if len(hit):
                    more = sums[other, hit] * share[piece[hit]]
                    total[hit] += more * np.exp(logs[other, hit] - logs[j, hit]) if scaled else more
            if step % SCALE == 0:
                logs[j] += np.log(total)
                total = np.ones(rows)
            sums[j] = total
        return sums, logs

    def fit(self, words: list[str], counts: np.ndarray, rounds: int) -> np.ndarray:
        """Piece shares of one language by expectation-maximisation."""
        share = np.full(len(self.pieces) + 1, 1 / (len(self.pieces) + 1))
        share[0] = 0
        groups = [(rows, self.places(chars), chars.shape[1]) for rows, chars in self.groups(words)]
        for _ in range(rounds):
            got = np.zeros(len(share))
            for rows, ids, n in groups:
                alpha, a = self._sums(ids, share, n, False)
                beta, b = self._sums(ids, share, n, True)
                whole = np.log(alpha[n]) + a[n]
                weight = counts[rows]
                for k, at in enumerate(ids, 1):
                    start, word = np.nonzero(at.T)
                    piece = at[word, start]
                    part = np.exp(a[start, word] + b[start + k, word] - whole[word])
                    got += np.bincount(piece, alpha[start, word] * beta[start + k, word] * share[piece] * part * weight[word], len(share))
            got[0] = 0
            share = (got + 0.05) / (got.sum() + 0.05 * len(self.pieces))
            share[0] = 0
        return share[:, None]


def fit(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, rounds: int = 5,
    most_languages: int = 1000,
):
    """``(languages, pieces, shares)`` from rows whose crc32(id) mod 3 is not 1.

    A bounded sample of labelled rows is used: rows of a language are taken by
    a hash threshold on id and text that expects ``per_language`` of them (all,
    where there are fewer).  Their words are counted on the executors; the
    counts are collected, not the texts.  Repeated rows are one row to the
    threshold, so one text repeated often is in the sample with all its copies
    or with none.  Rows with a null text or language are left out; no labelled
    rows give no languages.  More than ``most_languages`` labels are an error.
    """
    spark = docs.sparkSession
    text, lang = F.col(f"`{text_col}`").cast("string"), F.col(f"`{lang_col}`").cast("string")
    known = docs.filter(bucket_of(id_col, 3) != 1).select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text"), lang.alias("_lang"))
    known = known.filter("_text IS NOT NULL AND _lang IS NOT NULL")
    counts = {r[0]: r[1] for r in known.groupBy("_lang").count().limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} different values of {lang_col}")
    lattice = Lattice(vocabulary(vocabulary_path))
    if not counts:
        return [], lattice.pieces, np.zeros((len(lattice.pieces) + 1, 0))
    threshold = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(1.0, per_language / n))])[F.col("_lang")]
    uniform = F.pmod(F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit("")), "_text"), F.lit(1 << 20)) / float(1 << 20)
    sample = known.filter(uniform < threshold).select("_lang", "_text")
    small_batches(spark)

    def count(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                tally: dict[tuple[str, str], int] = {}
                for name in pc.unique(part.column("_lang")).to_pylist():
                    words = space_words(part.filter(pc.equal(part.column("_lang"), name)).column("_text"))
                    for unit, n in zip(words.distinct, np.bincount(words.codes, minlength=len(words.distinct)).tolist()):
                        for run in letter_runs(unit):
                            tally[name, run] = tally.get((name, run), 0) + n
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in tally], pa.string()), pa.array([k[1] for k in tally], pa.string()), pa.array(list(tally.values()), pa.int64())], ["lang", "word", "n"])

    tallies = sample.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    languages, shares = sorted(counts), []
    for name in languages:
        own = tallies.filter(pc.equal(tallies["lang"], name))
        shares.append(lattice.fit(own["word"].to_pylist(), own["n"].to_numpy().astype(float), rounds))
    return languages, lattice.pieces, np.concatenate(shares, axis=1)


def identify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", unknown: str = "und") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    ``score`` is the posterior of ``lang_pred`` under equal priors; ties go to
    the language that sorts first.  Null texts, texts without a letter, and all
    texts where no language was learned get ``und`` and 0.  Repeated rows and
    null ids pass through; other columns are not read.
    """
    def make():
        posteriors = _scorer(model)

        def work(ids, texts):
            best, score, none = posteriors(texts)
            return [ids, [unknown if no else model[0][b] for b, no in zip(best, none)], np.where(none, 0.0, score)]

        return work

    kind = dict(docs.dtypes)[id_col]
    out = map_texts(docs, id_col, text_col, f"doc_id {kind}, lang_pred string, score double", make)
    return out.select("doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def keep(docs: DataFrame, model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is found with a posterior of ``least``
    or more; null texts and texts without a letter go."""

    def make():
        posteriors = _scorer(model)

        def mask(texts):
            _, score, none = posteriors(texts)
            return ~none & (score >= least)

        return mask

    return keep_texts(docs, text_col, make)


def _scorer(model):
    """``texts -> (best language, its posterior, whether there is none)``."""
    languages, pieces, shares = model
    lattice = Lattice(pieces)

    def fill(units: list[str]) -> np.ndarray:
        """Log-probabilities of the units' words, and the number of letters."""
        runs = [letter_runs(u) for u in units]
        ends = np.cumsum([0, *map(len, runs)])
        flat = [r for rs in runs for r in rs]
        coded = pa.array(flat, pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        table = np.zeros((len(distinct), len(languages) + 1))
        if distinct:
            table[:, :-1] = lattice.log_probability(distinct, shares)
            table[:, -1] = list(map(len, distinct))
        return segment_sums(table[coded.indices.to_numpy(zero_copy_only=False)], ends)

    memo = Memo(fill)

    def posteriors(texts: pa.Array):
        words = space_words(texts)
        rows = memo.look(words.distinct)
        total = words.sums(rows) if len(words.codes) else np.zeros((len(texts), len(languages) + 1))
        logs, none = total[:, :-1], total[:, -1] == 0
        if not languages:
            return np.zeros(len(texts), int), np.zeros(len(texts)), np.ones(len(texts), bool)
        score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        return logs.argmax(axis=1), score, none

    return posteriors
