"""Toxicity by a factorization machine over hashed terms.

A term is a word or a short prefix of one.  The machine scores a text by
``w0 + sum(w_i) + sum over pairs <v_i, v_j>`` over its distinct terms: the
pairwise part learns combinations, such as an insult with a group mention,
that additive weights miss.  It costs one pass: half of
``(sum v)^2 - sum v^2`` over the factors.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm._text import Memo, bucket_of, map_texts, segment_sums, space_words

BITS = 20
PREFIXES = (4, 5)
WORD = regex.compile(r"[\p{L}\p{N}]+")


def terms(unit: str) -> list[int]:
    """Hashed terms of a unit: its words and their prefixes."""
    out = []
    for word in WORD.findall(unit.lower()):
        out.append(xxhash.xxh32_intdigest(word) >> (32 - BITS))
        out += [xxhash.xxh32_intdigest(word[:n], n) >> (32 - BITS) for n in PREFIXES if len(word) > n]
    return out


class TermSets:
    """Distinct hashed terms of each text, ascending, as ``(ids, offsets)``."""

    def __init__(self):
        self.memo, self.flat = Memo(self._fill), np.zeros(0, np.int64)

    def _fill(self, units: list[str]) -> np.ndarray:
        """Where the terms of each unit begin in ``flat``, and how many they are."""
        if not self.memo.at:  # the memo has forgotten all units
            self.flat = np.zeros(0, np.int64)
        rows = [terms(u) for u in units]
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        start = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(rows), np.int64, size.sum())])
        return np.stack([start, size], 1)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = space_words(texts)
        n = len(texts)
        if not len(words.codes):
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        start, size = self.memo.look(words.distinct).T
        doc = np.repeat(np.arange(n), words.counts)
        used = size[words.codes] > 0
        pair = _distinct(doc[used] * len(words.distinct) + words.codes[used])  # units of each text
        doc, code = pair // len(words.distinct), pair % len(words.distinct)
        got = size[code]
        at = np.repeat(start[code] - (np.cumsum(got) - got), got) + np.arange(got.sum())
        both = _distinct((np.repeat(doc, got) << BITS) | self.flat[at])
        return both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(n + 1))


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


class Machine:
    """Weights of all hashed terms of the training texts.

    How far a term is trusted depends on its evidence: the log-likelihood ratio
    ``g`` of its presence scales the term by ``(g / (g + trust)) ** 3``, so that
    the many terms that tell nothing are held near zero and none is left out.
    The scales are part of the fitted weights.
    """

    def __init__(self, factors: int = 8, trust: float = 10.0, epochs: int = 20, rate: float = 0.1, l2: float = 1e-5, seed: int = 7):
        self.factors, self.trust, self.epochs, self.rate, self.l2, self.seed = factors, trust, epochs, rate, l2, seed
        self.bias, self.terms = 0.0, np.zeros(0, np.int64)
        self.w, self.v = np.zeros(0), np.zeros((0, factors))

    @property
    def index(self) -> dict[int, int]:
        """Hashed term -> its place in ``w`` and ``v``."""
        return dict(zip(self.terms.tolist(), range(len(self.terms))))

    def places(self) -> np.ndarray:
        """The place of every possible hashed term; -1 for those without weights."""
        out = np.full(1 << BITS, -1, np.int32)
        out[self.terms] = np.arange(len(self.terms))
        return out

    def _scales(self, ids: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashed terms that occur, and the scale of each."""
        seen = np.bincount(ids, minlength=1 << BITS).astype(float)
        toxic = np.bincount(ids, np.repeat(y, np.diff(offsets)), 1 << BITS)
        share = (y.sum() + 1) / (len(y) + 2)

        def part(k, expected):
            return np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(expected, 1e-9)), 0)

        gain = np.maximum(part(toxic, seen * share) + part(seen - toxic, seen * (1 - share)), 0)
        live = np.flatnonzero(seen)
        return live, (gain[live] / (gain[live] + self.trust)) ** 3

    def table(self) -> np.ndarray:
        """For each place its factors, and ``w - sum(v^2) / 2``: the part of the score that is a plain sum."""
        v = self.v.astype(np.float64)
        return np.concatenate([v, (self.w - 0.5 * (v**2).sum(1))[:, None]], 1)

    def raw(self, ids: np.ndarray, offsets: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        """Scores of texts whose terms have the places ``ids``."""
        total = segment_sums((self.table() if table is None else table)[ids], offsets)
        return self.bias + total[:, -1] + 0.5 * (total[:, :-1] ** 2).sum(1)

    def scorer(self):
        """``score(ids, offsets) -> probabilities`` for hashed terms; those without weights add nothing."""
        places, table = self.places(), self.table()

        def score(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
            at = places[ids]
            known = at >= 0
            left = np.concatenate(([0], np.cumsum(known)))[offsets]
            return 1 / (1 + np.exp(-np.clip(self.raw(at[known], left, table), -500, 500)))

        return score

    @staticmethod
    def _batch(ids: np.ndarray, offsets: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms of a minibatch, and a bit for each text and term."""
        n = np.diff(offsets)[docs]
        flat = ids[np.repeat(offsets[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        used, code = np.unique(flat, return_inverse=True)
        has = np.zeros((len(docs), len(used)), bool)
        has[np.repeat(np.arange(len(docs)), n), code] = True
        return used, np.packbits(has, axis=1)

    def fit(self, ids: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> Machine:
        """AdaGrad on logistic loss over minibatches of 64 texts, dealt once and
        taken in a new order each epoch; ``ids`` are hashed terms.

        A minibatch is a 0/1 matrix of its texts and terms, kept as bits; one
        product sums the weights of each text and one the errors of each term.
        """
        if not len(y):
            return self
        self.terms, scale = self._scales(ids, offsets, y)
        ids, scale = self.places()[ids], scale.astype(np.float32)
        rng = np.random.default_rng(self.seed)
        weights = np.zeros((len(self.terms), self.factors + 1), np.float32)  # the factors, then w
        weights[:, :-1] = rng.normal(0, 0.01, (len(self.terms), self.factors))
        share = (y.sum() + 1) / (len(y) + 2)
        self.bias = float(np.log(share / (1 - share)))
        squares, bias_squares = np.full(weights.shape, 1e-4, np.float32), 1e-4
        order = rng.permutation(len(y))
        dealt = [order[at : at + 64] for at in range(0, len(order), 64)]
        batches = [(y[docs], *self._batch(ids, offsets, docs)) for docs in dealt]
        for _ in range(self.epochs):
            for k in rng.permutation(len(batches)):
                wanted, used, bits = batches[k]
                has = np.unpackbits(bits, axis=1, count=len(used)).astype(np.float32)
                old, own = weights[used], scale[used, None]
                x = old * own
                v = x[:, :-1].copy()
                x[:, -1] -= 0.5 * (v**2).sum(1)
                total = has @ x
                raw = self.bias + total[:, -1] + 0.5 * (total[:, :-1] ** 2).sum(1)
                error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - wanted
                self.bias -= self.rate * error.mean() / np.sqrt(bias_squares := bias_squares + error.mean() ** 2)
                total[:, -1] = 1
                step = has.T @ (error[:, None] * total).astype(np.float32)
                step[:, :-1] -= v * step[:, -1:]
                step = step * own + self.l2 * old
                seen = squares[used] + step**2
                squares[used] = seen
                weights[used] = old - self.rate * step / np.sqrt(seen)
        weights *= scale[:, None]
        self.w, self.v = weights[:, -1].copy(), weights[:, :-1].copy()
        return self


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _text, _label`` of about ``most`` labelled rows whose crc32(id)
    mod 5 is not 0: all of them, or hash thresholds that expect ``most``.

    The sampled labels (a few tens of bytes each) are broadcast.  Of several
    labels of an id the largest counts; a null label or id counts for nothing.
    Rows of ``docs`` that repeat an id are counted before they are taken, so
    they are thinned out to ``most`` too; equal rows are one.  A null text is a
    row without words.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (bucket_of(id_col, 5) != 0))
    known = known.groupBy(F.col(id_col).alias("_of")).agg(F.max(label).alias("_label"))
    n = known.count()

    def below(share: float, *columns):
        return F.pmod(F.xxhash64(*columns), F.lit(1 << 20)) / float(1 << 20) < share

    picked = known.filter(below(min(1.0, most / max(1, n)), F.col("_of").cast("string")))
    ids = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    rows = ids.select("_id").join(F.broadcast(picked), F.col("_id") == F.col("_of")).count()
    joined = ids.join(F.broadcast(picked), ids["_id"] == picked["_of"]).select("_id", "_text", "_label")
    again = F.concat_ws("|", F.lit("row"), F.col("_id").cast("string")), F.coalesce("_text", F.lit(""))
    return joined.filter(below(min(1.0, most / max(1, rows)), *again)).dropDuplicates(["_id", "_text"])


def fit(docs: DataFrame, labels: DataFrame, most: int = 8000, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> Machine:
    """A machine fitted on at most about ``most`` labelled rows (see
    ``labelled_sample``); their term ids (not their texts) are collected to the
    driver.  Without labelled rows every text scores a half."""
    sample = labelled_sample(docs, labels, label, most, id_col, text_col)

    def run(batches):
        sets = TermSets()
        for batch in batches:
            ids, offsets = sets.of(batch.column("_text"))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            marks = pa.array([xxhash.xxh64_intdigest(t or "") >> 1 for t in batch.column("_text").to_pylist()], pa.int64())  # rows of one id keep an order
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(batch.column("_label").to_pylist(), pa.int32()), lists, marks], ["id", "label", "terms", "mark"])

    kind = dict(sample.dtypes)["_id"]
    got = sample.mapInArrow(run, f"id {kind}, label int, terms array<int>, mark bigint").toArrow().combine_chunks().sort_by([("id", "ascending"), ("mark", "ascending")])
    terms_ = got["terms"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    lists = terms_ if isinstance(terms_, pa.ListArray) else pa.concat_arrays(terms_.chunks)
    offsets = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    return Machine().fit(lists.flatten().to_numpy().astype(np.int64), offsets, got["label"].to_numpy().astype(float))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Null and empty texts have no terms and score the machine's prior.  Repeated
    rows and null ids pass through; other columns are not read.
    """

    def make():
        sets, chance = TermSets(), machine.scorer()

        def work(ids, texts):
            p = chance(*sets.of(texts))
            return [ids, p, (p >= 0.5).astype(np.int32)]

        return work

    kind = dict(docs.dtypes)[id_col]
    out = map_texts(docs, id_col, text_col, f"doc_id {kind}, score double, predicted int", make)
    return out.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
