"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins.  Cyclic boosting adds small shallow
trees to one lookup table per feature, and then to tables of the pairs of
features that explain most of what is left.  A text's score is a sum of table
entries: one vectorised gather for each table.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from basalt.llm._text import bucket_of, keep_texts, map_texts, segment_sums, space_words
from basalt.llm.toxicity import labelled_sample

FEATURES = (
    "log_words", "word_length", "symbol_words", "shout_words", "upper_share", "digit_share", "letter_share", "bar_words", "stop_share",
    "repeats", "distinct_share", "top_share", "line_share",
)


def features_of(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each whole text; 0 where there are no words."""
    texts = pc.fill_null(texts, "")
    words = space_words(texts)
    n = words.counts
    out = np.zeros((len(texts), len(FEATURES)))
    if not len(words.codes):
        return out
    units = pa.array(words.distinct, pa.string())
    count = lambda pattern: pc.count_substring_regex(units, pattern).to_numpy(zero_copy_only=False).astype(float)
    chars = pc.utf8_length(units).to_numpy(zero_copy_only=False).astype(float)
    upper, letters, digits = count(r"\p{Lu}"), count(r"\p{L}"), count(r"\p{N}")
    has = lambda pattern: (count(pattern) > 0).astype(float)
    table = np.stack([chars, has(r"[#*$%&@^~_=<>{}\\]"), has("!"), upper, digits, letters, has(r"\|"), has(r"[.,;:?]$")], 1)
    total = words.sums(table)
    some = np.maximum(n, 1)
    doc = np.repeat(np.arange(len(texts)), n)
    same = np.concatenate(([False], (words.codes[1:] == words.codes[:-1]) & (doc[1:] == doc[:-1])))
    pair = np.sort(doc * len(words.distinct) + words.codes)
    heads = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    runs, owner = np.diff(np.append(heads, len(pair))), pair[heads] // len(words.distinct)
    most = np.zeros(len(texts))
    np.maximum.at(most, owner, runs)
    all_chars = np.maximum(total[:, 0], 1)
    lines = pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False)
    columns = (
        np.log1p(n), total[:, 0] / some, total[:, 1] / some, total[:, 2] / some, total[:, 3] / np.maximum(total[:, 5], 1), total[:, 4] / all_chars,
        total[:, 5] / all_chars, total[:, 6] / some, total[:, 7] / some, segment_sums(same.astype(float), words.offsets) / some,
        np.bincount(owner, minlength=len(texts)) / some, most / some, lines / some,
    )
    return np.where(n[:, None] > 0, np.stack(columns, 1), 0.0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _split(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, int]:
    """Gain and place of the best cut of bins with gradient and curvature sums."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(a):
        return 0.0, 0
    gain = a**2 / (b + l2) + (g.sum() - a) ** 2 / (h.sum() - b + l2) - g.sum() ** 2 / (h.sum() + l2)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int, l2: float) -> np.ndarray:
    """Leaf value of each bin of a tree of the given depth."""
    gain, at = _split(g, h, l2) if depth and len(g) > 1 else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + l2))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1, l2), _tree(g[at:], h[at:], depth - 1, l2)])


def _grid_tree(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a two-level tree over a grid: one cut of one
    axis, then a cut of the other axis on either side."""
    best, table = 0.0, np.full(g.shape, 0.0)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(a)):
            parts = [(a[:cut].sum(0), b[:cut].sum(0)), (a[cut:].sum(0), b[cut:].sum(0))]
            leaves = [_tree(x, y, 1, l2) for x, y in parts]
            gain = sum(float(x @ leaf) for (x, _), leaf in zip(parts, leaves))
            if gain > best:
                made = np.empty(a.shape)
                made[:cut], made[cut:] = leaves
                best, table = gain, made.T if flip else made
    return best, table


class Additive:
    """Bin edges, a table per feature and a table per chosen pair."""

    def __init__(self, bins: int = 24, coarse: int = 8, rounds: int = 120, pairs: int = 6, pair_rounds: int = 40, rate: float = 0.15, l2: float = 2.0):
        self.bins, self.coarse, self.rounds, self.n_pairs, self.pair_rounds, self.rate, self.l2 = bins, coarse, rounds, pairs, pair_rounds, rate, l2
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        self.bias = 0.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def _coarse(self, at: np.ndarray) -> np.ndarray:
        return at * self.coarse // self.bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        if not len(y):
            return self
        points = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], points)) for j in range(x.shape[1])]
        at = self._bin(x)
        share = (y.sum() + 1) / (len(y) + 2)
        self.bias = float(np.log(share / (1 - share)))
        self.tables = [np.zeros(self.bins) for _ in self.edges]
        raw = np.full(len(y), self.bias)

        def sums(code: np.ndarray, size: int):
            p = _sigmoid(raw)
            return np.bincount(code, y - p, size), np.bincount(code, p * (1 - p), size)

        for _ in range(self.rounds):
            for j, table in enumerate(self.tables):
                step = self.rate * _tree(*sums(at[:, j], self.bins), 2, self.l2)
                table += step
                raw += step[at[:, j]]
        rough = self._coarse(at)
        size = self.coarse**2
        code = {k: rough[:, k[0]] * self.coarse + rough[:, k[1]] for k in combinations(range(x.shape[1]), 2)}
        grid = lambda k: [s.reshape(self.coarse, -1) for s in sums(code[k], size)]
        gains = {k: _grid_tree(*grid(k), self.l2)[0] for k in code}
        chosen = sorted(gains, key=lambda k: (-gains[k], k))[: self.n_pairs]
        self.pairs = {k: np.zeros((self.coarse, self.coarse)) for k in chosen}
        for _ in range(self.pair_rounds):
            for k in chosen:
                step = self.rate * _grid_tree(*grid(k), self.l2)[1]
                self.pairs[k] += step
                raw += step.ravel()[code[k]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self._bin(x)
        raw = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            raw += table[at[:, j]]
        rough = self._coarse(at)
        for (i, j), table in self.pairs.items():
            raw += table[rough[:, i], rough[:, j]]
        return _sigmoid(raw)


def fit(docs: DataFrame, labels: DataFrame, most: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> Additive:
    """A model fitted on at most about ``most`` labelled rows (see
    ``labelled_sample``); their features (not their texts) are collected to the
    driver.  Without labelled rows every text scores a half."""
    sample = labelled_sample(docs, labels, label, most, id_col, text_col)

    def run(batches):
        for batch in batches:
            x = features_of(batch.column("_text"))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(batch.column("_label").to_pylist(), pa.int32()), lists], ["id", "label", "x"])

    kind = dict(sample.dtypes)["_id"]
    got = sample.mapInArrow(run, f"id {kind}, label int, x array<double>").toArrow().sort_by("id")
    x = np.array(got["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return Additive().fit(x, got["label"].to_numpy().astype(float))


def score(docs: DataFrame, model: Additive, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Null, empty and blank texts have all features 0 and are scored like any
    other text.  Repeated rows and null ids pass through; other columns are
    not read.
    """

    def make():
        def work(ids, texts):
            p = model.score(features_of(texts))
            return [ids, p, (p >= threshold).astype(np.int32)]

        return work

    kind = dict(docs.dtypes)[id_col]
    out = map_texts(docs, id_col, text_col, f"doc_id {kind}, score double, predicted int", make)
    return out.select("doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, model: Additive, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more."""
    return keep_texts(docs, text_col, lambda: lambda texts: model.score(features_of(texts)) >= threshold)
