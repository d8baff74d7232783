"""Byte-level BPE by batched numpy merge rounds.

The symbols of many words lie in one flat array.  Each round finds the rank of
every adjacent pair by binary search over the sorted pair keys, takes the
lowest rank of each word, merges it, and drops words that have nothing left to
merge.  The work of a round is a few vector operations over the words still
active, whatever their number.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np

NONE = np.iinfo(np.int64).max


def byte_alphabet() -> list[str]:
    """Printable stand-in character of each byte, as byte-level BPE files use it."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in set(kept) else chr(next(moved)) for b in range(256)]


class Merges:
    """A vocabulary with ranked merges, read from a tokenizer's JSON file.

    ``rows(words)`` returns ``(ids, offsets)`` of the pieces of each word
    given as bytes.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.added: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.added.items()]}
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.width = 1 << 20
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        keys, first = np.unique(keys[order], return_index=True)  # a repeated pair keeps its first rank
        self.keys, self.rank, self.made = keys, order[first].astype(np.int64), made[order[first]]
        self.made_by_rank = made
        # A rank is plain when no pair with the symbol it makes has a lower
        # rank: then all its places in a word can merge in one round.
        lowest = np.full(max(self.tokens) + 1, NONE)
        for side in (keys // self.width, keys % self.width):
            np.minimum.at(lowest, side, self.rank)
        self.plain = lowest[made] > np.arange(len(made))

    def _ranks(self, key: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def rows(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n, done_sym, done_owner = len(words), [], []

        def finish(sym: np.ndarray, owner: np.ndarray) -> None:
            done_sym.append(sym)
            done_owner.append(owner)

        self._merge(words, finish)
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        sym, owner = np.concatenate(done_sym), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return sym[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of pieces of each word; their ids are not kept."""
        out = np.zeros(len(words), np.int64)

        def finish(sym: np.ndarray, owner: np.ndarray) -> None:
            out[:] += np.bincount(owner, minlength=len(out))

        self._merge(words, finish)
        return out

    def _merge(self, words: list[bytes], finish: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """Merges all words; ``finish`` gets the symbols of those that are done,
        and the words that they belong to."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(size)
        filled = size > 0
        sym[ends[filled] - 1] = self.last[raw[ends[filled] - 1]]
        owner = np.repeat(np.arange(n, dtype=np.int32), size)
        rank = np.full(len(sym), NONE)  # of the pair that starts here
        at = np.flatnonzero(owner[:-1] == owner[1:])
        rank[at] = self._ranks(sym[at] * self.width + sym[at + 1])
        while len(sym):
            heads = np.flatnonzero(np.concatenate(([True], owner[:-1] != owner[1:])))
            run = np.diff(np.append(heads, len(sym)))
            low = np.minimum.reduceat(rank, heads)
            over = low == NONE
            if run[over].sum() * 4 >= len(sym):
                over_here = np.repeat(over, run)
                finish(sym[over_here], owner[over_here])
                left = ~over_here
                sym, owner, rank = sym[left], owner[left], rank[left]
                low, run = low[~over], run[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero((rank == np.repeat(low, run)) & (rank != NONE))
            # Of touching places ("a a a") every second one merges, from the left.
            gap = np.diff(hit, prepend=-2) > 1
            if not gap.all():
                head = np.maximum.accumulate(np.where(gap, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - head) % 2 == 0]
            plain = self.plain[rank[hit]]
            if not plain.all():
                hit = hit[plain | np.concatenate(([True], owner[hit[1:]] != owner[hit[:-1]]))]
            sym[hit] = self.made_by_rank[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, owner, rank = sym[keep], owner[keep], rank[keep]
            # Only the pairs on either side of a merged symbol are new.
            here = hit - np.arange(len(hit))
            stale = np.zeros(len(sym), bool)
            stale[here] = True
            stale[here[here > 0] - 1] = True
            new = np.flatnonzero(stale)
            rank[new] = NONE
            new = new[new < len(sym) - 1]
            new = new[owner[new] == owner[new + 1]]
            rank[new] = self._ranks(sym[new] * self.width + sym[new + 1])
