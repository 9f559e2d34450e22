"""Byte-pair merges of many short words in step.

A row a word, a column a symbol, and beside each symbol the rank of the merge with its right neighbour.  A step merges in every
row the pair of least rank, the leftmost of equals, as the library does one word at a time; rows without a pair are done.
"""

from __future__ import annotations

import numpy as np

_NONE = 1 << 30
_BITS = 18
_MASK = (1 << _BITS) - 1


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)


class Merges:
    """For a byte-level BPE model with a suffix at word ends; ``fits`` says whether a file's model is one."""

    @staticmethod
    def fits(model: dict) -> bool:
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        return plain and model.get("type") == "BPE" and bool(model.get("end_of_word_suffix")) and len(model["vocab"]) < 1 << 17

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        # the byte-level alphabet: bytes that show stand for themselves, the others for characters from 256 on, in order
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = iter(range(256, 512))
        chars = [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int32)
        self.last = np.array([vocab[c + end] for c in chars], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        h = np.array([vocab[a] << 17 | vocab[b] for a, b in pairs], dtype=np.int64)
        self.into = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.key, self.rank = np.full(1 << _BITS, -1, dtype=np.int64), np.full(1 << _BITS, _NONE, dtype=np.int32)
        slot, live = _slot(h), np.arange(len(h))
        while len(live):
            free = live[self.key[slot[live]] < 0]
            new = free[np.unique(slot[free], return_index=True)[1]]
            self.key[slot[new]], self.rank[slot[new]] = h[new], new
            live = np.setdiff1d(live, new, assume_unique=True)
            taken = live[self.key[slot[live]] >= 0]
            slot[taken] = (slot[taken] + 1) & _MASK

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = a.astype(np.int64) << 17 | b
        slot = _slot(h)
        k = self.key.take(slot)
        out = np.where(k == h, self.rank.take(slot), _NONE).astype(np.int32)
        live = np.flatnonzero((k != h) & (k >= 0))
        while len(live):
            s = (slot.take(live) + 1) & _MASK
            slot[live] = s
            k = self.key.take(s)
            hit = k == h.take(live)
            out[live[hit]] = self.rank.take(s[hit])
            live = live[~hit & (k >= 0)]
        return out

    def encode(self, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids (a row a word) and how many, of the words text[start : start + size]."""
        n, width = len(start), int(size.max())
        col, row = np.arange(width), np.arange(n)
        s = self.inner.take(text.take(np.minimum(start[:, None] + col, len(text) - 1)))
        s[row, size - 1] = self.last.take(text.take(start + size - 1))
        size = size.copy()
        r = np.full((n, width), _NONE, dtype=np.int32)
        i, j = np.nonzero(col[1:] < size[:, None])
        r[i, j] = self.ranks(s[i, j], s[i, j + 1])
        out, n_out = s.copy(), size.copy()
        while True:
            j = r.argmin(1)
            best = r[np.arange(len(r)), j]
            go = best < _NONE
            if not go.all():
                out[row[~go]], n_out[row[~go]] = s[~go], size[~go]
                s, r, size, row, j, best = s[go], r[go], size[go], row[go], j[go], best[go]
            if not len(row):
                return out, n_out
            k = np.arange(len(row))
            s[k, j] = self.into.take(best)
            after = col[:-1] > j[:, None]  # what follows the merged pair moves up
            np.copyto(s[:, :-1], s[:, 1:].copy(), where=after)
            np.copyto(r[:, :-1], r[:, 1:].copy(), where=after)
            r[:, -1] = _NONE
            size -= 1
            r[k, j] = _NONE
            for q, d in ((np.flatnonzero(j + 1 < size), 0), (np.flatnonzero(j > 0), 1)):
                c = j[q] - d
                r[q, c] = self.ranks(s[q, c], s[q, c + 1])
