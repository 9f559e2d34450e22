"""Whole texts to ids with a word-splitting BPE tokenizer file, by distinct word.

For tokenizers whose normaliser and pre-tokenizer never look across a space (the word-end BPE files: NFC, white space to one
space, lower case, then a split that drops white space), the ids of a text are the concatenated ids of its space-separated
pieces.  ``splits_at_spaces`` checks the file's declaration; any other tokenizer is sent whole texts.

About a megabyte of text is cut, lower-cased and hashed at a time in array operations.  A piece of plain letters, with or without
a mark at its end, is looked up by a 64-bit hash of its letters; any other piece by its bytes.  What the tables lack is encoded
once, words by ``merges`` and other pieces by the library.  Both tables are emptied when full, which bounds a worker's memory.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .common import claim, hold
from .merges import Merges

#: Longest plain piece in bytes, and longest other piece that is remembered.
MAX_PLAIN, MAX_ODD = 48, 64
#: Words, other pieces and ids in the tables before they are emptied.
MAX_WORDS, MAX_PIECES, MAX_IDS = 900_000, 150_000, 8_000_000
#: Bytes of text that are looked at together.
SPAN = 1 << 20

_U = np.uint64
_SLOT_BITS = 21
_R = 0x9E3779B97F4A7C15
_LOADED: dict[str, "WordEncoder"] = {}

# kinds of bytes: gap, letter, anything else, lead byte of the letters from À to ÿ, mark
_GAP, _LETTER, _OTHER, _LEAD, _MARK = range(5)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[[0x20, 0x0A]] = _GAP
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0xC3] = _LEAD
_KIND[[0x2C, 0x2E]] = _MARK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def splits_at_spaces(spec: dict) -> bool:
    """True if the file's parts are of the kinds for which a space is a hard boundary."""
    norm = (spec.get("normalizer") or {}).get("normalizers", [])
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [n.get("type") for n in norm] != ["NFC", "Replace", "Lowercase"] or [p.get("type") for p in pre] != ["Split", "ByteLevel"]:
        return False
    split, level = pre
    # an inverted, removed split keeps only what the pattern matches; a pattern whose classes all leave out \s can't span a space
    drops = split.get("behavior") == "Removed" and split.get("invert") is True and r"[^\s\p{L}\p{N}]+" in str(split["pattern"].get("Regex"))
    return drops and not level.get("add_prefix_space") and not level.get("use_regex") and spec.get("post_processor") is None


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(r: int, n: int) -> np.ndarray:
    """1, r, r^2, ... modulo 2^64."""
    out, k = np.ones(n, dtype=np.uint64), 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * _U(r)
        k, r = k + m, r * r & 0xFFFFFFFFFFFFFFFF
    return out


class WordEncoder:
    """ids of whole texts, as the tokenizers library gives them with add_special_tokens=False."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.by_piece = splits_at_spaces(spec)
        if self.by_piece:
            #: by id: True if the token ends a word
            self.ends = np.array([(self.lib.id_to_token(i) or "").endswith("</w>") for i in range(self.lib.get_vocab_size())])
            self.merges = Merges(spec["model"]) if Merges.fits(spec["model"]) else None
            marks = [self.lib.encode(c, add_special_tokens=False).ids for c in ",."]
            self.mark = np.zeros(256, dtype=np.uint32)
            self.mark[[0x2C, 0x2E]] = [m[0] for m in marks]
            self.power, self.inverse = _powers(_R, SPAN), _powers(pow(_R, -1, 1 << 64), SPAN)
            self.clear()

    def clear(self) -> None:
        self.key = np.zeros(1 << _SLOT_BITS, dtype=np.uint64)
        self.at, self.size = np.zeros(1 << _SLOT_BITS, dtype=np.int32), np.zeros(1 << _SLOT_BITS, dtype=np.int32)
        self.n, self.used = 0, 0
        self.pool = np.zeros(1 << 20, dtype=np.uint32)
        self.odd: dict[bytes, tuple[int, int]] = {}

    # -- tables -----------------------------------------------------------

    def _add(self, ids: np.ndarray) -> int:
        """Puts ids into the pool and gives their place."""
        at, end = self.used, self.used + len(ids)
        if end >= len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids) + 1), dtype=np.uint32)])
        self.pool[at:end] = ids
        self.used = end
        return at

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each hash, and whether it is there."""
        slot = (h >> _U(64 - _SLOT_BITS)).astype(np.int64)
        k = self.key.take(slot)
        there = k == h
        live = np.flatnonzero(~there & (k != 0))
        while len(live):
            s = (slot.take(live) + 1) & ((1 << _SLOT_BITS) - 1)
            slot[live] = s
            k = self.key.take(s)
            hit = k == h.take(live)
            there[live[hit]] = True
            live = live[~hit & (k != 0)]
        return slot, there

    def _insert(self, h: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        """Distinct hashes that aren't there."""
        slot, live = (h >> _U(64 - _SLOT_BITS)).astype(np.int64), np.arange(len(h))
        while len(live):
            free = live[self.key[slot[live]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            new = free[first]
            s = slot[new]
            self.key[s], self.at[s], self.size[s] = h[new], at[new], size[new]
            left = np.ones(len(h), dtype=bool)
            left[new] = False
            live = live[left[live]]
            taken = live[self.key[slot[live]] != 0]
            slot[taken] = (slot[taken] + 1) & ((1 << _SLOT_BITS) - 1)
        self.n += len(h)

    def _learn(self, h: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """Words of lower-case letters, text[start : start + length]: each is one run of tokens whose last one ends a word."""
        by = np.argsort(length, kind="stable")
        h, start, length = h[by], start[by], length[by]
        at, size = np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=np.int64)
        for k in range(0, len(h), 4000):
            part = slice(k, k + 4000)
            if self.merges is not None:
                rows, size[part] = self.merges.encode(text, start[part], length[part])
                ids = rows[np.arange(rows.shape[1]) < size[part, None]]
            else:
                words = [text[i : i + n].tobytes().decode() for i, n in zip(start[part].tolist(), length[part].tolist())]
                ids = np.array(self.lib.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype=np.uint32)
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) != len(words):
                    raise ValueError("a word of letters isn't one run of tokens with this tokenizer")
                size[part] = np.diff(np.r_[0, cuts])
            at[part] = self._add(ids) + np.cumsum(size[part]) - size[part]
        self._insert(h, at, size)

    # -- texts ------------------------------------------------------------

    def _span(self, raws: list[bytes]) -> list[bytes]:
        """Packed ids of texts that are under SPAN bytes together."""
        if self.n > MAX_WORDS or len(self.odd) > MAX_PIECES or self.used > MAX_IDS:
            self.clear()
        data = b" ".join(raws) + b" "
        b = np.frombuffer(data, dtype=np.uint8)
        low, kind = _LOWER.take(b), _KIND.take(b)
        letter = kind == _LETTER
        lead = np.flatnonzero(kind == _LEAD)
        if len(lead):
            nxt = b.take(lead + 1)
            ok = (nxt >= 0x80) & (nxt <= 0xBF) & (nxt != 0x97) & (nxt != 0xB7)  # neither × nor ÷
            lead, nxt = lead[ok], nxt[ok]
            letter[lead] = letter[lead + 1] = True
            low[lead[nxt <= 0x9E] + 1] += 32
        end = np.flatnonzero(kind == _GAP)
        start = np.r_[0, end[:-1] + 1]
        some = end > start
        start, end = start[some], end[some]
        if not len(start):
            return [b""] * len(raws)
        others = np.zeros(len(b) + 1, dtype=np.int32)
        np.cumsum(~letter, out=others[1:])
        bad = others.take(end) - others.take(start)
        marked = (bad == 1) & (kind.take(end - 1) == _MARK) & (end - start > 1)
        plain = ((bad == 0) | marked) & (end - start <= MAX_PLAIN)
        marked &= plain
        sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum((low.astype(np.uint64) + _U(1)) * self.power[: len(b)], out=sums[1:])
        at, size = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)

        p = np.flatnonzero(plain)
        first, last = start[p], (end - marked)[p]
        h = _mix((sums.take(last) - sums.take(first)) * self.inverse.take(first) + (last - first).astype(np.uint64))
        h[h == 0] = _U(1)
        slot, there = self._find(h)
        miss = np.flatnonzero(~there)
        if len(miss):
            new, k = np.unique(h[miss], return_index=True)
            k = miss[k]
            self._learn(new, low, first[k], (last - first)[k])
            slot[miss] = self._find(h[miss])[0]
        at[p], size[p] = self.at.take(slot), self.size.take(slot)

        odd = np.flatnonzero(~plain)
        kept = self.used
        if len(odd):
            known = self.odd
            pieces = [data[i:j] for i, j in zip(start[odd].tolist(), end[odd].tolist())]
            new = sorted(set(pieces).difference(known), key=len)
            once = {}
            for x, e in zip(new, self.lib.encode_batch_fast([x.decode("utf-8", "surrogatepass") for x in new], add_special_tokens=False) if new else []):
                ids = np.array(e.ids, dtype=np.uint32)
                (known if len(x) <= MAX_ODD else once)[x] = (self._add(ids), len(ids))
                if len(x) <= MAX_ODD:
                    kept = self.used
            got = np.array([known[x] if x in known else once[x] for x in pieces], dtype=np.int64)
            at[odd], size[odd] = got[:, 0], got[:, 1]
        else:
            kept = self.used

        total = size + marked
        done = np.cumsum(total)
        src = np.repeat(at - (done - total), total)
        src += np.arange(len(src))
        flat = self.pool.take(src)
        m = np.flatnonzero(marked)
        flat[done[m] - 1] = self.mark.take(b.take(end[m] - 1))
        self.used = kept  # long pieces aren't remembered
        cuts = np.r_[0, done][np.searchsorted(start, np.cumsum([len(r) + 1 for r in raws]))]
        packed = flat.astype("<u4", copy=False).tobytes()
        return [packed[4 * i : 4 * j] for i, j in zip([0, *cuts[:-1].tolist()], cuts.tolist())]

    def _long(self, raw: bytes) -> bytes:
        """A text of SPAN bytes or more, cut at spaces."""
        out, at = [], 0
        while at < len(raw):
            end = len(raw)
            if end - at >= SPAN:
                end = raw.rfind(b" ", at, at + SPAN - 1)
                if end <= at:  # one piece of such a length
                    end = raw.find(b" ", at + SPAN - 1)
                    end = len(raw) if end < 0 else end
                    out.append(np.array(self.lib.encode(raw[at:end].decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, dtype="<u4").tobytes())
                    at = end + 1
                    continue
            out += self._span([raw[at:end]])
            at = end + 1
        return b"".join(out)

    def packed_many(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_piece:
            got = self.lib.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
            return [np.array(e.ids, dtype="<u4").tobytes() for e in got]
        out: list[bytes] = []
        part, size = [], 0
        for t in texts:
            raw = t.encode("utf-8", "surrogatepass") if t else b""
            if size + len(raw) + 1 >= SPAN and part:
                out += self._span(part)
                part, size = [], 0
            if len(raw) + 1 >= SPAN:
                out.append(self._long(raw))
                continue
            part.append(raw)
            size += len(raw) + 1
        return out + (self._span(part) if part else [])

    def packed(self, text: str | None) -> bytes:
        return self.packed_many([text])[0]


def _clear() -> None:
    for e in _LOADED.values():
        if e.by_piece:
            e.clear()


hold("wordbpe", _clear)


def encoder(path: str) -> WordEncoder:
    """One encoder for each file and worker process."""
    claim("wordbpe")
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]
