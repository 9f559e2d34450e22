"""Sampled SentencePiece segmentations by forward filtering and backward sampling over the piece lattice, and lossless decoding.

A piece's weight follows its rank in the model, log p = -alpha log(rank + 10); a character that no piece covers costs its UTF-8
bytes as byte pieces.  The forward pass sums the weights of all segmentations of each prefix; the backward pass draws the last
piece in proportion to the sums that it leaves, and so on, which draws whole segmentations by their exact probability.  Draws
are a hash of seed, row key, place in the text and step, so a row's segmentation doesn't depend on its partition.

No piece holds a space after another character (checked on the model), so the lattice of a text falls apart into units, a run
of spaces and what follows, and at line feeds.  Units of up to ``SHORT`` known characters are filtered together in arrays, once
for each distinct one of a batch, and all their occurrences are drawn in step; any other unit goes through the plain routine.

Decoding joins the pieces' bytes, with a space for the model's mark, and drops the space that encoding put first.  The mark
itself, met in a text, is encoded in bytes, so that every text comes back as it was.

Scale: a map over the scan; memory is bound by ``BATCH_CHARS`` of text and the longest text.

Defined results: a null or empty text is the leading mark alone.  A null doc_id is a key of its own.  Repeated rows are sampled
alike.  An empty table gives an empty result.  Other columns are ignored and may have any name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, column
from .ordermin import mix
from .wordbpe import default_path

ALPHA, BYTE_COST, SEED = 1.0, 12.0, 0
SHORT, BATCH_CHARS = 24, 4_000_000
#: Greatest lengths of units that are filtered together, and how many at a time.
WIDTHS, PART = (4, 6, 8, 10, 12, 16, SHORT), 3_000
_UNITS = re.compile(r" +[^ \n]*|\n|[^ \n]+")
_R = 0x9E3779B97F4A7C15 | 1
_G = np.uint64(0x9E3779B97F4A7C15)
_MODELS: dict[tuple, "Sampler"] = {}


def sampler(path: str, alpha: float = ALPHA) -> "Sampler":
    if (path, alpha) not in _MODELS:
        _MODELS[path, alpha] = Sampler(path, alpha)
    return _MODELS[path, alpha]


class Sampler:
    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = [0] * 256
        pieces: dict[str, int] = {}
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                text = p.replace("▁", " ")
                if "\n" in text or " " in text.lstrip(" "):
                    raise ValueError("a piece spans a boundary of units")
                pieces[text] = i
                self.bytes_of[i] = text.encode()
        order = sorted(pieces, key=lambda p: (-sp.get_score(pieces[p]), pieces[p]))
        self.known = {p: (pieces[p], -alpha * math.log(r + 10)) for r, p in enumerate(order)}
        self.longest = max(map(len, order))
        h = np.array([_hash(p) for p in order], dtype=np.uint64)
        by = np.argsort(h)
        self.h, self.ids = h[by], np.array([pieces[order[k]] for k in by], dtype=np.int32)
        self.lp = np.array([self.known[order[k]][1] for k in by], dtype=np.float64)
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(self.h >> np.uint64(42)).astype(np.int64)] = True
        self.chars = {p for p in order if len(p) == 1}

    # -- one unit, plainly ------------------------------------------------

    def edges(self, unit: str, j: int) -> list[tuple[int, float, int]]:
        """(start, log weight, id) of the pieces that end at j; id -1 is the bytes of a character."""
        out = []
        for i in range(max(0, j - self.longest), j):
            got = self.known.get(unit[i:j])
            if got:
                out.append((i, got[1], got[0]))
            elif i == j - 1:
                out.append((i, -BYTE_COST * len(unit[i:j].encode("utf-8", "surrogatepass")), -1))
        return out[::-1]

    def forward(self, unit: str) -> list[float]:
        """Log sums of the weights of all segmentations of each prefix."""
        a = [0.0]
        for j in range(1, len(unit) + 1):
            w = [a[i] + lp for i, lp, _ in self.edges(unit, j)]
            m = max(w)
            a.append(m + math.log(sum(math.exp(x - m) for x in w)))
        return a

    def draw(self, unit: str, base: int) -> list[int]:
        """One segmentation of a unit."""
        a, j, out, step = self.forward(unit), len(unit), [], 0
        while j:
            u, c, pick = uniform(base, step), 0.0, None
            for i, lp, k in self.edges(unit, j):
                c += math.exp(a[i] + lp - a[j])
                pick = (i, k)
                if u <= c:
                    break
            i, k = pick
            out.append([k] if k >= 0 else [self.byte_id[b] for b in unit[i:j].encode("utf-8", "surrogatepass")])
            j, step = i, step + 1
        return [k for part in reversed(out) for k in part]

    # -- many units, in arrays --------------------------------------------

    def lattice(self, units: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Cumulative probabilities (unit, end, length of the last piece) and the pieces' ids, for units of at most width known characters."""
        n, most = len(units), min(width, self.longest)
        codes = np.array(units, dtype=f"U{width}").view(np.uint32).reshape(n, width).astype(np.uint64)
        pre = np.zeros((n, width + 1), dtype=np.uint64)
        for j in range(width):
            pre[:, j + 1] = pre[:, j] * np.uint64(_R) + codes[:, j] + np.uint64(1)
        w = np.full((n, width + 1, most), -np.inf)
        ids = np.zeros((n, width + 1, most), dtype=np.int32)
        power = 1
        for size in range(1, most + 1):
            power = power * _R & 0xFFFFFFFFFFFFFFFF
            sub = mix(pre[:, size:] - pre[:, : width + 1 - size] * np.uint64(power) + np.uint64(size))
            row, col = np.nonzero(self.maybe[(sub >> np.uint64(42)).astype(np.int64)])
            h = sub[row, col]
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            ok = self.h[at] == h
            row, col, at = row[ok], col[ok] + size, at[ok]
            w[row, col, size - 1] = self.lp[at]
            ids[row, col, size - 1] = self.ids[at]
        a = np.full((n, width + 1), -np.inf)
        a[:, 0] = 0
        cum = np.full((n, width + 1, most), 2.0, dtype=np.float32)
        with np.errstate(invalid="ignore", divide="ignore"):
            for j in range(1, width + 1):
                k = min(j, most)
                x = a[:, j - k : j][:, ::-1] + w[:, j, :k]
                m = x.max(1)
                p = np.exp(x - m[:, None])
                total = p.sum(1)
                a[:, j] = m + np.log(total)
                c = np.cumsum(p, axis=1) / total[:, None]
                cum[:, j, :k] = c
                # from the last possible piece on everything is caught
                line, last = np.arange(n), k - 1 - (p > 0)[:, ::-1].argmax(1)
                cum[line, j, last] = 2.0
        return cum, ids

    def sample(self, texts: list[str | None], keys: list[int | None], seed: int = SEED) -> list[np.ndarray]:
        """ids of a sampled segmentation of each text."""
        out: list[np.ndarray] = []
        part: list[str] = []
        pk: list[int | None] = []
        size = 0
        for t, k in zip(texts, keys):
            part.append(" " + (t or ""))
            pk.append(k)
            size += len(part[-1])
            if size > BATCH_CHARS:
                out += self._sample(part, pk, seed)
                part, pk, size = [], [], 0
        return out + (self._sample(part, pk, seed) if part else [])

    def _sample(self, texts: list[str], keys: list[int | None], seed: int) -> list[np.ndarray]:
        split = [_UNITS.findall(t) for t in texts]
        counts = np.array([len(s) for s in split])
        number = dict.fromkeys(chain.from_iterable(split))
        for k, u in enumerate(number):
            number[u] = k
        occ = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(counts.sum()))
        starts = np.r_[0, np.cumsum(counts)]
        key = np.array([xxhash.xxh3_64_intdigest(f"{seed}:{k}") for k in keys], dtype=np.uint64)
        base = mix(np.repeat(key, counts) + (np.arange(len(occ)) - np.repeat(starts[:-1], counts)).astype(np.uint64) * _G)
        units = list(number)
        lens = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        # the array routine serves short units of known characters
        odd = re.compile("[" + re.escape("".join(set().union(*texts) - self.chars)) + "\n]").search
        fast = (lens <= SHORT) & ~np.fromiter(map(bool, map(odd, units)), dtype=bool, count=len(units))
        n_ids = np.zeros(len(occ), dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # occurrences, how many ids, ids last first
        # units by width, so that a part's occurrences are one slice
        width = np.where(fast, np.searchsorted(WIDTHS, lens), len(WIDTHS))
        by = np.argsort(width, kind="stable")
        rank = np.empty(len(units), dtype=np.int32)
        rank[by] = np.arange(len(units), dtype=np.int32)
        place = rank[occ]
        line = np.argsort(place, kind="stable")
        place = place[line]
        for k, hi in enumerate(WIDTHS):
            first, end = np.searchsorted(width[by], [k, k + 1])
            for a in range(first, end, PART):
                some = by[a : min(end, a + PART)]
                cum, ids = self.lattice([units[i] for i in some], hi)
                left, right = np.searchsorted(place, [a, a + len(some)])
                at, q = line[left:right], place[left:right] - a
                pos = lens[some][q]
                got, n = np.zeros((len(at), hi), dtype=np.int32), np.zeros(len(at), dtype=np.int64)
                seeds = base[at]
                live = np.arange(len(at))
                step = 0
                while len(live):
                    u = _uniform(seeds[live], step).astype(np.float32)
                    c = cum[q[live], pos[live]]
                    j = (c < u[:, None]).sum(1)
                    got[live, step] = ids[q[live], pos[live], j]
                    pos[live] -= j + 1
                    n[live] += 1
                    live = live[pos[live] > 0]
                    step += 1
                n_ids[at] = n
                done.append((at, n, got))
        slow = np.flatnonzero(~fast[occ])
        plain = {}
        for k in slow.tolist():
            u = units[occ[k]]
            plain[k] = [self.byte_id[10]] if u == "\n" else self.draw(u, int(base[k]))
            n_ids[k] = len(plain[k])
        end = np.cumsum(n_ids)
        flat = np.zeros(int(end[-1]) if len(end) else 0, dtype="<u4")
        for at, n, got in done:
            for step in range(got.shape[1]):
                live = np.flatnonzero(n > step)
                flat[end[at[live]] - 1 - step] = got[live, step]
        for k, ids in plain.items():
            flat[end[k] - len(ids) : end[k]] = ids
        cuts = np.r_[0, end][starts]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")


def _hash(piece: str) -> int:
    h, m = 0, 0xFFFFFFFFFFFFFFFF
    for c in piece:
        h = (h * _R + ord(c) + 1) & m
    return int(mix(np.array([(h + len(piece)) & m], dtype=np.uint64))[0])


def _uniform(base: np.ndarray, step: int) -> np.ndarray:
    return ((mix(base + np.uint64(step * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(40)).astype(np.float64) + 0.5) / (1 << 24)


def uniform(base: int, step: int) -> float:
    return float(_uniform(np.array([base], dtype=np.uint64), step)[0])


SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def encode(docs: DataFrame, model: str | None = None, seed: int = SEED, alpha: float = ALPHA, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit numbers) of a sampled segmentation of each row."""
    path = model or default_path("piece_bpe_32k.model")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in parts:
            keys = column(b, "doc_id").to_pylist()
            for k, ids in zip(keys, sampler(path, alpha).sample(column(b, "text").to_pylist(), keys, seed)):
                yield k, ids.tobytes()

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(lambda it: batches(run(it), SCHEMA, 500), "doc_id long, ids binary")


DECODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("text", pa.string())])


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and text of encoded rows."""
    path = model or default_path("piece_bpe_32k.model")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        s = sampler(path)
        for b in parts:
            for k, raw in zip(column(b, "doc_id").to_pylist(), column(b, "ids").to_pylist()):
                ids = np.frombuffer(raw, dtype="<u4")
                yield k, len(ids), zlib.crc32(raw), s.decode(ids)

    return encoded.mapInArrow(lambda it: batches(run(it), DECODED, 500), "doc_id long, n_tokens long, ids_crc32 long, text string")
