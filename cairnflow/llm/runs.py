"""Periodic runs in word sequences by harmonic grid probing.

A run is a stretch of words with smallest period q (words q apart are identical) and at least max(``LEAST``, 2 q) words that no
neighbour extends.  With period p its words i and i + p are equal along a stretch of at least p places (at least LEAST - p for small
p), and any such stretch holds a multiple of p.  So for each p the words at jp and (j + 1)p are compared, n log n probes for all p.

1. The probes of many periods are one array comparison.  A stretch has more than one place, so a survivor needs an equal neighbour.
2. Periods go up.  Grid points in a run that was found with a period that divides p are skipped: they are that run again.  What
   is left is extended both ways by chunks of doubling size; the points in the stretch that comes of it are done.
3. A stretch long enough is a run, unless one of the same place was found with a smaller period, which then divides p (of two
   periods that together aren't longer than the stretch, their greatest common divisor is one too).

Scale: a map over the scan.  A text takes n log n probes in blocks of ``BLOCK``, and what is extended; nothing is n^2 for texts of one word
repeated.

Defined results: a null text counts as empty and has no runs.  ``edited`` leaves rows without doc_id as they are.  Rows stand for
themselves, so repeated rows and ids are as good as any.  An empty table gives an empty result.  Other columns are ignored
and may have any name.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, claim, column, in_slices

LEAST = 12
BLOCK = 1 << 18
CHUNK = 64
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text or "")


def edited(words: list[str], doc_id: int | None) -> list[str]:
    """The words with a periodic end, for one doc_id in ten by its crc32."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def numbers(words: list[str]) -> np.ndarray:
    """Equal numbers for equal words of a text."""
    known: dict[str, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int32, count=len(words))


def _survivors(w: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Periods in ascending order, each with its grid points whose words, and a neighbour's, are equal a period on."""
    n = len(w)
    p = 1
    while 2 * p <= n:
        # the periods from p on that have about a block of grid points together
        last = p
        total = (n - 1) // p
        while 2 * (last + 1) <= n and total < BLOCK:
            more = min(n // 2 - last, max(1, (BLOCK - total) * (last + 1) // n))
            total += int(((n - 1) // np.arange(last + 1, last + more + 1)).sum())
            last += more
        periods = np.arange(p, last + 1)
        many = (n - 1) // periods
        per = np.repeat(periods, many)
        at = (np.arange(len(per)) - np.repeat(np.cumsum(many) - many, many)) * per
        hit = np.flatnonzero(w[at] == w[at + per])
        at, per = at[hit], per[hit]
        up, down = at + per + 1, at - 1
        near = (up < n) & (w[np.minimum(up, n - 1)] == w[np.minimum(at + 1, n - 1)])
        near |= (down >= 0) & (w[np.maximum(down, 0)] == w[np.maximum(down, 0) + per])
        at, per = at[near], per[near]
        if len(at):
            cuts = np.flatnonzero(np.r_[True, per[1:] != per[:-1]])
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
                yield int(per[lo]), at[lo:hi]
        p = last + 1


def _stretch(w: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The places [a, b) around at whose words are equal to those p on."""
    b, n, size = at + 1, len(w) - p, CHUNK
    while b < n:
        differ = w[b : min(n, b + size)] != w[b + p : min(n, b + size) + p]
        k = int(differ.argmax())
        if differ[k]:
            b += k
            break
        b, size = b + len(differ), size * 2
    a, size = at, CHUNK
    while a > 0:
        lo = max(0, a - size)
        differ = (w[lo:a] != w[lo + p : a + p])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            a -= k
            break
        a, size = lo, size * 2
    return a, b


def runs(w: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of at least max(least, 2 * period), by start and period; least is 3 or more."""
    found: dict[tuple[int, int], int] = {}
    held = np.zeros((0, 3), dtype=np.int64)  # start, end, period
    for p, at in _survivors(w):
        if len(held):
            for s, e, _ in held[(p % held[:, 2] == 0) & (held[:, 1] - held[:, 0] > p)].tolist():
                at = at[(at < s) | (at >= e - p)]
        new = []
        while len(at):
            a, b = _stretch(w, int(at[0]), p)
            at = at[at >= b]
            if b - a + p >= max(least, 2 * p) and (a, b + p) not in found:
                found[a, b + p] = p
                new.append((a, b + p, p))
        if new:
            held = np.concatenate([held, np.array(new, dtype=np.int64)])
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    for s, n, p in found:
        depth[s + p] += 1
        depth[s + n] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edit: bool = False, least: int = LEAST) -> DataFrame:
    """doc_id, words (their number), runs (start, length, period; by start and period) and the collapsed text of each row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        claim("runs")
        for b in in_slices(parts, 200):
            for i, t in zip(column(b, "doc_id").to_pylist(), column(b, "text").to_pylist()):
                w = words_of(t)
                w = edited(w, i) if edit else w
                found = runs(numbers(w), least)
                yield i, len(w), [{"start": s, "length": n, "period": p} for s, n, p in found], " ".join(collapsed(w, found))

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(lambda it: batches(run(it), SCHEMA, 200), "doc_id long, words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """Of detect's rows: the number of runs, the longest one (ties: first start, then period), and SHA-256 of the runs and the collapsed text."""
    best = F.expr("array_min(transform(runs, r -> struct(-r.length AS length, r.start AS start, r.period AS period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    d = found.withColumn("best", best)
    return d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", (-F.col("best.length")).alias("length"), "best.period", F.expr("1000 * -best.length div best.period").alias("exponent_milli"), F.sha2(F.encode(lines, "utf-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "utf-8"), 256).alias("collapsed_sha256"))
