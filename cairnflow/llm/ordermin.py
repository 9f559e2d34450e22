"""Document fingerprints by order MinHash.

The characters of a text are cut into overlapping k-mers, and each is numbered by its occurrence.  For each of ``SLOTS``
hash orders the ``PICK`` smallest numbered k-mers are taken, put back into text order, and the tuple of their k-mers is hashed
to 16 bits.  Two texts' likeness is the share of equal slots: swapping passages changes the order in tuples, and repeating
them changes the numbers, so likeness follows edit distance rather than the mere set of k-mers.

Scale: the comparison with the next document needs rows in doc_id order.  The ids alone are summarised to as many cut points as
there are partitions, and an id (or null) that fills several ranges is cut further by a hash of the text; each text then moves once, to the partition of its range, and the first text of a range is sent to the
range before it as well.  No single task sees more than a range.

Defined results: a null text counts as empty.  A text shorter than k characters is one k-mer.  The fingerprint of an empty
text is the empty string; its likeness to another empty one is 1, to any other text 0.  Rows of equal doc_id follow each other
by the upper 63 bits of xxhash64 of their text, then by text; null ids come first.  The only row of a table is its own next row.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, column

K, SLOTS, PICK = 6, 64, 2
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_A = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: Odd multipliers, one for each hash order.
ORDERS = (mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * _A) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def kmers(codes: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of each run of k characters (of the whole text if it is shorter)."""
    n = max(1, len(codes) - k + 1)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, len(codes))):
        h = h * np.uint64(0x100000001B3) + codes[j : j + n].astype(np.uint64) + np.uint64(1)
    return mix(h)


def fingerprint(text: str) -> np.ndarray:
    """SLOTS 16-bit numbers; none for an empty text."""
    if not text:
        return np.zeros(0, dtype=np.uint16)
    h = kmers(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"))
    n = len(h)
    # (hash, place) sorted: equal k-mers stand together in text order, which numbers them
    s = np.sort((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64))
    top, place = (s >> np.uint64(32)), (s & np.uint64(0xFFFFFFFF)).astype(np.int64)
    i = np.arange(n)
    first = np.maximum.accumulate(np.where(np.r_[True, top[1:] != top[:-1]], i, 0))
    numbered = np.empty(n, dtype=np.uint32)
    numbered[place] = (mix(top * _A + (i - first).astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
    picks = np.empty((SLOTS, min(PICK, n)), dtype=np.int64)
    rows = max(1, 400_000 // n)
    for a in range(0, SLOTS, rows):
        keys = numbered[None, :] * ORDERS[a : a + rows, None]
        line = np.arange(len(keys))
        for j in range(picks.shape[1]):
            best = keys.argmin(1)
            picks[a : a + rows, j] = best
            keys[line, best] = 0xFFFFFFFF
    picks.sort(1)
    t = np.zeros(SLOTS, dtype=np.uint64)
    for j in range(picks.shape[1]):
        t = mix(t * _A + h[picks[:, j]] + np.uint64(1))
    return (t >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float(np.count_nonzero(a == b)) / SLOTS


def show(f: np.ndarray) -> str:
    return f.astype(">u2").tobytes().hex()


def edited(text: str, other: str) -> str:
    """The last half of text, rounded down, replaced by as many characters from the start of other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of a range in order, then the rows sent ahead from the next one."""
    was = None
    for b in parts:
        for ahead, doc_id, text in zip(column(b, "ahead").to_pylist(), column(b, "doc_id").to_pylist(), column(b, "text").to_pylist()):
            now = (doc_id, text or "", fingerprint(text or ""))
            if was is not None:
                new = edited(was[1], now[1])
                f = fingerprint(new)
                yield was[0], len(was[1]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), show(was[2]), show(f), likeness(was[2], f), likeness(was[2], now[2])
            was = now
            if ahead:
                return


def ranges(docs: DataFrame, parts: int, tie: Column, in_order: bool = False) -> tuple[Column, int]:
    """The number of each row's range of doc_id, and how many ranges there are, about ``parts``.  A doc_id (or null) that fills several
    even ranges gets as many of its own, to which its rows are dealt by the hash of tie, or in order of tie, a number from 0 to 2^63; other
    rows of one doc_id stay together."""
    if parts < 2:
        return F.lit(0), 1
    got = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000).alias("q"), F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("none"), F.count("*").alias("n")).first()
    q = got["q"] or []
    # an id that is m quantiles in a row fills as many ranges, less one
    hot = {i: m for i, m in Counter(q).items() if m > 1}
    cuts = sorted({i for i in q if i > got["least"]} | {i + 1 for i in hot})
    of = [min(parts, 1 + got["none"] * parts // max(1, got["n"]))] + [1] * (len(cuts) + 1)  # nulls, then the ranges between cuts
    for i, m in hot.items():
        of[1 + bisect_right(cuts, i)] = m
    at = F.when(F.col("doc_id").isNull(), 0).otherwise(_search(cuts, 0, len(cuts)) + 1)
    first = [0, *accumulate(of)]
    if max(of) == 1:
        return at, first[-1]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), at + 1)
    share = F.least(pick(of) - 1, F.floor(tie / float(1 << 63) * pick(of)).cast("int")) if in_order else F.pmod(F.xxhash64(tie), pick(of)).cast("int")
    return pick(first[:-1]) + share, first[-1]


def in_ranges(docs: DataFrame, parts: int) -> DataFrame:
    """Rows with the number of their range (``part``) of doc_id, then of a hash of the text, and the first row of each range once more for the
    range before (``ahead``); that of the first range for the last one."""
    d = docs.withColumn("tie", F.shiftrightunsigned(F.xxhash64("text"), 1))
    number, n = ranges(d, parts, F.col("tie"), in_order=True)
    d = d.withColumn("own", number)
    firsts = d.groupBy("own").agg(F.min(F.struct("doc_id", "tie")).alias("first"))
    w = Window.orderBy("own")  # a row for each range
    firsts = firsts.withColumn("before", F.coalesce(F.lag("own").over(w), F.max("own").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    d = d.join(F.broadcast(firsts), "own")  # at most n rows
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie"))
    own, ahead = (F.struct(F.col(c).cast("int").alias("part"), F.lit(k).alias("ahead")) for k, c in enumerate(("own", "before")))
    d = d.select("doc_id", "text", "tie", F.inline(F.when(first, F.array(own, ahead)).otherwise(F.array(own))))
    return d.repartitionById(n, F.col("part")).sortWithinPartitions("ahead", "doc_id", "tie", "text")


def _search(cuts: list[int], lo: int, hi: int):
    """How many cuts are at most doc_id, as nested conditions of logarithmic depth."""
    if lo == hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(F.col("doc_id") >= F.lit(cuts[mid]), _search(cuts, mid + 1, hi)).otherwise(_search(cuts, lo, mid))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """A row for each document, compared with its edited text and with the next document."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return in_ranges(d, parts).mapInArrow(lambda it: batches(_pairs(it), SCHEMA), DDL)
