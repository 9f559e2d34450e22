"""Similarities of names and texts: built-in expressions where they can say it, vectorised functions where they can't."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from difflib import SequenceMatcher
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from .text import ascii_fold, tokens


def name_tokens(name: Column) -> Column:
    """What ``name_match`` and ``name_close`` compare; a join of many pairs makes it once a name, before, and asks ``tokens_match`` and ``tokens_close``."""
    return tokens(ascii_fold(name), 3)


def name_match(a: Column, b: Column) -> Column:
    """a's tokens of over two letters in b: all but one, the first and the last for certain.  Not symmetric."""
    return tokens_match(name_tokens(a), name_tokens(b))


def tokens_match(ta: Column, tb: Column) -> Column:
    n, hits = F.size(ta), F.size(F.filter(ta, lambda t: F.array_contains(tb, t)))
    ends = F.array_contains(tb, F.get(ta, F.lit(0))) & F.array_contains(tb, F.get(ta, n - 1))
    one = F.array_contains(tb, F.get(ta, F.lit(0)))
    return F.coalesce(F.when((n == 0) | (F.size(tb) == 0), False).when(n == 1, one).otherwise(ends & (hits >= F.greatest(F.lit(2), n - 1))), F.lit(False))


def name_close(a: Column, b: Column) -> Column:
    """Equal numbers of tokens, at most one of which differs, by at most two edits and with four letters or more."""
    return tokens_close(name_tokens(a), name_tokens(b))


def tokens_close(ta: Column, tb: Column) -> Column:
    # 0: equal, 1: near, 2: apart
    grade = F.zip_with(ta, tb, lambda x, y: F.when(x == y, 0).when((F.least(F.length(x), F.length(y)) >= 4) & (F.levenshtein(x, y) <= 2), 1).otherwise(2))
    total = F.aggregate(grade, F.lit(0), lambda s, g: s + g)
    return (F.size(ta) > 0) & (F.size(ta) == F.size(tb)) & (total <= 1)


def strict_close(a: Column, b: Column, edits: int = 1) -> Column:
    """Equal numbers of tokens with equal first letters, one edit a token and so many in all; single letters must be equal."""
    ta, tb = tokens(ascii_fold(a)), tokens(ascii_fold(b))
    far = F.lit(100)
    cost = F.zip_with(ta, tb, lambda x, y: F.when(F.left(x, F.lit(1)) != F.left(y, F.lit(1)), far).when((F.length(x) == 1) | (F.length(y) == 1), F.when(x == y, 0).otherwise(far)).when(F.levenshtein(x, y) > 1, far).otherwise(F.levenshtein(x, y)))
    return (F.size(ta) > 0) & (F.size(ta) == F.size(tb)) & (F.aggregate(cost, F.lit(0), lambda s, c: s + c) <= edits)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 for two empty ones."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(0.0)


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def time_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap over the hull of two intervals."""
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    return F.when(hull > 0, overlap(s1, e1, s2, e2) / hull).otherwise(0.0)


def box_iou(a: Column, b: Column) -> Column:
    """Of boxes (x, y, w, h)."""
    x = F.greatest(F.lit(0.0), F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    y = F.greatest(F.lit(0.0), F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - x * y
    return F.when(union > 0, x * y / union).otherwise(0.0)


def word_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays of words as multisets."""
    hits = F.aggregate(F.array_distinct(b), F.lit(0), lambda s, w: s + F.least(F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(b, lambda x: x == w))))
    p, r = hits / F.size(b), hits / F.size(a)
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (hits == 0), 0.0).otherwise(2 * p * r / (p + r))


def confidence(logprob: Column) -> Column:
    """exp of a log probability within [0, 1]; 0 for what isn't a finite number."""
    odd = logprob.isNull() | F.isnan(logprob) | (F.abs(logprob) == float("inf"))
    return F.when(odd, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(F.least(logprob, F.lit(700.0))))))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's, as an aggregate: 1 for no rows, 1 or 0 for two constants that are equal or not, 0 for one constant."""
    n, cx, cy = F.count(x), F.min(x) == F.max(x), F.min(y) == F.max(y)
    return F.when(n == 0, 1.0).when(cx & cy, F.when(F.min(x) == F.min(y), 1.0).otherwise(0.0)).when(cx | cy, 0.0).otherwise(F.corr(x, y))


def _jaro_winkler(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    m, right = len(left), [c for c, u in zip(b, used) if u]
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(left, right)) / 2) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio; it depends on the order of its arguments."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def ratio_from(a: str, b: str, least: float) -> float | None:
    """difflib's ratio if it is at least so much; its upper bounds, by lengths and by letters, are asked first."""
    n = len(a) + len(b)
    if n and 2.0 * min(len(a), len(b)) / n < least:
        return None
    m = SequenceMatcher(None, a, b)
    if m.quick_ratio() < least:
        return None
    q = m.ratio()
    return q if q >= least else None


def sequence_ratio_from(least: float):
    """sequence_ratio where it is at least so much, else null."""

    @pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else ratio_from(x, y, least) for x, y in zip(a, b)], dtype="float64")

    return ratio


@pandas_udf(StringType())
def nfkd_ascii(s: pd.Series) -> pd.Series:
    """Compatibility decomposition with all but ASCII dropped, the dotless i kept as i."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x.replace("ı", "i")).encode("ascii", "ignore").decode())


def _codes(a: list, b: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two sequences as numbers that are equal where their items are, and the first row of their distances."""
    ids: dict = {}
    x, y = (np.array([ids.setdefault(t, len(ids)) for t in s], dtype=np.int32) for s in (a, b))
    return x, y, np.arange(len(y) + 1, dtype=np.int32)


def _next_row(row: np.ndarray, item: int, y: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The row of distances after row; steps counts from 0."""
    out = row + 1
    np.minimum(out[1:], row[:-1] + (y != item), out=out[1:])
    return np.minimum.accumulate(out - steps) + steps


#: Furthest places that a backtrace keeps; beyond so many it goes by rows of distances, a few of which are kept.
MOST_PLACES = 1 << 22


def _extend(x: np.ndarray, y: np.ndarray, reach: np.ndarray, k: np.ndarray) -> np.ndarray:
    """How far each diagonal's place gets over equal items: all a few steps at once, then those that still go on by chunks of doubling size."""
    n, m = len(x), len(y)
    live = np.flatnonzero((reach < n) & (reach + k < m) & (reach >= 0) & (reach + k >= 0))
    for _ in range(8):
        if not len(live):
            return reach
        live = live[x[reach[live]] == y[reach[live] + k[live]]]
        reach[live] += 1
        live = live[(reach[live] < n) & (reach[live] + k[live] < m)]
    for d in live.tolist():
        i, off, size = int(reach[d]), int(k[d]), 32
        end = min(n, m - off)
        while i < end:
            differ = x[i : min(end, i + size)] != y[i + off : min(end, i + size) + off]
            at = int(differ.argmax())
            if differ[at]:
                i += at
                break
            i, size = i + len(differ), size * 2
        reach[d] = i
    return reach


def _waves(x: np.ndarray, y: np.ndarray):
    """For 0, 1, ... edits the furthest place in x on each diagonal (place in y less place in x) from -edits on, up to the wave that reaches
    both ends.  Where items are equal nothing is gained by an edit, so a place is within e edits if wave e gets as far on its diagonal."""
    n, m = len(x), len(y)
    reach = _extend(x, y, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))
    e = 0
    yield reach
    while not (abs(m - n) <= e and reach[m - n + e] >= n):
        e += 1
        k = np.arange(-e, e + 1, dtype=np.int64)
        far = np.full(2 * e + 1, -1, dtype=np.int64)
        far[1:-1] = reach + 1  # one for another
        far[2:] = np.maximum(far[2:], reach)  # one more of y
        far[:-2] = np.maximum(far[:-2], reach + 1)  # one less of x
        far = np.minimum(far, np.minimum(n, m - k))
        reach = _extend(x, y, far, k)
        yield reach


#: Cells of a table of distances up to which it is made as columns of bits; larger ones go by waves.
MOST_CELLS = 1 << 26


def _columns(a: list, b: list):
    """For each prefix of b the places of a where the distance grows by one over the place before, and those where it falls by one, as bits."""
    of: dict = {}
    for i, t in enumerate(a):
        of[t] = of.get(t, 0) | 1 << i
    whole = (1 << len(a)) - 1
    up, down = whole, 0
    yield up, down
    for t in b:
        own = of.get(t, 0)
        level = ((((own & up) + up) ^ up) | own | down) & whole
        grown = (down | (whole ^ (level | up))) << 1 | 1
        up, down = ((level & up) << 1 | ~(level | grown)) & whole, grown & level
        yield up, down


def edit_distance(a: list, b: list) -> int:
    """Levenshtein's distance of two sequences; that of long ones takes time by their length times their distance."""
    if len(a) * len(b) <= MOST_CELLS:
        for up, down in _columns(a, b):
            pass
        return len(b) + up.bit_count() - down.bit_count()
    x, y, _ = _codes(a, b)
    return sum(1 for _ in _waves(x, y)) - 1


@pandas_udf(IntegerType())
def token_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance of two arrays of tokens."""
    return pd.Series([edit_distance(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")


@pandas_udf(StructType().add("edits", "integer").add("matches", "integer").add("common", "integer"))
def compared_words(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Of two texts' words, cut at single spaces: their edit distance, the words that their alignment matches and those that they share
    as multisets; nulls if either is null."""
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append((None, None, None))
            continue
        p, q = x.split(" "), y.split(" ")
        ops = Counter(alignment_ops(p, q))
        out.append((ops.total() - ops["M"], ops["M"], (Counter(p) & Counter(q)).total()))
    return pd.DataFrame(out, columns=["edits", "matches", "common"], dtype="Int32")


@pandas_udf(ArrayType(StructType().add("g", "integer").add("op", "string").add("phrase", "string").add("n", "integer")))
def lacking_runs(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of two texts' words, cut at single spaces and aligned: the runs that one of both lacks (I: a, D: b), with their number among all runs."""

    def runs(p: list[str], q: list[str]):
        i = j = 0
        for g, (op, run) in enumerate(groupby(alignment_ops(p, q)), 1):
            n = sum(1 for _ in run)
            if op in "ID":
                yield {"g": g, "op": op, "phrase": " ".join(q[j : j + n] if op == "I" else p[i : i + n]), "n": n}
            i, j = i + n * (op != "I"), j + n * (op != "D")

    return pd.Series([None if x is None or y is None else list(runs(x.split(" "), y.split(" "))) for x, y in zip(a, b)], dtype=object)


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Of arrays of words; an empty reference gives 0 or 1."""
    n = F.size(reference)
    return F.when(n == 0, F.when(F.size(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(token_distance(reference, hypothesis) / n)


def char_error_rate(reference: Column, hypothesis: Column) -> Column:
    n = F.length(reference)
    return F.when(n == 0, F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(reference, hypothesis) / n)


def alignment(a: list[str], b: list[str]) -> list[tuple[str, str | None, str | None]]:
    """Backtraced alignment: of equal ways a match or substitution first, then an insertion, then a deletion.  Columns of bits tell what a
    place costs.  Of long sequences waves of furthest places do, so what is kept grows with the square of the distance, not with
    the lengths; those too far apart for that go by rows of distances."""
    if len(a) * len(b) <= MOST_CELLS:
        x, y = iter(a), iter(b)
        return [(op, None if op == "I" else next(x), None if op == "D" else next(y)) for op in _by_columns(a, b)]
    x, y, _ = _codes(a, b)
    waves, places = [], 0
    for w in _waves(x, y):
        waves.append(w)
        places += len(w)
        if places > MOST_PLACES:
            return _by_rows(a, b)
    out, i, j, e = [], len(x), len(y), len(waves) - 1
    within = lambda e, i, j: abs(j - i) <= e and waves[e][j - i + e] >= i
    while i or j:
        if i and j and x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append(("M", a[i], b[j]))
            continue
        e -= 1
        if i and j and within(e, i - 1, j - 1):
            i, j = i - 1, j - 1
            out.append(("S", a[i], b[j]))
        elif j and (not i or within(e, i, j - 1)):
            j -= 1
            out.append(("I", None, b[j]))
        else:
            i -= 1
            out.append(("D", a[i], None))
    return out[::-1]


def alignment_ops(a: list[str], b: list[str]) -> list[str]:
    """The steps of ``alignment`` alone."""
    return _by_columns(a, b) if len(a) * len(b) <= MOST_CELLS else [op for op, _, _ in alignment(a, b)]


def _by_columns(a: list[str], b: list[str]) -> list[str]:
    kept = list(_columns(a, b))
    out, i, j = [], len(a), len(b)
    cost = j + kept[j][0].bit_count() - kept[j][1].bit_count()
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append("M")
            continue
        up, down = kept[j - 1]
        low = (1 << (i - 1)) - 1
        # what the place before costs in both, then in b alone
        both = j - 1 + (up & low).bit_count() - (down & low).bit_count()
        if both < cost:
            i, j = i - 1, j - 1
            out.append("S")
        elif both + (up >> (i - 1) & 1) - (down >> (i - 1) & 1) < cost:
            j -= 1
            out.append("I")
        else:
            i -= 1
            out.append("D")
        cost -= 1
    return (out + ["I"] * j + ["D"] * i)[::-1]


def _by_rows(a: list[str], b: list[str]) -> list[tuple[str, str | None, str | None]]:
    """``alignment`` of sequences that are far apart.  About every sqrt(n)-th row of distances is kept and those
    between are made again on the way back, so that memory grows as n to the power of 1.5."""
    x, y, steps = _codes(a, b)
    n, size = len(x), max(1, math.isqrt(len(x)))
    kept, row = [], steps
    for i, item in enumerate(x):
        if i % size == 0:
            kept.append(row)
        row = _next_row(row, item, y, steps)
    out, i, j, base, rows = [], n, len(y), -1, []
    while i or j:
        if i and (i - 1) // size * size != base:
            base = (i - 1) // size * size
            rows = [kept[base // size]]
            for item in x[base : base + size]:
                rows.append(_next_row(rows[-1], item, y, steps))
        d, e = (rows[i - base], rows[i - base - 1]) if i else (steps, steps)
        if i and j and d[j] == e[j - 1] + (x[i - 1] != y[j - 1]):
            i, j = i - 1, j - 1
            out.append(("M" if x[i] == y[j] else "S", a[i], b[j]))
        elif j and (not i or d[j] == d[j - 1] + 1):
            j -= 1
            out.append(("I", None, b[j]))
        else:
            i -= 1
            out.append(("D", a[i], None))
    return out[::-1]


@pandas_udf(ArrayType(StructType().add("op", "string").add("a", "string").add("b", "string")))
def align_tokens(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[{"op": o, "a": x, "b": y} for o, x, y in alignment(list(p), list(q))] for p, q in zip(a, b)])
