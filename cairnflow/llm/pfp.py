"""Removal of repeated 200-byte strings by prefix-free parsing.

Rolling hash: each window of ``WINDOW`` bytes picks a trigger, the leftmost of its first ``STARTS`` positions whose ``GRAM``-byte
hash is least.  The choice depends on the window's bytes alone, so equal windows pick the same trigger at the same distance.
A run of windows with one trigger is a phrase: the text they cover, cut at the trigger into a left part (before it), the ``CORE``
bytes from it on, which all windows of the phrase hold, and a right part.  The distinct phrases are the dictionary; the phrases of
a text, in order, with their triggers, are its parse.

1. The cores of all phrases are counted (rows of one number, combined before the shuffle), and a filter of fixed size at most is
   made of those that occur again: it only lets too much through, never too little.
2. One pass parses the texts and writes, of the phrases that pass, the parse (phrase number, document, trigger), and of each task
   the dictionary's entries once, with whether they occur there again.
3. The dictionary is put in suffix order: by core, then by what is left of the trigger, read backwards, then by what follows the
   core.  The order is dealt in ranges, so that the entries of one core that very many texts share (the edge of a passage found in a
   third of all documents) lie in as many tasks as they need.  In a task a second order, by what follows the core, is made beside
   the first, each with the common prefixes of neighbours.  Two entries share the window that starts d bytes before the trigger if
   they fall in one interval of common prefixes >= d in the first order and >= rest in the second.  That gives each entry the
   distances at which its windows repeat; an entry that occurs again repeats at all of its own.
4. Where a core's entries lie in several tasks, an entry can only share windows with those beyond its task at distances up to its
   common prefix with the task's first or last entry.  Those few windows are counted by a 128-bit hash, each that repeats in a task once for it.
5. The dictionary's verdicts go back to the parse by phrase number, and its spans to the documents by key.

Scale: no task sees more than its range of distinct entries; copies of a text collapse to one entry a task before anything moves;
the driver sees counts and the filter alone (32 MB at most, put together in the cluster).

Defined results: a null text counts as empty; texts under 200 bytes lose nothing.  Repeated rows repeat each other's text and
lose it all.  A null doc_id is kept.  An empty table gives an empty result.  Other columns are ignored and may have any name and type.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, claim, column, in_slices, materialise, quoted
from .ordermin import mix

WINDOW, STARTS, GRAM = 200, 128, 32
CORE = WINDOW - STARTS + 1
SIDE = STARTS - 1  # the most bytes of a window on either side of the core
_PLACE = np.uint64((1 << 28) - 1)
MAX_FILTER_BITS, FILTER_PARTS, FAN_IN = 1 << 28, 64, 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_R = np.uint64(0x2127599BF4325C37 | 1)
CHUNK_ROWS = 100_000
#: Entries, and bytes of their sides, that a task holds back to find those that occur again.
HELD_ENTRIES, HELD_BYTES = 50_000, 12_000_000


def parse(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigger, first and last window start of each phrase of a text of at least WINDOW bytes."""
    h = _BYTE[np.frombuffer(raw, dtype=np.uint8)]
    width, power = 1, int(_R)
    while width < GRAM:
        h = h[:-width] * np.uint64(power) + h[width:]
        width, power = 2 * width, power * power & 0xFFFFFFFFFFFFFFFF
    # the hash's upper bits, then the place, so that the least is the leftmost of equals
    h = mix(h) & ~_PLACE | np.arange(len(h), dtype=np.uint64)
    n = len(raw) - WINDOW + 1
    width = 1
    while width < STARTS:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    trig = (h[:n] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.r_[True, trig[1:] != trig[:-1]])
    return trig[first], first, np.r_[first[1:] - 1, n - 1]


def _cores(raw: bytes, triggers: np.ndarray) -> np.ndarray:
    """The 128-bit hash of the core at each trigger, as two signed numbers."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(digest(raw[t : t + CORE]) for t in triggers.tolist()), dtype="<i8").reshape(-1, 2)


def _raw(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def core_rows(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("core", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pfp")
        for b in in_slices(parts, 500):
            held = []
            for t in column(b, "text").to_pylist():
                raw = _raw(t)
                if len(raw) >= WINDOW:
                    held.append(_cores(raw, parse(raw)[0])[:, 0])
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held))], schema=schema)

    return docs.select("text").mapInArrow(run, "core long")


def _probes(cores: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The filter's part of each core, and three places in it."""
    u = cores.view(np.uint64)
    mask, a, b = np.uint64(bits // FILTER_PARTS - 1), mix(u + np.uint64(1)), mix(u + np.uint64(2))
    return (u >> np.uint64(58)).astype(np.int64), [((a + np.uint64(j) * b) & mask).astype(np.int64) for j in range(3)]


def make_filter(cores: DataFrame, n: int) -> np.ndarray:
    """A filter of the cores (column core): a bit map in parts, of a size that grows with n up to MAX_FILTER_BITS."""
    bits = 1 << 16
    while bits < 16 * n and bits < MAX_FILTER_BITS:
        bits *= 2
    size = bits // FILTER_PARTS // 8

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part, places = _probes(pdf["core"].to_numpy(dtype=np.int64), bits)
        m = np.zeros(size * 8, dtype=bool)
        for p in places:
            m[p] = True
        return pd.DataFrame({"part": [int(part[0])], "piece": [int(pdf["piece"].iloc[0])], "map": [np.packbits(m, bitorder="little").tobytes()]})

    def either(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.frombuffer(pdf["map"].iloc[0], dtype=np.uint8).copy()
        for x in pdf["map"].iloc[1:]:
            m |= np.frombuffer(x, dtype=np.uint8)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "piece": [int(pdf["piece"].iloc[0]) // FAN_IN], "map": [m.tobytes()]})

    # a part's cores are dealt to pieces where there are many; their maps are then put together, some at a time
    pieces = max(1, n // (FILTER_PARTS * 500_000))
    keyed = cores.withColumn("part", F.shiftrightunsigned("core", 58)).withColumn("piece", F.pmod(F.xxhash64("core"), F.lit(pieces)))
    maps = keyed.groupBy("part", "piece").applyInPandas(run, "part int, piece long, map binary")
    while pieces > 1:
        maps = maps.groupBy("part", F.floor(F.col("piece") / FAN_IN)).applyInPandas(either, "part int, piece long, map binary")
        pieces = -(-pieces // FAN_IN)
    out = np.zeros((FILTER_PARTS, size), dtype=np.uint8)
    for r in maps.toLocalIterator():
        out[r["part"]] |= np.frombuffer(r["map"], dtype=np.uint8)
    return out


def passes(f: np.ndarray, cores: np.ndarray) -> np.ndarray:
    part, places = _probes(cores, f.size * 8)
    ok = np.ones(len(cores), dtype=bool)
    for p in places:
        ok &= (f[part, p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return ok


PHRASES = pa.schema([("cls1", pa.int64()), ("cls2", pa.int64()), ("kid", pa.int64()), ("h", pa.int64()), ("trig", pa.int64()), ("core1", pa.int64()), ("core2", pa.int64()), ("before", pa.binary()), ("after", pa.binary()), ("again", pa.bool_())])
PHRASES_DDL = "cls1 long, cls2 long, kid long, h long, trig long, core1 long, core2 long, before binary, after binary, again boolean"


class _Entries:
    """Dictionary entries that a task has met since it last gave some away."""

    def __init__(self):
        self.rows: dict[bytes, list] = {}
        self.size = 0

    def meet(self, number: bytes, core: bytes, ctx: bytes, left: int) -> None:
        row = self.rows.get(number)
        if row is None:
            self.rows[number] = [core, ctx[:left][::-1], ctx[left + CORE :], False]
            self.size += len(ctx)
        else:
            row[3] = True

    def full(self) -> bool:
        return len(self.rows) >= HELD_ENTRIES or self.size >= HELD_BYTES

    def give(self) -> Iterator[pa.RecordBatch]:
        numbers, rows = list(self.rows), list(self.rows.values())
        self.rows, self.size = {}, 0
        for k in range(0, len(rows), 5000):
            part = rows[k : k + 5000]
            cls = np.frombuffer(b"".join(numbers[k : k + 5000]), dtype="<i8").reshape(-1, 2)
            core = np.frombuffer(b"".join(r[0] for r in part), dtype="<i8").reshape(-1, 2)
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cls[:, 0].copy()), pa.array(cls[:, 1].copy()), none, none, none, pa.array(core[:, 0].copy()), pa.array(core[:, 1].copy()), pa.array([r[1] for r in part], pa.binary()), pa.array([r[2] for r in part], pa.binary()), pa.array([r[3] for r in part])], schema=PHRASES)


def phrase_rows(docs: DataFrame, shared) -> DataFrame:
    """Of the phrases whose core passes the filter: the parse (phrase number, kid, h, trigger), and the dictionary's entries (phrase
    number, core, the bytes before the trigger read backwards, the bytes after the core, whether they occur again)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pfp")
        f, entries, digest = shared.value, _Entries(), xxhash.xxh3_128_digest
        for b in in_slices(parts, 500):
            found: list[tuple] = []
            for kid, h, t in zip(column(b, "kid").to_pylist(), column(b, "h").to_pylist(), column(b, "text").to_pylist()):
                raw = _raw(t)
                if len(raw) < WINDOW:
                    continue
                trig, first, last = parse(raw)
                cores = _cores(raw, trig)
                ok = np.flatnonzero(passes(f, cores[:, 0]))
                if not len(ok):
                    continue
                numbers = []
                for k, t0, i, j in zip(ok.tolist(), trig[ok].tolist(), first[ok].tolist(), last[ok].tolist()):
                    ctx = raw[i : j + WINDOW]
                    numbers.append(digest(ctx, t0 - i << 8 | t0 - j))
                    entries.meet(numbers[-1], cores[k].tobytes(), ctx, t0 - i)
                    if entries.full():
                        yield from entries.give()
                found.append((np.frombuffer(b"".join(numbers), dtype="<i8").reshape(-1, 2), kid, h, trig[ok]))
            if found:
                cls, n = np.concatenate([x[0] for x in found]), [len(x[3]) for x in found]
                whose = [pa.array(np.repeat(np.array([x[k] for x in found], dtype=np.int64), n)) for k in (1, 2)]
                m = len(cls)
                yield pa.RecordBatch.from_arrays([pa.array(cls[:, 0].copy()), pa.array(cls[:, 1].copy()), *whose, pa.array(np.concatenate([x[3] for x in found])), *(pa.nulls(m, k.type) for k in list(PHRASES)[5:])], schema=PHRASES)
        yield from entries.give()

    return docs.mapInArrow(run, PHRASES_DDL)


def _matrix(column_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as rows of SIDE bytes, padded with zeros, and their lengths."""
    at = np.frombuffer(column_.buffers()[1], dtype=np.int32)[column_.offset : column_.offset + len(column_) + 1]
    data = np.frombuffer(column_.buffers()[2], dtype=np.uint8) if column_.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    n = np.diff(at).astype(np.int64)
    out = np.zeros((len(n), SIDE), dtype=np.uint8)
    out[np.arange(SIDE) < n[:, None]] = data[at[0] : at[-1]]
    return out, n


def _prefix_order(core: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order of rows (number of the core, text): row numbers, and the common prefix of each with the one before it, -1 where the core differs."""
    both = np.concatenate([core.astype(">u8").view(np.uint8).reshape(-1, 8), text], axis=1)
    order = np.argsort(np.ascontiguousarray(both).view(f"S{both.shape[1]}").ravel(), kind="stable")
    s = both[order]
    differ = s[1:] != s[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), both.shape[1]) - 8
    return order, np.r_[-1, np.maximum(lcp, -1)]


def shared_windows(core: np.ndarray, before: np.ndarray, after: np.ndarray, left: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each of distinct entries (rows), True at distance d if its window that starts d before the trigger is in another one too."""
    n = len(core)
    (lo, ll), (ro, rl) = _prefix_order(core, before), _prefix_order(core, after)
    out = np.zeros((n, STARTS), dtype=bool)
    a, b = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for d in range(STARTS):
        rows = np.flatnonzero((least <= d) & (d <= left))
        if len(rows) < 2:
            continue
        a[lo], b[ro] = np.cumsum(ll < d), np.cumsum(rl < SIDE - d)
        key = a[rows] * (n + 1) + b[rows]
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = k[1:] == k[:-1]
        out[rows[order[np.r_[same, False] | np.r_[False, same]]], d] = True
    return out


def _common(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The common prefix of each row with one."""
    differ = rows != one
    return np.where(differ.any(1), differ.argmax(1), rows.shape[1])


VERDICTS = pa.schema([("cls1", pa.int64()), ("cls2", pa.int64()), ("near", pa.int16()), ("far", pa.int16()), ("w1", pa.int64()), ("w2", pa.int64())])
VERDICTS_DDL = "cls1 long, cls2 long, near short, far short, w1 long, w2 long"


def _verdicts(t: pa.Table, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """Of the entries of whole cores in suffix order, the runs of distances (near to far) at which their windows repeat; of those
    whose core may go on in the range before (first) or after (last), also the windows that may repeat there, by hash."""
    t = t.combine_chunks()
    cols = {c: t.column(c).chunk(0) for c in t.column_names}
    c1, c2, k1, k2 = (cols[c].to_numpy() for c in ("core1", "core2", "cls1", "cls2"))
    before, left = _matrix(cols["before"])
    after, rest = _matrix(cols["after"])
    edge = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]
    head = np.flatnonzero(edge)
    times = np.diff(np.r_[head, len(k1)])
    again = np.add.reduceat(cols["again"].to_numpy(zero_copy_only=False).astype(np.int64), head) > 0
    before, after, left, least = before[head], after[head], left[head], SIDE - rest[head]
    c1, c2, k1, k2 = c1[head], c2[head], k1[head], k2[head]
    group = np.cumsum(np.r_[True, (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])]) - 1
    dup = np.zeros((len(head), STARTS), dtype=bool)
    some = np.flatnonzero(np.bincount(group)[group] > 1)
    if len(some):
        dup[some] = shared_windows(group[some], before[some], after[some], left[some], least[some])
    dup[(times > 1) | again] = True
    d = np.arange(STARTS)
    own = (d >= least[:, None]) & (d <= left[:, None])
    dup &= own
    pad = np.zeros((len(head), 1), dtype=bool)
    near, far = np.nonzero(dup & ~np.concatenate([pad, dup[:, :-1]], axis=1)), np.nonzero(dup & ~np.concatenate([dup[:, 1:], pad], axis=1))
    if len(near[0]):
        none = pa.nulls(len(near[0]), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(k1[near[0]]), pa.array(k2[near[0]]), pa.array(near[1].astype(np.int16)), pa.array(far[1].astype(np.int16)), none, none], schema=VERDICTS)
    reach = np.full(len(head), -1, dtype=np.int64)
    for there, whose, end in ((first, group == 0, 0), (last, group == group[-1], -1)):
        if there:
            reach[whose] = np.maximum(reach[whose], _common(before[whose], before[end]))
    rows, at = np.nonzero(own & (d <= reach[:, None]))
    settled = dup[rows, at]
    for sure in (True, False):
        # windows that repeat here already bear witness once, for those beyond; the others ask for one
        seen: set[bytes] = set()
        r, x = rows[settled == sure], at[settled == sure]
        for k in range(0, len(r), 20_000):
            i, j = r[k : k + 20_000], x[k : k + 20_000]
            w = [xxhash.xxh3_128_digest(b"%d %d %d " % (c1[n], c2[n], m) + before[n, :m].tobytes() + after[n, : SIDE - m].tobytes()) for n, m in zip(i.tolist(), j.tolist())]
            if sure:
                w = [h for h in dict.fromkeys(w) if h not in seen]
                seen.update(w)
                i, j = i[: len(w)], j[: len(w)]
            if w:
                h = np.frombuffer(b"".join(w), dtype="<i8").reshape(-1, 2)
                whose = [pa.nulls(len(w), pa.int64())] * 2 if sure else [pa.array(k1[i]), pa.array(k2[i])]
                yield pa.RecordBatch.from_arrays([*whose, pa.array(j.astype(np.int16)), pa.array(j.astype(np.int16)), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], schema=VERDICTS)


def _by_core(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gathers the sorted entries of a range up to CHUNK_ROWS and to the end of a core."""
    held: list[pa.RecordBatch] = []
    n, first = 0, True
    for b in parts:
        held.append(b)
        n += len(b)
        if n >= CHUNK_ROWS:
            t = pa.Table.from_batches(held)
            core = np.stack([t.column(c).to_numpy() for c in ("core1", "core2")])
            cut = int(np.flatnonzero((core != core[:, -1:]).any(0)).max(initial=-1)) + 1
            if cut:
                yield from _verdicts(t.slice(0, cut), first, False)
                first, held, n = False, t.slice(cut).combine_chunks().to_batches(), len(t) - cut
    if n:
        yield from _verdicts(pa.Table.from_batches(held), first, True)


def _key(doc_id: str, text: str) -> list[Column]:
    """kid and h: a 128-bit hash of a row's doc_id and text.  Rows that share both have the same spans."""
    own = F.col(quoted(doc_id)).cast("long"), F.col(quoted(text))
    return [F.xxhash64(*own).alias("kid"), F.xxhash64(F.lit(1), *own).alias("h")]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(*_key(doc_id, text), F.col(quoted(text)).alias("text"))


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """kid, h (of a row's doc_id and text) and its spans [s, e) of repeated windows, as an array of structs."""
    spark = docs.sparkSession
    d = keyed(docs, doc_id, text)
    again = materialise(core_rows(d).groupBy("core").count().where("count > 1").select("core"), "cores")
    n = again.count()
    shared = spark.sparkContext.broadcast(make_filter(again, n) if n else np.zeros((FILTER_PARTS, 128), dtype=np.uint8))  # of a fixed size at most
    rows = materialise(phrase_rows(d, shared), "phrases")
    order = ["core1", "core2", "before", "after"]
    entries = rows.where("core1 is not null").select(*order, "cls1", "cls2", "again")
    entries = entries.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    found = materialise(entries.mapInArrow(_by_core, VERDICTS_DDL), "verdicts")
    edges = found.where("w1 is not null")
    beyond = edges.where("cls1 is not null").join(edges.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2"), ["w1", "w2"])
    runs = found.where("w1 is null").select("cls1", "cls2", "near", "far").unionByName(beyond.select("cls1", "cls2", "near", "far"))
    at = rows.where("kid is not null").select("cls1", "cls2", "kid", "h", "trig").join(runs, ["cls1", "cls2"])
    at = at.select("kid", "h", F.struct((F.col("trig") - F.col("far")).alias("s"), (F.col("trig") - F.col("near") + WINDOW).alias("e")).alias("span"))
    return at.groupBy("kid", "h").agg(F.collect_set("span").alias("spans"))


def merge(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs, in order."""
    out: list[list[int]] = []
    for s, e in sorted(found):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in runs:
        out.append(raw[at:s])
        at = e
    out.append(raw[at:])
    return b"".join(out)


def _merged(b: pa.RecordBatch) -> Iterator[list[tuple[int, int]]]:
    for x in column(b, "spans").to_pylist():
        yield merge([(y["s"], y["e"]) for y in x]) if x else []


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in rows:
            for i, t, runs in zip(column(b, "doc_id").to_pylist(), column(b, "text").to_pylist(), _merged(b)):
                raw = _raw(t)
                yield i, len(raw), sum(e - s for s, e in runs), len(runs), hashlib.sha256(without(raw, runs)).hexdigest()

    return _with_spans(docs, doc_id, text, parts=parts).mapInArrow(lambda it: batches(run(it), RESULT), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _with_spans(docs: DataFrame, doc_id: str, text: str, *more: str, parts: int | None = None) -> DataFrame:
    """doc_id, text, the columns more as one (rest), whose names may then be any, and the spans."""
    found = spans(docs, doc_id, text, parts)
    d = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text"), F.struct(F.lit(0), *[F.col(quoted(c)) for c in more]).alias("rest"), *_key(doc_id, text))
    return d.join(found, ["kid", "h"], "left")


def on_characters(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs drawn in to whole UTF-8 characters."""
    out = []
    for s, e in runs:
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        if s < e:
            out.append((s, e))
    return out


def clean(docs: DataFrame) -> DataFrame:
    """docs with the repeated strings removed from text, to whole characters, and n_chars counted anew."""
    names = docs.columns
    rest = [c for c in names if c not in ("doc_id", "text")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(parts, 500):
            texts = []
            for t, runs in zip(column(b, "text").to_pylist(), _merged(b)):
                raw = _raw(t)
                texts.append(without(raw, on_characters(raw, runs)).decode("utf-8", "surrogatepass") if runs else t)
            rest_of = column(b, "rest")
            cols = [pa.array(texts, pa.string()) if c == "text" else pa.array([None if t is None else len(t) for t in texts], pa.int64()) if c == "n_chars" else column(b, c) if c == "doc_id" else rest_of.field(1 + rest.index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return _with_spans(docs, "doc_id", "text", *rest).mapInArrow(run, docs.schema)
