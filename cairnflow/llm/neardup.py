"""Near duplicates by one-permutation MinHash with optimal densification, banded buckets and star-shaped candidate edges.

A document's set is its distinct shingles of ``words`` words, three by default (the whole sequence if it has fewer).  One hash of each shingle deals
it to one of ``BINS`` bins, the least of a bin is its value, and each empty bin takes the value of the first full one in a fixed
random order of its own (optimal densification).  The bins are cut into ``bands``; documents with an equal band share a bucket.

1. Documents with equal sets form a class, represented by its smallest id; only representatives go on.
2. In each bucket every member is linked to the smallest one (a star, so a bucket makes no more candidates than it has members).
   Candidates whose sizes and 1024-bit maps allow it are confirmed on their full sets, and components are formed.
3. In buckets that still hold several components a second star has a centre drawn by bucket, so that a member meets a different
   one in each of its buckets.
4. Stars can miss a link between two members that both differ from their centres.  The members of the buckets that still hold
   several components are settled exactly by their sets' rarest shingles: a set of n that links with one of another component
   shares at least ``percent`` of n with it, so one of its first n - that + 1 shingles, in an order that puts first what no other
   component has, then what few sets have.  A shingle that only one component has joins with nothing: pages from one template,
   whose own parts are more than the threshold lets differ, make no pairs at all.  Of two sets that link, the first shingle they
   share has as many behind it in either as the link needs, by both sizes; what can't be that first one makes no pair, so those
   that miss the threshold by little don't meet once for each rare shingle.  The pairs that are left, and pass the bounds by
   sizes and maps, are confirmed on full sets.

So the result is that of comparing all pairs that share a bucket.  With 32 bands of 5 a pair of similarity 0.85 shares no bucket with a chance of 7e-9; with 40 of 4 one of 0.8 with 7e-10.

Scale: texts are read for sets alone, and only those of candidates move, in 64-bit hashes; buckets and shingles are counted with
map-side combining, joined by key and split by AQE when hot; links and components stay in the shared folder.  A worker turns
texts into hashes half a megabyte (or one text) at a time.

Defined results: a null text, or one without words, has an empty set, is linked with nothing and is kept.  Rows of equal doc_id
are one document with several sets.  A null doc_id is linked with nothing; its component is null and it is kept.  An empty
table gives an empty result.  Other columns are ignored and may have any name and type.  ``keep_one`` goes by row, not by doc_id: of the rows
that are linked, or repeat one another, one stays, also where their doc_ids are null or equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, column, materialise, quoted
from .components import components
from .ordermin import mix

WORDS = 3
BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
PERCENT = 85
MASK_LONGS = 16
PART_BYTES = 1 << 19
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_ATTEMPTS = 4096
_ORDER = None
_R = 0x2127599BF4325C37


def _letters() -> np.ndarray:
    """A random number for each byte; A-Z have those of a-z."""
    t = mix(np.arange(1, 257, dtype=np.uint64) * _B)
    t[65:91] = t[97:123]
    return t


_LETTER = _letters()
_GAP = np.zeros(256, dtype=bool)
_GAP[[32, *range(9, 14)]] = True
_POWERS: tuple[np.ndarray, np.ndarray] | None = None


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse modulo 2^64; those of a part of a usual size are kept."""
    global _POWERS
    if _POWERS is None or len(_POWERS[0]) < n:
        p = tuple(np.cumprod(np.r_[np.uint64(1), np.full(max(n, PART_BYTES) - 1, r, dtype=np.uint64)]) for r in (np.uint64(_R), np.uint64(pow(_R, -1, 1 << 64))))
        if n > PART_BYTES:
            return p
        _POWERS = p
    return _POWERS


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of texts that lie side by side in data, and where each text's words begin (one more at the end)."""
    n = len(data)
    inside = ~_GAP[data]
    cut = np.zeros(n + 1, dtype=bool)  # no word goes on from the byte before
    cut[offsets] = True
    cut[1:] |= ~np.r_[inside[:-1], False][:n] if n else False
    first = np.flatnonzero(inside & cut[:n])
    end = np.zeros(n + 1, dtype=bool)
    end[offsets] = True
    end[:n] |= ~inside
    last = np.flatnonzero(inside & end[1:]) + 1
    up, down = _powers(n + 1)
    h = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_LETTER[data] * up[:n], out=h[1:])
    h = (h[last] - h[first]) * down[first] + (last - first).astype(np.uint64)
    return mix(h), np.searchsorted(first, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    h, at = word_hashes(data, offsets)
    many = max(0, len(h) - words + 1)
    s = np.full(many, np.uint64(words))
    for j in range(words):
        s = mix(s * _A + h[j : j + many])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= words:
            yield np.unique(s[a : b - words + 1])
        elif b > a:
            x = np.full(1, np.uint64(b - a))
            for j in range(a, b):
                x = mix(x * _A + h[j : j + 1])
            yield x
        else:
            yield np.zeros(0, dtype=np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; A-Z count as a-z."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return next(shingle_sets(raw, np.array([0, len(raw)]), words))


def _parts(b: pa.RecordBatch, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The sets of a batch's texts, as (first row, sets of it and the next rows), about half a megabyte of text at a time."""
    t = pc.fill_null(column(b, "text"), "")
    t = t.combine_chunks() if isinstance(t, pa.ChunkedArray) else t
    kind = np.int64 if pa.types.is_large_string(t.type) else np.int32
    offsets = np.frombuffer(t.buffers()[1], dtype=kind)[t.offset : t.offset + len(t) + 1].astype(np.int64) if len(t) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(t.buffers()[2], dtype=np.uint8) if t.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    k = 0
    while k < len(t):
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + PART_BYTES, side="right")) - 1)
        end = min(end, len(t))
        yield k, list(shingle_sets(data[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k], words))
        k = end


def _lists(rows: list[np.ndarray]) -> pa.Array:
    """A list array of 64-bit numbers; an empty row is null."""
    at = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    values = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values), mask=pa.array(np.diff(at) == 0))


def _order() -> np.ndarray:
    """For each bin, the bins it asks in turn when it is empty."""
    global _ORDER
    if _ORDER is None:
        grid = np.arange(BINS, dtype=np.uint64)[None, :] * np.uint64(_ATTEMPTS) + np.arange(_ATTEMPTS, dtype=np.uint64)[:, None]
        _ORDER = (mix((grid + np.uint64(1)) * _B) % np.uint64(BINS)).astype(np.int64)
    return _ORDER


def signature(s: np.ndarray) -> np.ndarray:
    """BINS values of a non-empty sorted set."""
    bins = ((s >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    full, first = np.unique(bins, return_index=True)  # s is sorted, and so are its bins: the first of a bin is its least
    out = np.zeros(BINS, dtype=np.uint64)
    out[full] = s[first]
    has = np.zeros(BINS, dtype=bool)
    has[full] = True
    empty = np.flatnonzero(~has)
    order = _order()
    for j in range(_ATTEMPTS):
        if not len(empty):
            return out
        ask = order[j, empty]
        ok = has[ask]
        out[empty[ok]] = out[ask[ok]]
        empty = empty[~ok]
    out[empty] = out[full[0]]
    return out


def band_keys(sigs: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A signed 64-bit key of each band of each signature; the band's number is part of it."""
    g = sigs.reshape(len(sigs), bands, -1)
    k = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _B, g.shape[:2])
    for j in range(g.shape[2]):
        k = mix(k * _A + g[:, :, j])
    return k.view(np.int64)


def mask(s: np.ndarray) -> np.ndarray:
    """A bit map of a set: a bit that it has and another set's hasn't stands for a shingle of its own at least."""
    bits = np.zeros(MASK_LONGS * 64, dtype=np.uint8)
    bits[(s & np.uint64(MASK_LONGS * 64 - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    """The halves of a 128-bit hash of each set; null for an empty one."""
    d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), dtype="<i8").reshape(-1, 2)
    none = np.array([not len(s) for s in sets], dtype=bool)
    return [pa.array(d[:, k].copy(), mask=none) for k in (0, 1)]


_NONE = np.zeros(0, dtype=np.int64)
_LONGS = pa.list_(pa.int64())


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set, its map and bands (null for an empty set)."""
    names = ["doc_id", "n_shingles", "h1", "h2", "mask", "bands"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("neardup")
        for b in parts:
            ids = column(b, "doc_id")
            for k, sets in _parts(b, words):
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(np.stack([signature(s) for s in full]), bands) if full else ())
                yield pa.RecordBatch.from_arrays([ids.slice(k, len(sets)), pa.array([len(s) for s in sets], pa.int64()), *_digests(sets), _lists([mask(s) if len(s) else _NONE for s in sets]), _lists([next(keys) if len(s) else _NONE for s in sets])], names=names)

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return d.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, mask array<long>, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, words: int = WORDS) -> DataFrame:
    """cls, h1, h2 and set (sorted hashes) of the classes in wanted (cls, h1, h2): a class's set is that of a row with its hash."""
    names = ["cls", "h1", "h2", "set"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("neardup")
        for b in parts:
            ids = column(b, "doc_id")
            for k, sets in _parts(b, words):
                yield pa.RecordBatch.from_arrays([ids.slice(k, len(sets)), *_digests(sets), _lists(sets)], names=names)

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    d = d.join(wanted.select(F.col("cls").alias("doc_id")).distinct(), "doc_id", "left_semi")
    s = d.mapInArrow(run, "cls long, h1 long, h2 long, set array<long>")
    # rows of equal doc_id and set repeat one another: any one will do
    return s.join(wanted, ["cls", "h1", "h2"], "left_semi").dropDuplicates(["cls", "h1", "h2"])


def _fits(percent: int) -> Column:
    """Whether sizes (na, nb) and maps (ma, mb) let two sets be similar enough: similarity >= p / 100 is an intersection of at
    least p / (100 + p) of the sizes' sum."""
    own = [sum((F.bit_count(F.get(x, F.lit(k)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(k))))) for k in range(MASK_LONGS)), F.lit(0)) for x, y in (("ma", "mb"), ("mb", "ma"))]
    sizes = (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na"))
    return sizes & ((100 + percent) * F.least(F.col("na") - own[0], F.col("nb") - own[1]) >= percent * (F.col("na") + F.col("nb")))


def _bounded(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that sizes and maps let be similar enough."""
    a, b = (reps.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("mask").alias(f"m{k}")) for k in "ab")
    return pairs.join(b, "b").join(a, "a").where(_fits(percent)).select("a", "b").distinct()


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    x, y = (sets.select(F.col("cls").alias(k), F.col("set").alias(f"s{k}")) for k in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(y, "b").join(x, "a").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct()


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """members (band, cls) of the buckets that still hold several components, with the component of each."""
    comp = materialise(components(links), "components")
    m = members.select("band", "cls").join(comp.select(F.col("node").alias("cls"), "component"), "cls", "left").select("band", "cls", F.coalesce("component", "cls").alias("comp"))
    m = materialise(m, "labelled")
    mixed = m.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi")).select("band")
    return materialise(m.join(mixed, "band", "left_semi"), "mixed")


def rare_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of rows (cls, h1, comp, n, mask, set) of different components that share one of their rarest shingles, as
    many as a link of theirs must have one of, with enough behind it in both, and whose sizes and maps fit."""
    tokens = rows.select("cls", "h1", "comp", F.explode("set").alias("token"))
    several = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi")).select("token", "df")
    shared = tokens.select("cls", "h1", "token").join(several, "token").groupBy("cls", "h1").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    # of the first n - ceil(n * percent / 100) + 1 shingles, those that no other component has come first
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("shared"))
    sizes = rows.groupBy("comp").agg(F.count("*").alias("members"))
    info = rows.select("cls", "h1", "comp", "n", "mask").join(sizes, "comp")
    prefix = shared.join(info, ["cls", "h1"]).where(first > 0).select("cls", F.struct("members", "comp").alias("rank"), "n", "mask", F.size("shared").alias("size"), F.posexplode(F.slice("shared", F.lit(1), first.cast("int"))["token"]).alias("at", "token"))
    # what is shared with any set of another component whose first common shingle this is
    prefix = prefix.select("cls", "rank", "n", "mask", "token", (F.col("size") - F.col("at")).alias("rest"))
    prefix = materialise(prefix, "prefixes")
    # of two components the smaller one asks, so that the many members of a token's largest don't meet one another
    top = prefix.groupBy("token").agg(F.max("rank").alias("top"), F.min("rank").alias("least")).where(F.col("top") != F.col("least")).select("token", "top")
    known = prefix.join(top, "token")
    ask = known.where(F.col("rank") < F.col("top")).select("token", F.col("cls").alias("a"), F.col("rank").alias("ra"), F.col("n").alias("na"), F.col("mask").alias("ma"), F.col("rest").alias("resta"))
    told = known.select("token", F.col("cls").alias("b"), F.col("rank").alias("rb"), F.col("n").alias("nb"), F.col("mask").alias("mb"), F.col("rest").alias("restb"))
    enough = (100 + percent) * F.least("resta", "restb") >= percent * (F.col("na") + F.col("nb"))
    return ask.join(told, (ask["token"] == told["token"]) & (F.col("ra") < F.col("rb")) & enough & _fits(percent)).select("a", "b").distinct()


def _linked(docs: DataFrame, percent: int, doc_id: str, text: str, words: int, bands: int) -> tuple[DataFrame, DataFrame]:
    """signatures of docs, and the classes of equal sets (h1, h2, rep) with their component c; bands divides BINS."""
    sigs = materialise(signatures(docs, doc_id, text, words, bands), "sigs")
    real = sigs.where(F.col("h1").isNotNull() & F.col("doc_id").isNotNull())
    classes_ = real.groupBy("h1", "h2").agg(F.min("doc_id").alias("cls"))
    # a class goes by its representative's id: classes that share one are sets of one document
    reps = real.withColumnRenamed("doc_id", "cls").join(classes_, ["h1", "h2", "cls"], "left_semi").select("cls", "h1", "h2", F.col("n_shingles").alias("n"), "mask", "bands").dropDuplicates(["cls", "h1", "h2"])
    reps = materialise(reps, "reps")
    rows = reps.select("cls", F.explode("bands").alias("band"))
    crowded = rows.groupBy("band").agg(F.min("cls").alias("centre"), F.max("cls").alias("_other")).where(F.col("centre") != F.col("_other")).drop("_other")
    members = materialise(rows.join(crowded, "band").select("band", "cls", "centre").distinct(), "members")
    reps = reps.drop("bands")
    star = materialise(_bounded(members.where(F.col("cls") != F.col("centre")).select(F.col("centre").alias("a"), F.col("cls").alias("b")).distinct(), reps, percent), "star")
    # sets of what has a candidate, and of what may yet get one
    sets = materialise(full_sets(docs, reps.select("cls", "h1", "h2").join(members.select("cls").distinct(), "cls", "left_semi"), doc_id, text, words), "sets")
    links = materialise(_confirm(star, sets, percent), "confirmed")
    left = _labelled(members, links)
    centre = left.groupBy("band").agg(F.min_by(F.struct("cls", "comp"), F.xxhash64("cls", "band")).alias("c"))
    second = left.join(centre, "band").where(F.col("comp") != F.col("c.comp")).select(F.least("cls", "c.cls").alias("a"), F.greatest("cls", "c.cls").alias("b")).distinct()
    second = materialise(_bounded(second.join(star, ["a", "b"], "left_anti"), reps, percent), "second")
    links = links.unionByName(materialise(_confirm(second, sets, percent), "confirmed"))
    left = _labelled(left, links)
    open_rows = left.select("cls", "comp").distinct().join(sets, "cls").join(reps.select("cls", "h1", "h2", "n", "mask"), ["cls", "h1", "h2"])
    rare = rare_pairs(materialise(open_rows, "open"), percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rare = materialise(rare.distinct().join(star, ["a", "b"], "left_anti").join(second, ["a", "b"], "left_anti"), "rare")
    comp = materialise(components(links.unionByName(_confirm(rare, sets, percent))), "components")
    return sigs, reps.select("h1", "h2", "cls").join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("h1", "h2", F.coalesce("component", "cls").alias("c"))


def classes(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, bands: int = BANDS) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept; bands divides BINS."""
    sigs, named = _linked(docs, percent, doc_id, text, words, bands)
    out = sigs.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, bands: int = BANDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, the one of the smallest doc_id (null last, then by text); rows without words stay.  Rows are numbered and written
    once, so each stands for itself, whatever its columns hold and are named."""
    rows = materialise(docs.select(F.monotonically_increasing_id().alias("id"), F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns]).alias("row")), "numbered")
    own = rows.select("id", F.col(f"row.{quoted(doc_id)}").cast("long").alias("doc"), F.col(f"row.{quoted(text)}").alias("text"))
    sigs, named = _linked(own, percent, "id", "text", words, bands)
    d = sigs.where("h1 is not null").select(F.col("doc_id").alias("id"), "h1", "h2").join(named, ["h1", "h2"]).select("id", "c")
    d = materialise(d.join(own.select("id", "doc", F.xxhash64("text").alias("h")), "id"), "rows")
    best = d.groupBy("c").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "h", "id"))["id"].alias("id"))
    gone = materialise(d.join(best, "id", "left_anti").select("id"), "gone")
    return rows.join(gone, "id", "left_anti").select(*[F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])
