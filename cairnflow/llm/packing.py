"""Best-fit packing of token sequences into as few rows of a fixed length as it can, with certified bounds.

Documents are tokenised, closed by an end id, and only longer ones are cut into full pieces and a rest.  Full pieces are rows of
their own.  The other pieces are dealt to partitions of bounded size; each is packed by best-fit decreasing, and dual feasible
functions over the histogram of its lengths give a lower bound on its rows.  Where the bound is met the packing is proven
optimal.  Partitions with a gap give up their least full rows, whose pieces meet those of other such partitions in fewer, newly
dealt ones and are packed again; rounds go on until all is certified, one partition is left, or a round saves no row.  The bound over
all lengths together certifies the whole.

Scale: tokenising is a map over the scan; only (piece, length) moves after that.  No task holds more than ``PART_ITEMS`` pieces
on average, whatever the table's size, and the driver sees counts alone.  Hot sources or long documents don't matter, since
pieces are dealt by a hash of their key.

Defined results: a null or empty text is the end id alone.  A null doc_id is kept.  Repeated rows are packed each.  An empty
table gives an empty result.  Other columns are ignored and may have any name.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, column, in_slices, materialise
from .wordbpe import default_path, encoder

CAPACITY, END_ID = 2048, 0
PART_ITEMS = 100_000

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("key", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, a key to deal it by, and the ids' bytes if asked for."""
    path = tokenizer or default_path()
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = PIECES.append(pa.field("ids", pa.binary())) if with_ids else PIECES

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in in_slices(parts):
            for i, ids in zip(column(b, "doc_id").to_pylist(), encoder(path).packed_many(column(b, "text").to_pylist())):
                ids += end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    key = zlib.crc32(f"{i}:{p}".encode()) << 20 | p & 0xFFFFF
                    yield (i, p, at // 4, len(part) // 4, zlib.crc32(part), key) + ((part,) if with_ids else ())

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, key long" + ", ids binary" * with_ids
    return d.mapInArrow(lambda it: batches(rows(it), schema), ddl)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Rows that any packing needs: the most that a family of dual feasible functions proves.

    f_e (0 <= e <= C / 2) maps what is over C - e to C and what is under e to nothing; u_k maps x to x where (k + 1) x / C is
    whole and to floor((k + 1) x / C) C / k elsewhere.
    """
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(n: np.ndarray, capacity: int = CAPACITY) -> int:
    """lower_bound of n[x] pieces of each length x."""
    x = np.arange(capacity + 1, dtype=np.int64)
    count, total = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * x)]
    e = np.arange(0, capacity // 2 + 1)
    big = count[-1] - count[capacity - e + 1]
    mid = total[capacity - e + 1] - total[e]
    best = int((big + -(-mid // capacity)).max())
    for k in range(1, 21):
        parts = np.where((k + 1) * x % capacity == 0, x * k, (k + 1) * x // capacity * capacity)  # times k
        best = max(best, int(-(-int((n * parts).sum()) // (capacity * k))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each length; equal lengths in their order."""
    out = np.empty(len(lengths), dtype=np.int64)
    room: list[int] = []  # the kinds of room that open bins have, ascending
    open_bins: dict[int, list[int]] = {}
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        x = int(lengths[i])
        at = bisect_left(room, x)
        if at < len(room):
            left = room[at]
            stack = open_bins[left]
            b = stack.pop()
            if not stack:
                del open_bins[left], room[at]
            left -= x
        else:
            b, left = made, capacity - x
            made += 1
        out[i] = b
        if left:
            if left not in open_bins:
                open_bins[left] = []
                insort(room, left)
            open_bins[left].append(b)
    return out


_PACKED = "key long, doc_id long, piece int, length long, part long, bin long, fill long, bound long, bins long"


def _pack_part(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "doc_id", "piece", "length"], kind="stable", na_position="first").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(dtype=np.int64)
        pdf["bin"] = best_fit_decreasing(lengths, capacity)
        pdf["fill"] = np.bincount(pdf["bin"], weights=lengths).astype(np.int64)[pdf["bin"]]
        pdf["bound"], pdf["bins"] = lower_bound(lengths, capacity), int(pdf["bin"].max()) + 1
        return pdf[["key", "doc_id", "piece", "length", "part", "bin", "fill", "bound", "bins"]]

    return run


def assign(items: DataFrame, capacity: int = CAPACITY, part_items: int = PART_ITEMS) -> tuple[DataFrame, dict]:
    """items (key, doc_id, piece, length under capacity) with round, part and bin, and what is proven: rows used and bounds.

    Pieces of a row stay together; a row is final once its partition is certified or gives it no more to the exchange."""
    done: list[DataFrame] = []
    n = items.count()
    report: dict = {"rounds": 0, "rows": 0, "certified": 0, "parts": 0, "gap": 0}
    left, left_n, r, before = items, n, 0, None
    while left_n:
        parts = max(1, -(-left_n // part_items))
        dealt = left.select("key", "doc_id", "piece", "length", F.pmod(F.xxhash64("key", F.lit(r)), F.lit(parts)).cast("long").alias("part"))
        packed = materialise(dealt.groupBy("part").applyInPandas(_pack_part(capacity), _PACKED), f"packed{r}").withColumn("round", F.lit(r))
        by_part = packed.groupBy("part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"))
        t = by_part.agg(F.sum("bins").alias("bins"), F.sum((F.col("bins") - F.col("bound"))).alias("gap"), F.count("*").alias("parts"), F.sum((F.col("bins") == F.col("bound")).cast("int")).alias("certified")).first()
        report |= {"rounds": r + 1, "rows": report["rows"] + t["bins"], "certified": t["certified"], "parts": t["parts"], "gap": t["gap"]}
        spare = packed.where((F.col("bins") > F.col("bound")) & (F.col("fill") < F.lit(capacity) - F.lit(capacity) / 256))
        give = spare.agg(F.count("*").alias("n"), F.sum("length").alias("sum"), F.sum(F.lit(1.0) * F.col("length") / F.col("fill")).alias("rows")).first()
        gain = (give["rows"] or 0) - (give["sum"] or 0) / capacity
        # only what several partitions can put together is dealt again, and only while a round saves rows
        if t["parts"] == 1 or t["gap"] == 0 or gain < 1 or before is not None and report["rows"] >= before:
            done.append(packed)
            break
        before, r = report["rows"], r + 1
        out = (F.col("bins") > F.col("bound")) & (F.col("fill") < F.lit(capacity) - F.lit(capacity) / 256)
        done.append(packed.where(~out))
        report["rows"] -= round(give["rows"])
        left, left_n = packed.where(out), give["n"]
    if not done:
        done = [items.select("key", "doc_id", "piece", "length", *[F.lit(0).cast("long").alias(c) for c in ("part", "bin", "fill", "bound", "bins")], F.lit(0).alias("round"))]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, report


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, part_items: int = PART_ITEMS) -> tuple[DataFrame, dict]:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; and the report of ``assign``, with all rows
    (``sequences``) and those that any packing needs (``bound``), of full pieces too."""
    cut = materialise(pieces(docs, tokenizer, capacity, end_id).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    full = cut.where(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # a piece's own number stands in for its key from here on: it is unique where rows repeat
    items = cut.where(F.col("length") < capacity)
    packed, report = assign(items.select(F.col("uid").alias("key"), "doc_id", "piece", "length"), capacity, part_items)
    counts = np.zeros(capacity + 1, dtype=np.int64)  # a row for each length at most
    for length, n in cut.groupBy("length").count().collect():
        counts[length] = n
    report |= {"sequences": report["rows"] + int(counts[capacity]), "bound": bound_of_counts(counts, capacity)}
    row = F.col("round").cast("long") * F.lit(1 << 56) + F.col("part") * F.lit(1 << 24) + F.col("bin")
    w = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "key")
    placed = packed.select("key", "length", row.alias("sequence_id")).withColumn("offset", F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.select("key", "sequence_id", F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))
    rest = items.select(F.col("uid").alias("key"), "doc_id", "piece", "start", "length", "ids_crc32").join(placed, "key").drop("key")
    return full.unionByName(rest), report
