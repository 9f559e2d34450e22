"""What filters take in every order: sort-based duplicates, failure masks and additive counters.

1. The rows are range-sorted by text fingerprint, full text and doc_id, so that equal texts lie side by side and a group of copies,
   however large, is cut by doc_id into as many ranges as it needs.  In a range a row is compared with its predecessor by full text;
   the smallest doc_id of a run of equal texts is that of its first row that has one.
2. Boundaries: ranges are cut by fingerprint and doc_id, so that no text goes to the driver with their samples, and a run may go on in
   the next ones.  The rows of a range's first and last fingerprints carry the text's SHA-256; the smallest doc_id of each such text, over all ranges, is taken from them and replaces the run's own.
3. Each row becomes a mask of the filters that it fails, and the masks are counted by part, with what the labels say: at most
   128 rows a part.  The counters add up, so they combine before they move, and a part with a third of all rows is as good as any.
4. All orders follow from the counters: what a step takes depends on the set of filters before it alone (80 of set and letter, not 600 of order and step), and the orders are laid over that.

Defined results: a null text is empty and has no words; empty texts are identical to one another.  A null doc_id is smaller than
none: its row doesn't fail E, nor does another for it, and it has no label.  Rows of one doc_id and text don't fail E for one another.
Of several labels of a doc_id a 1 stands.  A null part is the empty string.  An empty table gives an empty result.  Other columns are
ignored and may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, column, in_slices, materialise

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CAPITALS = bytes(range(65, 91))
_MARKS = re.compile(r"[#$%&*|]")


def own_failures(text: str) -> int:
    """The bits of A to D, those of a text alone."""
    words = _WORD.findall(text)
    n, raw = len(words), text.encode("utf-8", "surrogatepass")
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (n < MIN_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * n) << 1 | (100 * capitals > CAPITAL_PERCENT * len(text)) << 2 | (_MARKS.search(text) is not None) << 3


SCHEMA = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("least", pa.int64()), ("edge", pa.binary())])


#: Rows of one fingerprint that a task holds back until it knows whether they are the range's last.
HELD = 2000


def _judged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a range: their own failures, the smallest doc_id of their run so far, and the text's SHA-256 where the run may go
    on in another range, or is long."""
    claim("filteraudit")
    held: list[tuple] = []  # rows of the fingerprint at hand
    was, mask, least, digest, at, seen = None, 0, None, b"", None, 0

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), SCHEMA)], schema=SCHEMA)

    for b in in_slices(parts, 500):
        out: list[tuple] = []
        for doc_id, part, text, mark in zip(*(column(b, c).to_pylist() for c in ("doc_id", "part", "text", "fingerprint"))):
            if mark != at:
                out += held if seen == 1 else [(*r[:4], None) for r in held]
                held, at, seen = [], mark, seen + 1
            if text != was:
                was, mask, least, digest = text, own_failures(text), doc_id, hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
            held.append((doc_id, part, mask, least, digest))
            if len(held) >= HELD:
                out += held
                held = []
        if out:
            yield batch(out)
    if held:
        yield batch(held)


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """doc_id, part and mask (bits of FILTERS, A the lowest) of each row."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumn("fingerprint", F.xxhash64("text"))
    cuts, order = ([F.col(c).asc_nulls_last() for c in k] for k in (("fingerprint", "doc_id"), ("fingerprint", "text", "doc_id")))
    rows = d.repartitionByRange(*cuts).sortWithinPartitions(*order)
    rows = materialise(rows.mapInArrow(_judged, "doc_id long, part string, mask int, least long, edge binary"), "judged")
    edges = rows.where("edge is not null")
    edges = edges.join(materialise(edges.groupBy("edge").agg(F.min("doc_id").alias("first")), "edges"), "edge").select("doc_id", "part", "mask", F.col("first").alias("least"))
    got = rows.where("edge is null").select("doc_id", "part", "mask", "least").unionByName(edges)
    repeats = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return got.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(repeats, 16).otherwise(0)).alias("mask"))


def counters(failed: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """part, mask, good, toxic and n: the rows of a part by the filters that they fail and by their labels."""
    said = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])
    with_id = failed.where("doc_id is not null").join(said, "doc_id", "left")
    rows = with_id.select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    none = failed.where("doc_id is null").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return rows.unionByName(none).groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))


def _steps() -> list[tuple[int, int, int]]:
    """Letter, set of the filters before it, and how many orders have that set before that letter."""
    n = len(FILTERS)
    return [(k, s, factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for k in range(n) for s in range(1 << n) if not s >> k & 1]


def _literal(rows: list[tuple], names: str) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names.split())]) for r in rows])


def audit(counts: DataFrame) -> DataFrame:
    """Of the counters: a row for each part, order and step, with kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    counts = materialise(counts, "counters")  # at most 128 rows a part
    at = counts.select("*", F.explode(_literal(_steps(), "k before orders")).alias("at")).select("part", "mask", "good", "toxic", "n", "at.*", F.expr("shiftleft(1, at.k)").alias("bit"))
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    steps = at.groupBy("part", "k", "before", "orders").agg(
        total(~fails & ~earlier).alias("kept"), total(fails & ~earlier).alias("removed"), total(fails & earlier).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~earlier & (F.col("good") == 1)).alias("good_lost"), total(fails & ~earlier & (F.col("toxic") == 1)).alias("toxic_lost"))
    by_part = steps.groupBy("part").agg(F.collect_list(F.struct("k", "before", "orders", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")).alias("steps"))  # 80 of them
    by_part = by_part.withColumn("shapley", F.expr("transform(sequence(0, %d), k -> aggregate(filter(steps, s -> s.k = k), 0L, (t, s) -> t + s.orders * s.removed))" % (len(FILTERS) - 1)))
    by_part = by_part.withColumn("at", F.map_from_entries(F.transform("steps", lambda s: F.struct((s["k"] * (1 << len(FILTERS)) + s["before"]).alias("key"), s.alias("value")))))
    orders = []
    for o in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(o, 1):
            orders.append(("".join(FILTERS[j] for j in o), step, k, k << len(FILTERS) | before))
            before |= 1 << k
    rows = by_part.select("part", "shapley", "at", F.explode(_literal(orders, "filter_order step k key")).alias("o"))
    s = F.col("at")[F.col("o.key")]
    return rows.select("part", "o.filter_order", "o.step", *[s[c].alias(c) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")], F.col("shapley")[F.col("o.k")].alias("shapley"))
