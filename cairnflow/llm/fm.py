"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Score: sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]), which takes time linear in the features
that a text has.  Features: each distinct word (letters only, lower case) hashed to one of ``BUCKETS``, weighted by the log of
its count and scaled to unit length; structure statistics (shares of capitals, marks, symbols, repeated words and lines, ...),
each cut into steps of its own; and the logarithm of the length.

Training is on the driver over a sample of at most ``sample`` labelled rows (default 12,000), taken in the order of a hash of
their id; of it the features alone are collected, all of each text, as they are scored: six bytes each, widened batch by batch.
The model is 16,639 x 9 numbers, a fixed size, and is sent to the tasks with the function.

Scale: scoring is a map over the scan with no shuffle; choosing the sample is a top-k over the labels, joined by key.

Defined results: a null or empty text gets the score of its (empty) features.  Repeated rows each get a row.  Labels that are
null, or of rows that are held out, aren't used; if no label is left every score is 1.  If a doc_id has several labels the least
counts; of several texts that share a labelled doc_id one is learnt from.  Other columns are ignored and may have any name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, column, hold, quoted

WORD_BITS, RANK = 14, 8
STEPS = 16
#: Statistics of a text, in order; their meaning is in ``structure``.
STATS = ("capitals", "marks", "symbols", "digits", "repeat_next", "distinct", "lines_repeat", "word_length", "long_words", "bars", "length", "shouts", "per_line", "top_word", "pair_repeat")
BUCKETS = (1 << WORD_BITS) + len(STATS) * (STEPS + 1)
SAMPLE, EPOCHS = 12_000, 12
THRESHOLD, FOLDS = 0.3, 5
_LETTERS = re.compile(r"[^\W\d_]+")
_SYMBOLS = np.frombuffer(b"#*$%&|<>{}[]\\^~=+@", dtype=np.uint8)
_STAT_AT = (1 << WORD_BITS) + np.arange(len(STATS)) * (STEPS + 1)
_HALF = np.full(len(STATS), 0.5)


def structure(text: str, words: list[str], letters: int) -> list[float]:
    """Each in [0, 1]; letters: how many characters are letters."""
    n, m = max(1, len(text)), max(1, len(words))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    ascii_count = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    seen = Counter(words)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    marks = n - letters - int(ascii_count[32] + ascii_count[10])
    return [
        min(1.0, 2 * float(ascii_count[65:91].sum()) / n),
        min(1.0, max(0.0, 4 * marks / n)),
        min(1.0, 6 * float(ascii_count[_SYMBOLS].sum()) / n),
        min(1.0, 6 * float(ascii_count[48:58].sum()) / n),
        sum(map(eq, words, islice(words, 1, None))) / m,
        len(seen) / m,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, float(lens.sum()) / m / 20),
        float((lens > 20).sum()) / m,
        min(1.0, 3 * float(ascii_count[124]) / m),
        min(1.0, math.log1p(len(words)) / 12),
        sum(map(str.isupper, words)) / m,
        min(1.0, math.log1p(m / max(1, len(lines))) / 8),
        max(seen.values(), default=0) / m,
        1 - len(set(zip(words, islice(words, 1, None)))) / max(1, len(words) - 1),
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and values."""
    text = text or ""
    words = text.split()
    tokens = _LETTERS.findall(text.lower())
    count = Counter(tokens)
    ids = np.fromiter(map(_bucket, count), dtype=np.int64, count=len(count))
    vals = 1 + np.log(np.fromiter(count.values(), dtype=np.float64, count=len(count)))
    if len(vals):
        vals /= np.sqrt((vals * vals).sum())
    stats = np.array(structure(text, words, sum(map(len, tokens))))
    step = np.minimum(STEPS - 1, (stats * STEPS).astype(np.int64))
    return np.concatenate([ids, _STAT_AT + step, _STAT_AT + STEPS]), np.concatenate([vals, _HALF, stats])


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        b = zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << WORD_BITS) - 1)
        if len(self) < 300_000 and len(word) < 40:
            self[word] = b
        return b


_KNOWN = _Buckets()
hold("fm", _KNOWN.clear)
_bucket = _KNOWN.__getitem__


class Machine:
    """The model; ``flat`` is w and v side by side."""

    def __init__(self, w0: float, flat: np.ndarray):
        self.w0, self.flat = w0, flat

    def logit(self, ids: np.ndarray, vals: np.ndarray) -> float:
        t = self.flat[ids] * vals[:, None]
        s = t.sum(0)
        v = t[:, 1:]
        return float(self.w0 + s[0] + 0.5 * ((s[1:] ** 2).sum() - (v * v).sum()))

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.logit(*features(text))))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rank: int = RANK, seed: int = 7, rate: float = 0.05, decay: float = 1e-5) -> Machine:
    """Adagrad over small batches, logistic loss."""
    rng = np.random.default_rng(seed)
    flat = np.concatenate([np.zeros((BUCKETS, 1)), rng.normal(0, 0.01, (BUCKETS, rank))], axis=1)
    if not len(rows):
        return Machine(30.0, flat)
    p = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    w0, g0, grad2 = math.log(p / (1 - p)), 1e-8, np.full(flat.shape, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 64):
            part = order[a : a + 64]
            sizes = np.array([len(rows[k][0]) for k in part])
            ids, vals = np.concatenate([rows[k][0] for k in part]).astype(np.int64), np.concatenate([rows[k][1] for k in part]).astype(np.float64)
            own, at = np.repeat(np.arange(len(part)), sizes), np.r_[0, np.cumsum(sizes)[:-1]]
            t = flat[ids] * vals[:, None]
            s = np.add.reduceat(t, at, axis=0)
            z = w0 + s[:, 0] + 0.5 * ((s[:, 1:] ** 2).sum(1) - np.add.reduceat((t[:, 1:] ** 2).sum(1), at))
            e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]
            g = np.empty_like(t)
            g[:, 0] = vals
            g[:, 1:] = vals[:, None] * (s[own, 1:] - t[:, 1:])
            g *= e[own, None] / len(part)
            seen, back = np.unique(ids, return_inverse=True)
            total = np.zeros((len(seen), flat.shape[1]))
            np.add.at(total, back, g)
            total += decay * flat[seen]
            grad2[seen] += total * total
            flat[seen] -= rate * total / np.sqrt(grad2[seen])
            d = e.mean()
            g0 += d * d
            w0 -= rate * d / math.sqrt(g0)
    return Machine(w0, flat)


def held_out(doc_id, folds: int = FOLDS):
    """True for the rows that no label is learnt from."""
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Machine:
    y = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # a top-k by hash, then one label for each id; repeated labels of an id have one hash and so stay together but at the end
    y = y.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(y), "doc_id")  # at most sample rows of two numbers

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            got = [features(t) for t in column(b, "text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": column(b, "doc_id"), "y": column(b, "y").cast(pa.int32()), "ids": pa.array([g[0].astype("<u2").tobytes() for g in got], pa.binary()), "vals": pa.array([g[1].astype("<f4").tobytes() for g in got], pa.binary())})

    # of rows that repeat an id the one of the least features: at most sample rows
    one = d.mapInArrow(run, "doc_id long, y int, ids binary, vals binary").groupBy("doc_id").agg(F.min(F.struct("ids", "vals", "y")).alias("r"))
    rows = [r["r"] for r in sorted(one.collect(), key=lambda r: r["doc_id"])]
    return train([(np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["vals"], "<f4")) for r in rows], np.array([r["y"] for r in rows], dtype=np.float64))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, model: Machine, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    flat, w0 = model.flat.astype(np.float32), model.w0

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("fm")
        m = Machine(w0, flat)
        for b in parts:
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array([m.score(t) for t in column(b, "text").to_pylist()], pa.float64())], schema=SCHEMA)

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
    return d.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with a score of at least threshold, in one map over them; a row travels as one struct, whose fields may have any name."""
    flat, w0, at = model.flat.astype(np.float32), model.w0, docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("fm")
        m = Machine(w0, flat)
        for b in parts:
            yield b.filter(pa.array([m.score(t) >= threshold for t in column(b, "row").field(at).to_pylist()], pa.bool_()))

    rows = docs.select(F.struct(*[F.col(quoted(c)).alias(c) for c in docs.columns]).alias("row"))
    return rows.mapInArrow(run, rows.schema).select(*[F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])
