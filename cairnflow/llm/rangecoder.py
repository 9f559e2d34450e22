"""Token ids in files, by an adaptive context-mixing range coder.

Ids are cut into blocks of ``BLOCK`` that are reset, coded and checked on their own.  A block is dealt to up to ``LANES`` lanes,
runs of its ids that are coded in step, one id of each at a time: a step is a few array operations over all lanes, and all lanes
learn one model, so that it sees a block's ids some thousand times faster than any one lane would.

Order 2 (a table by the last two ids) and order 1 (by the last id) each foresee one id, with a confidence.  Both confidences, and
whether both foresee the same id, choose a mixing context, whose adaptive shares say how likely order 2 is right, or order 1
alone is, or neither.  In the last case order 0 gives the id's share: adaptive counts, by id, of those that no context foresaw,
with an escape to plain bits for ids not seen before.  The product of both shares drives one step of a range coder with a
64-bit range, 32-bit words and carries.

File: the magic, counts of blocks and documents; of each block (ids, greatest id, crc32 of its ids, bytes that follow) as unsigned
32-bit numbers; of each document doc_id (64-bit), a null flag and its number of ids; then each block's words by lane (unsigned
32-bit) and the words.  All numbers little-endian.  ``manifest.json``, renamed into place last, lists the files in order with
their counts, and a reader reads what it lists alone.

Scale: texts move once, to the ranges of their doc_id (a null or repeated one that fills several is dealt by text), and are encoded
and written there; a file holds at most ``FILE_IDS`` ids
(or one document), a worker one block's ids and the coded file.  Files are written under temporary names and renamed, so a task
that runs again, or twice, leaves the same files.  The driver holds a row a file.

Defined results: a null or empty text is the end id alone.  Null doc_ids come first.  Rows of equal doc_id follow by text, null
first; where they fill several ranges, by range and then by text.  An empty table gives an empty manifest and result.  Other columns are ignored and may have any name.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, column, fresh_dir, in_slices, store
from .ordermin import ranges
from .wordbpe import default_path, encoder

BLOCK, LANES, LEAST_STEPS, FILE_IDS = 1 << 21, 4096, 128, 16_000_000
MAGIC = b"CFIDS03\n"
END_ID = 2
MAX_ID = (1 << 24) - 1

_PAIR_BITS = 17
_FLAG_BITS, _ID_BITS = 12, 16
_FLAG_ONE, _ID_ONE = 1 << _FLAG_BITS, 1 << _ID_BITS
_CONTEXTS = 128  # eight confidences of either order, and whether both agree
_MOST_IDS = 1 << 15  # ids that order 0 gives a share of their own
#: Of a confidence from 0 to 7 when its order was wrong, then when it was right.
_CHANGE = np.array([0, -1, -1, -2, -2, -3, -3, -4, 1, 1, 1, 1, 1, 1, 1, 0], dtype=np.int64)
_U = np.uint64
_SHIFT, _ID_SHIFT, _WORD, _LOW = _U(_FLAG_BITS + _ID_BITS), _U(_ID_BITS), _U(32), _U(0xFFFFFFFF)
_FULL = _U(0xFFFFFFFFFFFFFFFF)


class Model:
    """The predictions that all lanes of a block share; what a step codes is learnt after it."""

    def __init__(self, top: int, lanes: int, decodes: bool):
        self.decodes = decodes
        # of a context, the id it foresees and, in the low three bits, the confidence
        self.pairs, self.singles = np.zeros(1 << _PAIR_BITS, dtype=np.int64), np.zeros(top + 1, dtype=np.int64)
        self.last, self.pair = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
        self.seen = np.full((_CONTEXTS, 4), 2.0)  # of each mixing context: order 2 was right, order 1 alone was, neither was
        self.seen[:, 3] = 0
        self.counts, self.missed, self.escapes = np.zeros(top + 1, dtype=np.int64), [], 1
        self.step, self.next_table = 0, 0
        self.mix()

    def mix(self) -> None:
        """Starts and widths of the three outcomes in each mixing context."""
        c = self.seen[:, :3]
        w = (c * ((_FLAG_ONE - 3) / c.sum(1, keepdims=True))).astype(np.int64) + 1
        w[:, 2] = _FLAG_ONE - w[:, 0] - w[:, 1]
        start, width = np.zeros((_CONTEXTS, 4), dtype=np.int64), np.zeros((_CONTEXTS, 4), dtype=np.int64)
        start[:, 1], start[:, 2], width[:, :3] = w[:, 0], w[:, 0] + w[:, 1], w
        self.edge1, self.edge2 = start[:, 1].copy(), start[:, 2].copy()
        self.start, self.width = (start << _ID_BITS).astype(_U).ravel(), (width << _ID_BITS).astype(_U).ravel()

    def order0(self) -> None:
        """Starts and widths of the ids that no context foresaw; the end is the escape's."""
        if self.missed:
            self.counts += np.bincount(np.concatenate(self.missed), minlength=len(self.counts))
            self.missed = []
        ids = np.flatnonzero(self.counts)
        if len(ids) > _MOST_IDS:
            ids = np.sort(ids[np.argsort(-self.counts[ids], kind="stable")[:_MOST_IDS]])
        n = self.counts[ids]
        w = n * (_ID_ONE - len(ids) - 1) // (int(n.sum()) + self.escapes) + 1
        end = np.cumsum(w)
        self.width0, self.start0 = np.zeros(len(self.counts), dtype=_U), np.zeros(len(self.counts), dtype=_U)
        self.width0[ids], self.start0[ids] = w, end - w
        self.escape = int(end[-1]) if len(end) else 0
        if self.decodes:
            self.id_at = np.full(_ID_ONE, -1, dtype=np.int64)
            self.id_at[: self.escape] = np.repeat(ids, w)

    def predict(self, m: int) -> None:
        """Sets the predictions and mixing contexts of the first m lanes."""
        if self.step >= self.next_table:
            self.order0()
            self.next_table = self.step + 1 + min(self.step // 4, 48)
        self.step += 1
        self.i2, self.i1 = self.pair[:m], self.last[:m]
        self.e2, self.e1 = self.pairs.take(self.i2), self.singles.take(self.i1)
        self.s2, self.s1 = self.e2 >> 3, self.e1 >> 3
        self.k2, self.k1 = self.e2 & 7, self.e1 & 7
        self.at = (self.k2 << 5) + (self.k1 << 2) + ((self.s1 == self.s2).view(np.int8).astype(np.int64) << 8)

    def narrow(self, ids: np.ndarray, start: np.ndarray, width: np.ndarray, gone: np.ndarray | None = None) -> np.ndarray:
        """Narrows an outcome's starts and widths to order 0's shares of ids; gives the places of those that escape (gone if known)."""
        w, c = self.width0.take(ids), self.start0.take(ids)
        gone = np.flatnonzero(w == 0) if gone is None else gone
        if len(gone):
            w[gone], c[gone] = _ID_ONE - self.escape, self.escape
            self.escapes += len(gone)
        width >>= _ID_SHIFT
        start += width * c
        width *= w
        return gone

    def learn(self, m: int, x: np.ndarray, hit2: np.ndarray, hit1: np.ndarray, outcome: np.ndarray) -> None:
        fresh = x << 3
        for known, i, e, k, hit in ((self.pairs, self.i2, self.e2, self.k2, hit2), (self.singles, self.i1, self.e1, self.k1, hit1)):
            k = k + (hit.view(np.int8).astype(np.int64) << 3)
            new = e + _CHANGE.take(k)
            replaced = np.flatnonzero(k == 0)
            new[replaced] = fresh.take(replaced)
            known[i] = new
        self.seen += np.bincount(outcome, minlength=4 * _CONTEXTS).reshape(_CONTEXTS, 4)
        if self.step < 16 or self.step % 4 == 0:
            self.mix()
        if self.step % 64 == 0:
            self.seen *= 0.5
            self.seen[:, :3] += 0.1
        self.pair[:m] = (self.last[:m] * 40503 + x * 30011 >> 3) & ((1 << _PAIR_BITS) - 1)
        self.last[:m] = x


def shape(n: int) -> tuple[int, int, int]:
    """Lanes of a block of n ids, their length, and the length of the last one."""
    steps = -(-n // min(LANES, max(1, n // LEAST_STEPS)))
    lanes = -(-n // steps)
    return lanes, steps, n - (lanes - 1) * steps


def encode_block(ids: np.ndarray) -> bytes:
    """The lanes' numbers of words and the words of a block of at least one id."""
    lanes, steps, rest = shape(len(ids))
    grid = np.zeros(lanes * steps, dtype=np.int64)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(int(ids.max()), lanes, False)
    low, span = np.zeros(lanes, dtype=_U), np.full(lanes, _FULL)
    room = 3 * steps + 4
    words = np.zeros(lanes * room, dtype="<u4")
    begin = np.arange(lanes, dtype=np.int64) * room
    at = begin.copy()

    def carry(lane: np.ndarray) -> None:
        p = at[lane] - 1
        while len(p):
            w = words[p] + np.uint32(1)
            words[p] = w
            p = p[w == 0] - 1

    def code(lane: np.ndarray, lo: np.ndarray, r: np.ndarray, start: np.ndarray, width: np.ndarray) -> None:
        """Narrows (lo, r), of which lane has the numbers, in place; r comes in units of the shares."""
        start *= r
        lo += start
        over = np.flatnonzero(lo < start)
        if len(over):
            carry(lane[over])
        r *= width
        out = np.flatnonzero(r <= _LOW)
        if len(out):
            k, left = lane[out], lo.take(out)
            p = at.take(k)
            words[p] = left >> _WORD
            at[k] = p + 1
            lo[out], r[out] = left << _WORD, r.take(out) << _WORD

    every = np.arange(lanes)
    for step in range(steps):
        m = lanes if step < rest else lanes - 1
        x = grid[step, :m]
        model.predict(m)
        hit2, hit1 = model.s2 == x, model.s1 == x
        outcome = model.at + ((~hit2).view(np.int8) << (~hit1).view(np.int8))
        start, width = model.start.take(outcome), model.width.take(outcome)
        miss = np.flatnonzero(~(hit2 | hit1))
        gone = miss[:0]
        if len(miss):
            xm, s, w = x.take(miss), start.take(miss), width.take(miss)
            gone = model.narrow(xm, s, w)
            start[miss], width[miss] = s, w
            model.missed.append(xm)
        r = span[:m] >> _SHIFT
        code(every[:m], low[:m], r, start, width)
        span[:m] = r
        if len(gone):
            lane, plain = miss.take(gone), xm.take(gone).astype(_U)
            for part in (plain >> _ID_SHIFT, plain & _U(_ID_ONE - 1)):
                lo, r = low[lane], span[lane] >> _ID_SHIFT
                code(lane, lo, r, part, np.ones(len(lane), dtype=_U))
                low[lane], span[lane] = lo, r
        model.learn(m, x, hit2, hit1, outcome)
    # one more word: a number within the span whose further words are zero
    end = low + _LOW
    carry(np.flatnonzero(end < low))
    words[at] = end >> _WORD
    size = at + 1 - begin
    return size.astype("<u4").tobytes() + words.reshape(lanes, room)[np.arange(room)[None, :] < size[:, None]].tobytes()


def decode_block(n: int, top: int, data: bytes) -> np.ndarray:
    """What encode_block was given: n ids of which the greatest is top."""
    lanes, steps, rest = shape(n)
    all_words = np.frombuffer(data, dtype="<u4", count=len(data) // 4)
    stop = np.cumsum(all_words[:lanes].astype(np.int64))
    words = np.r_[all_words[lanes:], np.zeros(1, dtype="<u4")].astype(_U)
    at = np.r_[0, stop[:-1]]
    final = len(words) - 1

    def word(lane: np.ndarray) -> np.ndarray:
        p = at[lane]
        at[lane] = p + 1
        return words[np.minimum(p, final)] * (p < stop[lane])

    def settle(lane: np.ndarray, co: np.ndarray, r: np.ndarray) -> None:
        out = np.flatnonzero(r <= _LOW)
        if len(out):
            co[out], r[out] = co.take(out) << _WORD | word(lane[out]), r.take(out) << _WORD

    def plain(lane: np.ndarray) -> np.ndarray:
        co, r = code[lane], span[lane] >> _ID_SHIFT
        v = np.minimum(co // r, _U(_ID_ONE - 1))
        co -= v * r
        settle(lane, co, r)
        code[lane], span[lane] = co, r
        return v

    every = np.arange(lanes)
    code = word(every) << _WORD
    code |= word(every)
    span = np.full(lanes, _FULL)
    model = Model(top, lanes, True)
    grid = np.zeros((steps, lanes), dtype="<u4")
    most = (_U(1) << _SHIFT) - _U(1)
    for step in range(steps):
        m = lanes if step < rest else lanes - 1
        model.predict(m)
        r = span[:m] >> _SHIFT
        v = np.minimum(code[:m] // r, most).view(np.int64)
        flag, context = v >> _ID_BITS, model.at >> 2
        not2, neither = flag >= model.edge1.take(context), flag >= model.edge2.take(context)
        outcome = model.at + not2.view(np.int8) + neither.view(np.int8)
        start, width = model.start.take(outcome), model.width.take(outcome)
        x = model.s2 + (model.s1 - model.s2) * not2
        miss = np.flatnonzero(neither)
        gone = miss[:0]
        if len(miss):
            s, w = start.take(miss), width.take(miss)
            slot = (v.take(miss) - s.view(np.int64)).astype(np.int32) // (w >> _ID_SHIFT).astype(np.int32)
            xm = model.id_at.take(np.minimum(slot, _ID_ONE - 1).astype(np.int64))
            gone = np.flatnonzero(xm < 0)
            xm[gone] = 0
            model.narrow(xm, s, w, gone)
            start[miss], width[miss] = s, w
        co = code[:m] - r * start
        r *= width
        settle(every[:m], co, r)
        code[:m], span[:m] = co, r
        if len(miss):
            if len(gone):
                lane = miss.take(gone)
                xm[gone] = np.minimum(plain(lane) << _ID_SHIFT | plain(lane), _U(top)).astype(np.int64)
            x[miss] = xm
            model.missed.append(xm)
        grid[step, :m] = x
        model.learn(m, x, ~not2, model.s1 == x, outcome)
    return np.ascontiguousarray(grid.T).reshape(-1)[:n]


class Packer:
    """Gathers a file's documents and codes each block as soon as it is full."""

    def __init__(self):
        self.docs, self.heads, self.coded, self.held, self.n_held, self.n_ids = [], [], [], [], 0, 0

    def add(self, doc_id: int | None, n: int, ids: bytes) -> None:
        """A document of n ids, of which ids are the bytes."""
        self.docs.append((doc_id, n))
        self.held.append(ids)
        self.n_held += n
        self.n_ids += n
        if self.n_held >= BLOCK:
            self._code(BLOCK)

    def _code(self, least: int) -> None:
        a = np.frombuffer(b"".join(self.held), dtype="<u4")
        k = 0
        while len(a) - k >= max(1, least):
            b = a[k : k + BLOCK]
            if int(b.max()) > MAX_ID:
                raise ValueError(f"ids over {MAX_ID} can't be coded")
            coded = encode_block(b)
            self.heads.append(struct.pack("<IIII", len(b), int(b.max()), zlib.crc32(b.tobytes()), len(coded)))
            self.coded.append(coded)
            k += len(b)
        self.held, self.n_held = [a[k:].tobytes()], len(a) - k

    def close(self) -> bytes:
        self._code(0)
        index = b"".join(struct.pack("<q?I", d or 0, d is None, n) for d, n in self.docs)
        return MAGIC + struct.pack("<II", len(self.heads), len(self.docs)) + b"".join(self.heads) + index + b"".join(self.coded)


def pack_file(docs: list[tuple[int | None, int]], ids: bytes) -> bytes:
    """A file of documents (doc_id, number of ids) and all their ids."""
    p, at = Packer(), 0
    for d, n in docs:
        p.add(d, n, ids[4 * at : 4 * (at + n)])
        at += n
    return p.close()


def unpack_blocks(raw: bytes) -> tuple[list[tuple[int | None, int]], Iterator[bytes]]:
    """The documents (doc_id, number of ids) of a file, and the bytes of its ids block by block; these raise where a block fails its checksum."""
    if raw[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of token ids")
    n_blocks, n_docs = struct.unpack_from("<II", raw, len(MAGIC))
    first = len(MAGIC) + 8
    index = first + 16 * n_blocks
    body = index + 13 * n_docs
    heads = list(struct.iter_unpack("<IIII", raw[first:index]))
    docs = [(None if null else d, n) for d, null, n in struct.iter_unpack("<q?I", raw[index:body])]

    def blocks() -> Iterator[bytes]:
        at = body
        for n, top, crc, size in heads:
            ids = decode_block(n, top, raw[at : at + size]).tobytes()
            if zlib.crc32(ids) != crc:
                raise ValueError("a block of token ids fails its checksum")
            yield ids
            at += size

    return docs, blocks()


def unpack_file(raw: bytes) -> tuple[list[tuple[int | None, int]], bytes]:
    """What pack_file was given."""
    docs, blocks = unpack_blocks(raw)
    return docs, b"".join(blocks)


def documents(raw: bytes) -> Iterator[tuple[int | None, int, bytes]]:
    """doc_id, number of ids and their bytes of each document of a file, with no more than a block (or a document) decoded at once."""
    docs, blocks = unpack_blocks(raw)
    held = b""
    at = 0
    for d, n in docs:
        parts = []
        need = 4 * n
        while need > len(held) - at:
            parts.append(held[at:])
            need -= len(held) - at
            held, at = next(blocks), 0
        parts.append(held[at : at + need])
        at += need
        yield d, n, b"".join(parts)


def _put(folder: str, name: str, data: bytes) -> str:
    """Writes under a temporary name and renames; a second attempt leaves equal bytes."""
    fs, path = store(folder)
    fs.create_dir(path, recursive=True)
    tmp = f"{path}/.{name}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp) as f:
        f.write(data)
    fs.move(tmp, f"{path}/{name}")
    return f"{folder}/{name}"


FILES = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])


#: The list of a folder's files, written last.
MANIFEST = "manifest.json"


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> str:
    """Writes the ids of all documents, ascending by doc_id, and gives the manifest's address."""
    spark = docs.sparkSession
    path, end = tokenizer or default_path(), np.array([end_id], dtype="<u4").tobytes()
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    number, n_parts = ranges(d, parts or int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("text"))
    d = d.withColumn("part", number).repartitionById(n_parts, F.col("part")).sortWithinPartitions("part", "doc_id", "text")

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, seq, file = None, 0, Packer()

        def flush() -> tuple:
            data = file.close()
            name = f"part-{part:06d}-{seq:04d}.ids"
            _put(folder, name, data)
            return part, seq, name, len(file.docs), file.n_ids, len(data)

        for b in in_slices(batches_in):
            for p, i, ids in zip(column(b, "part").to_pylist(), column(b, "doc_id").to_pylist(), encoder(path).packed_many(column(b, "text").to_pylist())):
                n = len(ids) // 4 + 1
                if file.docs and (p != part or file.n_ids + n > FILE_IDS):
                    yield flush()
                    seq, file = (seq + 1 if p == part else 0), Packer()
                part = p
                file.add(i, n, ids + end)
        if file.docs:
            yield flush()

    rows = d.mapInArrow(lambda it: batches(run(it), FILES), "part int, seq int, file string, n_docs long, n_ids long, n_bytes long").collect()
    files = sorted((r.asDict() for r in rows), key=lambda r: (r["part"], r["seq"]))
    return _put(folder, MANIFEST, json.dumps({"end_id": end_id, "files": files}, indent=1).encode())


RESULT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read(spark, manifest: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids' bytes) of each document in the files that the manifest lists."""
    schema = RESULT.append(pa.field("ids", pa.binary())) if with_ids else RESULT
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    fs, path = store(manifest)
    with fs.open_input_stream(path) as f:
        files = json.loads(f.read())["files"]
    if not files:
        return spark.createDataFrame([], ddl)
    base, rows, folder = 0, [], manifest.rpartition("/")[0]
    for k, f in enumerate(files):
        rows.append((k, f"{folder}/{f['file']}", base))
        base += f["n_ids"]

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches_in:
            for name, at in zip(column(b, "file").to_pylist(), column(b, "base").to_pylist()):
                fs, path = store(name)
                with fs.open_input_stream(path) as f:
                    raw = f.read()
                for i, n, ids in documents(raw):
                    yield (i, at, n, zlib.crc32(ids)) + ((ids,) if with_ids else ())
                    at += n

    listed = spark.createDataFrame(rows, "k int, file string, base long").repartitionById(len(rows), F.col("k"))
    return listed.mapInArrow(lambda it: batches(run(it), schema), ddl)


def round_trip(docs: DataFrame, folder: str | None = None, **named) -> DataFrame:
    """Writes docs to folder (a new one in the shared folder if None) and reads them back."""
    spark = docs.sparkSession
    return read(spark, write(docs, folder or fresh_dir(spark, "ids"), **named))
