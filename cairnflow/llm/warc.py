"""A deterministic sharded WARC writer and its reader.

Pages are put into ranges of page_id and sorted; each range is written to gzip files (a member a record) that roll over at a
compressed size.  Headers and digests are made anew from the payload, record ids from page and digest, and the date is a
parameter, so that any attempt at a range gives the same bytes.  A file is written under a temporary name and renamed; the
manifest, itself renamed into place last, lists the files with sizes and digests, and readers read what it lists alone.

Of records with equal payloads of at least ``min_dedup`` bytes the one with the smallest page_id is a response, the others are
revisits without payload.

Scale: the digests alone are grouped; pages move once, to their range, and the table of revisits (pages with an earlier equal
payload) is joined by key, broadcast only if its written size is under Spark's threshold.  A writer holds one file's bytes.

Defined results: null html is an empty payload.  Rows of equal page_id (or null) are records of their own, in the order of their payload's
digest, or where they fill several ranges by range and then by digest; those with the smallest page_id of a payload are all responses.  A null page_id comes first, is never referred to and is
a response.  An empty table gives an empty manifest and result.  Other columns are ignored; a missing url is an empty target.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, column, fresh_dir, materialise, store
from .ordermin import ranges

DATE = "2024-01-01T00:00:00Z"
ROLL_BYTES, MIN_DEDUP, LEVEL, WINDOW = 64 << 20, 100, 4, 16 << 10
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space for URLs
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    digest = hashlib.sha256(payload).hexdigest()
    revisit = refers_to is not None
    http = _HTTP % len(payload)
    block = http if revisit else http + payload
    target = "".join(c for c in url or "" if c > " ")
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{record_id(page_id, digest)}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Payload-Length", str(len(payload))),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{record_id(refers_to, digest)}>"), ("X-Refers-To-Page-ID", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None, digest: str) -> str:
    return str(uuid.uuid5(_SPACE, f"{page_id}:{digest}"))


def member(data: bytes, level: int = LEVEL) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each gzip member; block digests are checked."""
    view, at = memoryview(raw), 0
    while at < len(view):
        d, data = zlib.decompressobj(31), []
        while not d.eof and at < len(view):
            piece = view[at : at + WINDOW]
            data.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)  # zlib copies what follows a member, at most a window of it
        if not d.eof:
            raise ValueError("a record is cut short")
        head, _, rest = b"".join(data).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC/1.1 record")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        block = rest[: int(fields["Content-Length"])]
        if "sha256:" + hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"]:
            raise ValueError("a record's block fails its digest")
        yield fields, block


FILES = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())])


def write(pages: DataFrame, folder: str, date: str = DATE, roll_bytes: int = ROLL_BYTES, min_dedup: int = MIN_DEDUP, page_id: str = "page_id", url: str = "url", html: str = "html", parts: int | None = None) -> str:
    """Writes all pages and gives the manifest's address."""
    spark = pages.sparkSession
    link = F.col(url) if url in pages.columns else F.lit(None).cast("string")
    d = pages.select(F.col(page_id).cast("long").alias("doc_id"), link.alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    digest = F.unhex(F.sha2(F.encode("html", "utf-8"), 256))
    keys = d.where((F.octet_length("html") >= min_dedup) & F.col("doc_id").isNotNull()).select("doc_id", digest.alias("digest"))
    # those payloads that occur again, and the pages that repeat one
    first = keys.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first != last").drop("last")
    repeats = keys.join(first, "digest").where("doc_id != first").select("doc_id", "digest", F.col("first").alias("refers_to")).distinct()
    repeats = materialise(repeats, "repeats").withColumnRenamed("digest", "same")
    number, n_parts = ranges(d, parts or int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("digest"))
    d = _with_repeats(d.withColumn("digest", digest), repeats)
    d = d.withColumn("part", number).repartitionById(n_parts, F.col("part")).sortWithinPartitions("part", "doc_id", "digest").select("part", "doc_id", "url", "html", "refers_to")

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, seq, held, size = None, 0, [], 0

        def flush() -> tuple:
            data = b"".join(held)
            name = f"part-{part:06d}-{seq:04d}.warc.gz"
            put(folder, name, data)
            return part, seq, f"{folder}/{name}", len(held), len(data), hashlib.sha256(data).hexdigest()

        for b in batches_in:
            for p, i, u, h, r in zip(*(column(b, c).to_pylist() for c in ("part", "doc_id", "url", "html", "refers_to"))):
                if held and (p != part or size >= roll_bytes):
                    yield flush()
                    seq, held, size = (seq + 1 if p == part else 0), [], 0
                part = p
                held.append(member(record(i, u, h.encode("utf-8", "surrogatepass"), r, date)))
                size += len(held[-1])
        if held:
            yield flush()

    found = d.mapInArrow(lambda it: batches(run(it), FILES), "part int, seq int, file string, n_records long, n_bytes long, sha256 string").collect()
    files = sorted((r.asDict() for r in found), key=lambda r: (r["part"], r["seq"]))
    put(folder, "manifest.json", json.dumps({"date": date, "files": files}, indent=1).encode())
    return f"{folder}/manifest.json"


def _with_repeats(d: DataFrame, repeats: DataFrame) -> DataFrame:
    """d with refers_to where its (doc_id, digest) repeats an earlier payload."""
    r = repeats.select(F.col("doc_id").alias("_id"), "same", "refers_to")
    return d.join(r, (F.col("doc_id") == F.col("_id")) & (F.col("digest") == F.col("same")), "left").drop("_id", "same")


def put(folder: str, name: str, data: bytes) -> None:
    """Writes under a temporary name and renames."""
    fs, path = store(folder)
    fs.create_dir(path, recursive=True)
    tmp = f"{path}/.{name}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp, compression=None) as f:
        f.write(data)
    fs.move(tmp, f"{path}/{name}")


RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read(spark, manifest: str, with_payload: bool = False) -> DataFrame:
    """A row for each record of the files that the manifest lists; a response's payload is checked against its digest."""
    schema = RESULT.append(pa.field("payload", pa.binary())) if with_payload else RESULT
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    fs, path = store(manifest)
    with fs.open_input_stream(path) as f:
        files = json.loads(f.read())["files"]
    if not files:
        return spark.createDataFrame([], ddl)

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches_in:
            for name in column(b, "file").to_pylist():
                fs, path = store(name)
                with fs.open_input_stream(path, compression=None) as f:
                    raw = f.read()
                for fields, block in records(raw):
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError("a payload fails its digest")
                    page, ref = fields["X-Page-ID"], fields.get("X-Refers-To-Page-ID")
                    yield (int(page) if page else None, fields["WARC-Target-URI"], int(fields["X-Payload-Length"]), digest, kind, int(ref) if ref else None) + ((payload,) if with_payload else ())

    listed = spark.createDataFrame([(k, r["file"]) for k, r in enumerate(files)], "k int, file string").repartitionById(len(files), F.col("k"))
    return listed.mapInArrow(lambda it: batches(run(it), schema), ddl)


def round_trip(pages: DataFrame, folder: str | None = None, **named) -> DataFrame:
    spark = pages.sparkSession
    return read(spark, write(pages, folder or fresh_dir(spark, "warc"), **named))
