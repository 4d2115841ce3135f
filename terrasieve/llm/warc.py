"""WARC archives with a two-level capture index.

``write`` makes one record per page: a response with the whole payload, or, for a payload of
``LEAST_REVISIT`` bytes or more that a page with a larger ``page_id`` has too, a revisit that
refers to that page's response. Every record is a gzip member of its own, as the format advises:
pages are compressed before the one shuffle they take, and what is read back is one member. A
task writes its archives under new names and returns these; only the names that Spark commits
are read on, so a task that is run again leaves nothing behind that counts.

``build_index`` reads the archives in order and makes a line per capture: reversed-host URL key,
file, offset, length. Lines are range-partitioned and sorted by key and packed into compressed
blocks of ``BLOCK_LINES``; the directory has one line per block, with its first and last key.

``lookup`` finds captures by URL. The directory is cut into segments of ``SEGMENT_BLOCKS``
blocks, whose first keys (one for each two million captures) are all that the driver holds; a
binary search sends every key to its segments, one in the segment to its blocks, one in the
block to its lines. Then the records are read, each by its range of bytes only, with pyarrow's
file systems, from the folder that driver and executors share.

Null html is an empty payload, null url is kept as an empty one. Null ``page_id`` is kept and is
always a response. Rows that tie for the largest ``page_id`` of a payload are all responses; of
equal captures every one is indexed. An empty table gives an empty result. Columns besides
``page_id``, ``url`` and ``html`` are ignored. Payloads of any length are written whole.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch_path

LEAST_REVISIT = 1000
BLOCK_LINES = 512
SEGMENT_BLOCKS = 4096
FILE_RECORDS = 100_000
SCAN_BYTES = 1 << 16
#: Records that a task reads back.
READ_ROWS = 4096
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def surt(url: str | None) -> str:
    """Key of a URL: host labels from the last to the first, then path and query."""
    url = (url or "").split("#", 1)[0]
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower().removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return url
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _uri(url):
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "%20")


def revisits(pages: DataFrame) -> DataFrame:
    """``page_id, payload_digest, refers_to`` of the pages whose payload another page answers."""
    payload = F.coalesce("html", F.lit(""))
    own = pages.where(F.octet_length("html") >= LEAST_REVISIT).select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload.cast("binary")).alias("payload_digest")).where("page_id is not null")
    groups = own.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return own.join(groups, "payload_digest").where("page_id < refers_to").distinct()


def _record(page: int | None, uri: str, digest: str, size: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """One record as a gzip member; without a payload a revisit."""
    http = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: {size}{END}{END}".encode()
    block = http + (payload or b"")
    kind = [("WARC-Type", "response")] if payload is not None else [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("Refers-To-Page", refers_to)]
    name = uuid.UUID(hashlib.md5(f"{page}|{uri}|{digest}".encode()).hexdigest())
    fields = [*kind, ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-ID", "-" if page is None else page), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    head = "WARC/1.1" + END + "".join(f"{k}: {v}{END}" for k, v in fields) + END
    return gzip.compress(head.encode() + block + (END + END).encode(), 6, mtime=0)


def write(pages: DataFrame, path: str) -> DataFrame:
    """Writes the archives below ``path``; ``file, records`` of each."""

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 200):
                out = []
                for page, uri, html in zip(*(c.to_pylist() for c in b.slice(k, 200).columns), strict=True):
                    raw = (html or "").encode()
                    digest = hashlib.sha1(raw).hexdigest()
                    out.append((page, uri, digest, len(raw), _record(page, uri, digest, len(raw), raw, None)))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "uri", "payload_digest", "size", "member"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f, n = "", None, 0
        told = lambda: pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])
        for b in batches:
            for k in range(0, b.num_rows, 200):
                for page, uri, digest, size, member, refers_to in zip(*(c.to_pylist() for c in b.slice(k, 200).columns), strict=True):
                    if f is None:
                        system, root = _file_system(path)
                        system.create_dir(root, recursive=True)
                        name, n = f"{path}/{uuid.uuid4().hex}.warc.gz", 0
                        f = system.open_output_stream(_file_system(name)[1], compression=None)
                    f.write(member if refers_to is None else _record(page, uri, digest, size, None, refers_to))
                    n += 1
                    if n == FILE_RECORDS:
                        f.close()
                        f = None
                        yield told()
        if f is not None:
            f.close()
            yield told()

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), _uri(F.col("url")).alias("uri"), "html")
    packed = own.mapInArrow(compress, "page_id long, uri string, payload_digest string, size long, member binary")
    joined = packed.join(revisits(pages), ["page_id", "payload_digest"], "left").select("page_id", "uri", "payload_digest", "size", "member", "refers_to")
    return materialise(joined.mapInArrow(store, "file string, records long"), "archives")


def _file_system(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _open(path: str):
    system, name = _file_system(path)
    return system.open_input_file(name)


def parse(raw: bytes) -> dict[str, str]:
    """Fields of a record's header, by lower-case name."""
    lines = raw.decode().split(END)
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:] if x)}


def scan(path: str) -> Iterator[tuple[int, int, dict[str, str]]]:
    """Offset, length and header of each record of an archive, in order."""
    with _open(path) as f:
        at, data = 0, f.read(SCAN_BYTES)
        while data:
            member, head, length = zlib.decompressobj(31), b"", 0
            while not member.eof:
                if not data and not (data := f.read(SCAN_BYTES)):
                    raise ValueError(f"{path} breaks off at {at}")
                out = member.decompress(data)
                length += len(data) - len(member.unused_data)
                data = member.unused_data
                if b"\r\n\r\n" not in head:
                    head += out
            yield at, length, parse(head.partition(b"\r\n\r\n")[0])
            at += length
            data = data or f.read(SCAN_BYTES)


def captures(files: DataFrame) -> DataFrame:
    """``key, file, offset, length`` of every record of the archives in column ``file``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["file"]:
                rows = []
                for at, length, fields in scan(p):
                    rows.append((surt(fields["warc-target-uri"]), p, at, length))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=["key", "file", "offset", "length"])
                        rows = []
                yield pd.DataFrame(rows, columns=["key", "file", "offset", "length"]).astype({"key": str, "file": str, "offset": "int64", "length": "int64"})

    # A row stands for an archive, so each gets a task of its own.
    return files.select("file").repartition(max(1, files.count()), "file").mapInPandas(run, "key string, file string, offset long, length long")


@dataclass(frozen=True)
class Index:
    blocks: str
    directory: str


def build_index(spark: SparkSession, files: DataFrame, to: str, block_lines: int = BLOCK_LINES) -> Index:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, count, held = TaskContext.get().partitionId(), 0, []

        def out(rows: list) -> pd.DataFrame:
            lines = "\n".join("\t".join(map(str, r)) for r in rows)
            return pd.DataFrame({"block": [(part << 32) + count], "first": [rows[0][0]], "last": [rows[-1][0]], "lines": [zlib.compress(lines.encode(), 6)]})

        for b in batches:
            held += b.itertuples(index=False, name=None)
            while len(held) >= block_lines:
                yield out(held[:block_lines])
                held, count = held[block_lines:], count + 1
        if held:
            yield out(held)

    found = materialise(captures(files), "captures")
    order = ["key", "file", "offset"]
    ordered = found.repartitionByRange(*order).sortWithinPartitions(*order)
    made = Index(f"{to}/blocks", f"{to}/directory")
    ordered.mapInPandas(pack, "block long, first string, last string, lines binary").write.parquet(made.blocks)
    spark.read.parquet(made.blocks).select("block", "first", "last").write.parquet(made.directory)
    return made


def lookup(spark: SparkSession, index: Index, urls: DataFrame, segment_blocks: int = SEGMENT_BLOCKS) -> DataFrame:
    """``key, file, offset, length`` of the captures of the URLs in column ``url``."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": [surt(u) for u in b["url"]]}, dtype=object)

    wanted = urls.select("url").distinct().mapInPandas(keys, "key string").distinct()
    directory = spark.read.parquet(index.directory)
    # Blocks are numbered in key order, so a segment is a run of blocks of one partition.
    directory = directory.withColumn("segment", F.floor(F.col("block") / segment_blocks).cast("long"))
    tops = sorted((r.first, r.last, r.segment) for r in directory.groupBy("segment").agg(F.min("first").alias("first"), F.max("last").alias("last")).collect())
    firsts, lasts = [t[0] for t in tops], [t[1] for t in tops]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k in b["key"]:
                rows += [(k, tops[i][2]) for i in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))]
            yield pd.DataFrame(rows, columns=["key", "segment"]).astype({"key": str, "segment": "int64"})

    def find(wanted: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values(["first", "last", "block"])
        first, last, number = blocks["first"].tolist(), blocks["last"].tolist(), blocks["block"].tolist()
        rows = [(number[i], k) for k in wanted["key"] for i in range(bisect.bisect_left(last, k), bisect.bisect_right(first, k))]
        return pd.DataFrame(rows, columns=["block", "key"]).astype({"block": "int64", "key": str})

    routed = wanted.mapInPandas(route, "key string, segment long")
    hit = routed.groupBy("segment").cogroup(directory.groupBy("segment")).applyInPandas(find, "block long, key string")
    # A block has few keys, so its list of wanted keys is no longer than the block.
    hit = hit.groupBy("block").agg(F.collect_list("key").alias("keys"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for packed, keys in zip(b["lines"], b["keys"], strict=True):
                lines = [x.split("\t") for x in zlib.decompress(packed).decode().split("\n")]
                own = [x[0] for x in lines]
                for k in keys:
                    rows += [(k, x[1], int(x[2]), int(x[3])) for x in lines[bisect.bisect_left(own, k) : bisect.bisect_right(own, k)]]
            yield pd.DataFrame(rows, columns=["key", "file", "offset", "length"]).astype({"key": str, "file": str, "offset": "int64", "length": "int64"})

    return spark.read.parquet(index.blocks).join(hit, "block").select("lines", "keys").mapInPandas(search, "key string, file string, offset long, length long")


def read(found: DataFrame) -> DataFrame:
    """The records at the ranges that ``lookup`` returns: ``page_id, url, record_type,
    payload_bytes, payload_digest, refers_to, payload`` (null for revisits)."""

    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for b in batches:
            for k in range(0, b.num_rows, 500):
                rows = []
                for p, at, n in sorted(zip(*(c.to_pylist() for c in b.slice(k, 500).columns), strict=True)):
                    if p != name:
                        if f is not None:
                            f.close()
                        name, f = p, _open(p)
                    head, _, block = zlib.decompress(f.read_at(n, at), 31).partition(b"\r\n\r\n")
                    w = parse(head)
                    block = block[: int(w["content-length"])]
                    http, _, payload = block.partition(b"\r\n\r\n")
                    fresh = w["warc-type"] == "response"
                    size = len(payload) if fresh else int(parse(http)["content-length"])
                    digest = hashlib.sha1(payload).hexdigest() if fresh else w["warc-payload-digest"].removeprefix("sha1:")
                    page = None if w["page-id"] == "-" else int(w["page-id"])
                    rows.append((page, w["warc-target-uri"], w["warc-type"], size, digest, None if fresh else int(w["refers-to-page"]), payload if fresh else None))
                # Arrow keeps ids beside nulls as integers.
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    # Neighbours in an archive are read by one task, a range of offsets each.
    found = materialise(found, "found")
    placed = found.repartitionByRange(max(1, -(-found.count() // READ_ROWS)), "file", "offset").sortWithinPartitions("file", "offset")
    return placed.select("file", "offset", "length").mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives and their index, looks up every URL and reads the records back."""
    spark = pages.sparkSession
    to = scratch_path(spark, "warc")
    index = build_index(spark, write(pages, f"{to}/archives"), f"{to}/index")
    urls = pages.select(_uri(F.col("url")).alias("url"))
    return read(lookup(spark, index, urls)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
