"""Documents packed into chunks of bytes, and tables in the shared folder, bucketed by chunk, so
that what is found for a chunk can be joined with its contents again without moving them."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import remove_path, scratch_path

SCHEMA = "chunk long, ids array<long>, sizes array<int>, digests array<binary>, blob binary"
#: Bytes of text that one bucket should hold, and the most buckets that Spark should have to keep.
BUCKET_BYTES = 48_000_000
MOST_BUCKETS = 50_000
#: What drops the tables of this process that are still there.
_kept: list[Callable[[], None]] = []


def packed(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[tuple[int, list, list[bytes]]]:
    """Chunks of a task's documents (``doc_id, text``): number, ids and texts in UTF-8. A chunk
    has ``chunk_bytes`` at most, unless one document is longer."""
    number, ids, parts, size = TaskContext.get().partitionId() << 32, [], [], 0
    for b in batches:
        for i, t in zip(b.column(0), b.column(1), strict=True):
            raw = t.as_buffer().to_pybytes()
            if parts and size + len(raw) > chunk_bytes:
                yield number, ids, parts
                number, ids, parts, size = number + 1, [], [], 0
            ids.append(i.as_py())
            parts.append(raw)
            size += len(raw)
    if parts:
        yield number, ids, parts


def write_table(df: DataFrame, total_bytes: int, key: str = "chunk") -> tuple[DataFrame, Callable[[], None]]:
    """``df (chunk, ...)`` as a table bucketed by chunk, and what drops it with its files."""
    spark = df.sparkSession
    name, path = f"terrasieve_chunks_{uuid.uuid4().hex}", scratch_path(spark, "chunks")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // BUCKET_BYTES))
    writer = df.write.bucketBy(min(buckets, MOST_BUCKETS), key).sortBy(key)
    writer.option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_path(spark, path)
        _kept.remove(drop)

    _kept.append(drop)
    return spark.table(name), drop


def drop_tables() -> None:
    """Drops the chunk tables of this process with their files: call it when results that were
    read from them (``repeats.remove_repeats``) have been written."""
    for drop in list(_kept):
        drop()


def chunk_table(docs: DataFrame, total_bytes: int, chunk_bytes: int) -> tuple[DataFrame, Callable[[], None]]:
    """``docs (doc_id, text)`` as chunks of whole documents: ids, byte sizes, SHA-256 digests,
    and all bytes in a row; and what drops the table."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, parts in packed(batches, chunk_bytes):
            columns = [
                pa.array([number]),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(p) for p in parts]], pa.list_(pa.int32())),
                pa.array([[hashlib.sha256(p).digest() for p in parts]], pa.list_(pa.binary())),
                pa.array([b"".join(parts)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "sizes", "digests", "blob"])

    return write_table(docs.mapInArrow(pack, SCHEMA), total_bytes)


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]
