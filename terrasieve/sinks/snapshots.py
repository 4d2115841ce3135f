"""Result tables that survive a crash between writes, and tables built once for given inputs.

A table is a folder of data folders and a list of commits. A commit is a small file with a number
that names the data folders (and the job partitions in them) that make up the table; readers take
the newest commit. New rows are written to a folder of their own first and count from the moment
their commit has its name, which happens in one step and never replaces a file. So a writer that is
killed leaves the table as it was, and of two writers at a time one fails and loses nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.report import keep_last

COMMITS, DATA = "_commits", "data"


class Conflict(RuntimeError):
    """Another writer has committed since the table was read."""


class _Files:
    """The few calls on files that are needed, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def matches(self, pattern: str) -> list[str]:
        return [str(s.getPath().toString()) for s in self.fs.globStatus(self.path(pattern)) or []]

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.path(name), False)
        out.write(bytearray(text.encode()))
        out.close()

    def rename(self, old: str, new: str) -> bool:
        """False if there is a file of the new name."""
        return not self.fs.exists(self.path(new)) and bool(self.fs.rename(self.path(old), self.path(new)))

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _newest(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    names = [n for n in _Files(spark, path).names(f"{path}/{COMMITS}") if n.endswith(".json") and n[0].isdigit()]
    if not names:
        return 0, None
    text = "\n".join(r.value for r in spark.read.text(f"{path}/{COMMITS}/{names[-1]}", wholetext=True).collect())  # one small file
    return int(names[-1].split(".")[0]), json.loads(text)


def _commit(spark: SparkSession, path: str, number: int, content: dict) -> None:
    files = _Files(spark, path)
    draft = f"{path}/{COMMITS}/_draft-{uuid.uuid4().hex}"
    files.write(draft, json.dumps(content, sort_keys=True))
    if not files.rename(draft, f"{path}/{COMMITS}/{number:012d}.json"):
        files.remove(draft)
        raise Conflict(f"commit {number} of {path} is there already")


def _write(rows: DataFrame, path: str, job: list[str]) -> dict:
    """Writes a data folder; its entry for a commit."""
    folder = f"{DATA}-{uuid.uuid4().hex}"
    writer = rows.write.option("compression", "zstd")
    if not job:
        writer.parquet(f"{path}/{folder}")
        return {"folder": folder, "parts": None}
    rows.repartition(*job).write.option("compression", "zstd").partitionBy(*job).parquet(f"{path}/{folder}")
    found = _Files(rows.sparkSession, path).matches(f"{path}/{folder}" + "/*=*" * len(job))
    return {"folder": folder, "parts": sorted("/".join(f.split("/")[-len(job) :]) for f in found)}


def _frame(spark: SparkSession, path: str, content: dict) -> DataFrame:
    schema = StructType.fromJson(content["schema"])
    out = spark.createDataFrame([], schema)
    for e in content["entries"]:
        where = f"{path}/{e['folder']}"
        reader = spark.read.schema(schema).option("basePath", where)
        parts = [where] if e["parts"] is None else [f"{where}/{p}" for p in e["parts"]]
        if parts:
            out = out.unionByName(reader.parquet(*parts).select(*schema.names))
    return out


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as of its newest commit, or None if it has none."""
    _, content = _newest(spark, path)
    return None if content is None else _frame(spark, path, content)


def _publish(rows: DataFrame, path: str, number: int, old: dict | None, entries: list[dict]) -> None:
    schema = json.loads(rows.schema.json()) if old is None else old["schema"]
    _commit(rows.sparkSession, path, number + 1, {"schema": schema, "entries": entries})


def _like(rows: DataFrame, old: dict | None) -> DataFrame:
    """Rows with the columns of the table, in its order."""
    return rows if old is None else rows.select(*StructType.fromJson(old["schema"]).names)


def replace(rows: DataFrame, path: str) -> None:
    """Makes ``rows`` the table. They may come from the table itself."""
    number, _ = _newest(rows.sparkSession, path)
    _publish(rows, path, number, None, [_write(rows, path, [])])


def append_new(rows: DataFrame, path: str, keys: list[str], order: list[str]) -> int:
    """Appends the rows whose keys the table does not have (null keys match): of rows that share
    keys the last by ``order``. How many there were; a second run adds none."""
    spark = rows.sparkSession
    number, old = _newest(spark, path)
    rows = _like(rows, old)
    own = keep_last(rows, keys, order).select(*rows.columns)
    if old is not None:
        have = _frame(spark, path, old).select(*[F.col(k).alias(f"__{k}") for k in keys])
        own = own.join(have, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left_anti")
    entry = _write(own, path, [])
    n = spark.read.schema(own.schema).parquet(f"{path}/{entry['folder']}").count()
    if n or old is None:
        _publish(own, path, number, old, [*(old["entries"] if old else []), entry])
    else:
        _Files(spark, path).remove(f"{path}/{entry['folder']}")
    return n


def replace_jobs(rows: DataFrame, path: str, job: list[str]) -> None:
    """Writes the rows of whole jobs: those of other jobs stay, those of these jobs are replaced.
    After each job of a long run the table is complete up to there."""
    number, old = _newest(rows.sparkSession, path)
    entry = _write(_like(rows, old), path, job)
    new = set(entry["parts"])
    kept = [{**e, "parts": [p for p in e["parts"] or [] if p not in new]} for e in (old["entries"] if old else [])]
    if old and any(e["parts"] is None for e in old["entries"]):
        raise ValueError("the table is not written by jobs")
    _publish(rows, path, number, old, [*[e for e in kept if e["parts"]], entry])


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes data folders and drafts that the newest commit doesn't name, and older commits; how
    many folders went. Only when nobody reads or writes the table."""
    number, content = _newest(spark, path)
    files = _Files(spark, path)
    live = {e["folder"] for e in content["entries"]} if content else set()
    gone = [n for n in files.names(path) if n.startswith(f"{DATA}-") and n not in live]
    for n in gone:
        files.remove(f"{path}/{n}")
    for n in files.names(f"{path}/{COMMITS}"):
        if n != f"{number:012d}.json":
            files.remove(f"{path}/{COMMITS}/{n}")
    return len(gone)


def input_key(spark: SparkSession, inputs: list[str], settings: dict) -> str:
    """A digest of settings and of the names, lengths and times of all files of the inputs: it
    changes when any of them does."""
    seen = []
    for name in sorted(inputs):
        files = _Files(spark, name)
        found = files.fs.listFiles(files.path(name), True)
        while found.hasNext():
            s = found.next()
            seen.append((str(s.getPath().toString()), s.getLen(), s.getModificationTime()))
    return hashlib.sha256(json.dumps([sorted(seen), settings], sort_keys=True).encode()).hexdigest()


def read_or_build(spark: SparkSession, path: str, inputs: list[str], settings: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` makes of input files and settings, built once: it is read again as
    long as neither changes, and built anew when one does. A build counts only when it is whole."""
    key = input_key(spark, inputs, settings)
    files, done = _Files(spark, path), f"{path}/{key}"
    if not files.fs.exists(files.path(f"{done}/_SUCCESS")):
        draft = f"{path}/_draft-{uuid.uuid4().hex}"
        build().write.parquet(draft)
        if not files.rename(draft, done):  # another build of the same key was first
            files.remove(draft)
    return spark.read.parquet(done)
