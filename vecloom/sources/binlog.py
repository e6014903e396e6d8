"""Binary change logs and snapshots: readers and writers.

Log: entries of a 4-byte big-endian length and compact JSON
{"op", "vid", "ver", "vec"?, "meta"?}.  Snapshot: magic, then version,
dimension and count as 4-byte big-endian numbers, then per row the id's length
and bytes, the float32 values, the metadata's length and JSON.

Files are read through Spark's binaryFile source, one row a file, and parsed
in ``mapInArrow``.  Damaged ends are skipped as the formats ask: a log ends at
a cut entry, a snapshot keeps the rows before the cut.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats.
SNAPSHOT_MAGIC = b"VGSN"
LONGEST_ENTRY, LONGEST_ID, MOST_DIMS = 100_000_000, 10_000, 100_000
LOG_NAME, SNAPSHOT_NAME = "partition_{:04d}.wal", "snapshot_{:04d}_v{}.bin"

LOG_SCHEMA = "partition_id int, version long, op string, vector_id string, embedding array<float>, metadata string"
SNAPSHOT_SCHEMA = "partition_id int, snapshot_version long, dim int, vector_id string, embedding array<float>, metadata string"


def pack_entry(op: str, vector_id: str, version: int, embedding=None, metadata: str | None = None) -> bytes:
    body: dict = {"op": op, "vid": vector_id, "ver": version}
    if op == "insert":
        body["vec"] = [float(x) for x in embedding]
        if metadata and metadata != "{}":
            body["meta"] = json.loads(metadata)
    line = json.dumps(body, separators=(",", ":")).encode()
    return struct.pack("!I", len(line)) + line


def entries(data: bytes) -> Iterator[tuple[int, str, str, list | None, str | None]]:
    """(version, op, id, vector, metadata JSON) up to the first cut or oversized entry; entries that aren't valid are skipped."""
    at = 0
    while at + 4 <= len(data):
        (size,) = struct.unpack_from("!I", data, at)
        if size > LONGEST_ENTRY or at + 4 + size > len(data):
            return
        try:
            e = json.loads(data[at + 4:at + 4 + size])
            row = int(e["ver"]), str(e["op"]), str(e["vid"]), e.get("vec"), json.dumps(e["meta"], separators=(",", ":")) if e.get("meta") else None
        except (ValueError, KeyError, TypeError):
            row = None
        if row:
            yield row
        at += 4 + size


def pack_snapshot(version: int, dim: int, rows: Iterable[tuple[str, Iterable[float], str | None]]) -> bytes:
    body = []
    for vector_id, vector, meta in rows:
        name, text = vector_id.encode(), (meta or "{}").encode()
        body.append(struct.pack("!I", len(name)) + name + np.asarray(vector, "<f4").tobytes() + struct.pack("!I", len(text)) + text)
    return SNAPSHOT_MAGIC + struct.pack("!III", version, dim, len(body)) + b"".join(body)


def snapshot_rows(data: bytes) -> tuple[int, int, list[tuple[str, np.ndarray, str]]] | None:
    """(version, dimension, rows), or None for a file that is no snapshot."""
    if data[:4] != SNAPSHOT_MAGIC or len(data) < 16:
        return None
    version, dim, count = struct.unpack_from("!III", data, 4)
    if not 0 < dim <= MOST_DIMS:
        return None
    at, out = 16, []
    for _ in range(count):
        if at + 4 > len(data):
            break
        (n,) = struct.unpack_from("!I", data, at)
        end = at + 4 + n + 4 * dim
        if n > LONGEST_ID or end + 4 > len(data):
            break
        (m,) = struct.unpack_from("!I", data, end)
        if end + 4 + m > len(data):
            break
        out.append((data[at + 4:at + 4 + n].decode(errors="replace"), np.frombuffer(data, "<f4", dim, at + 4 + n), data[end + 4:end + 4 + m].decode(errors="replace")))
        at = end + 4 + m
    return version, dim, out


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """All log files of a folder as change-log rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pid = int(re.search(r"(\d+)\.wal$", path)[1])
                got = [(pid, *e) for e in entries(data)]
                for a in range(0, len(got), 10_000):
                    cols = list(zip(*got[a:a + 10_000]))
                    types = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.float32()), pa.string())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], ["partition_id", "version", "op", "vector_id", "embedding", "metadata"])

    return _files(spark, folder, "*.wal").select("path", "content").mapInArrow(rows, LOG_SCHEMA)


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the newest snapshot file of each partition in a folder, newest by its name."""
    files = _files(spark, folder, "snapshot_*.bin").select("path", "content")
    named = files.select("*", F.regexp_extract("path", r"snapshot_(\d+)_v(\d+)\.bin$", 1).cast("int").alias("p"), F.regexp_extract("path", r"_v(\d+)\.bin$", 1).try_cast("long").alias("v"))
    newest = named.where("v is not null").groupBy("p").agg(F.max_by("path", "v").alias("path"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.float32()), pa.string())
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = snapshot_rows(data)
                if got is None:
                    continue
                pid = int(re.search(r"snapshot_(\d+)_v", path)[1])
                for a in range(0, len(got[2]), 10_000):
                    cols = list(zip(*((pid, got[0], got[1], i, v, m) for i, v, m in got[2][a:a + 10_000])))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], ["partition_id", "snapshot_version", "dim", "vector_id", "embedding", "metadata"])

    return files.join(F.broadcast(newest), "path", "left_semi").mapInArrow(rows, SNAPSHOT_SCHEMA)


def _written(rows: DataFrame, folder: str, pack) -> int:
    """Write one file per partition_id group: temporary name, then rename.  Returns the number of files."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        name, data = pack(pdf)
        files, base = pafs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/.{name}") as out:
            out.write(data)
        files.move(f"{base}/.{name}", f"{base}/{name}")
        return pd.DataFrame({"name": [name]})

    return len(rows.groupBy("partition_id").applyInPandas(write, "name string").collect())


def write_logs(log: DataFrame, folder: str) -> int:
    """One log file per partition, entries by version."""

    def pack(pdf: pd.DataFrame) -> tuple[str, bytes]:
        pdf = pdf.sort_values("version", kind="stable")
        data = b"".join(pack_entry(r.op, r.vector_id, int(r.version), r.embedding, r.metadata) for r in pdf.itertuples())
        return LOG_NAME.format(int(pdf["partition_id"].iloc[0])), data

    return _written(log.select("partition_id", "version", "op", "vector_id", "embedding", "metadata"), folder, pack)


def write_snapshots(rows: DataFrame, folder: str) -> int:
    """One snapshot file per partition from (partition_id, snapshot_version, vector_id, embedding, metadata)."""

    def pack(pdf: pd.DataFrame) -> tuple[str, bytes]:
        pdf = pdf.sort_values("vector_id", kind="stable")
        version = int(pdf["snapshot_version"].iloc[0])
        data = pack_snapshot(version, len(pdf["embedding"].iloc[0]), ((r.vector_id, r.embedding, r.metadata) for r in pdf.itertuples()))
        return SNAPSHOT_NAME.format(int(pdf["partition_id"].iloc[0]), version), data

    return _written(rows.select("partition_id", "snapshot_version", "vector_id", "embedding", "metadata"), folder, pack)


def storage_stats(spark: SparkSession, folder: str) -> DataFrame:
    """One row: log_files, log_bytes, snapshot_files, from file listings alone."""
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    is_log, is_snapshot = F.col("path").endswith(".wal"), F.col("path").rlike(r"snapshot_[0-9]+_v[0-9]+\.bin$")
    return meta.agg(F.count_if(is_log).alias("log_files"), F.coalesce(F.sum(F.when(is_log, F.col("length"))), F.lit(0)).alias("log_bytes"), F.count_if(is_snapshot).alias("snapshot_files"))
