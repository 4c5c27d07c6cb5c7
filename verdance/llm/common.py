"""Helpers shared by the training-data operators: tables, shared scratch tables, and byte-level word hashing on Arrow
text columns (numpy inside Spark tasks; Spark does all partitioning, shuffling and recovery)."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that numpy works on at once in a task; one longer document is still taken whole.
CHUNK_BYTES = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_M_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_scratch: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). Where none is set, a folder of our own, on a local master
    alone: other executors would not see it."""
    global _own_scratch
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_scratch = _own_scratch or tempfile.mkdtemp(prefix="verdance-")
        root = f"file://{_own_scratch}"
    return root


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read again (survives lost executors)."""
    path = f"{scratch_dir(df.sparkSession)}/verdance-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """df marked for broadcast if it has at most max_rows rows (counted); otherwise unmarked, and Spark shuffles it.
    df should be cheap to count: a written table or a bounded one."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(col).cast("string")) % n


# --- numpy on Arrow text columns -------------------------------------------------------------------------------------


def text_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 document offsets of a string column, without a copy; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offs):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about chunk_bytes: (first row, end row, bytes, offsets from 0)."""
    data, offs = text_of(column)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + chunk_bytes, side="right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def lower_table() -> np.ndarray:
    """Byte map that lower-cases A-Z and nothing else."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def class_table(space: bytes = b" \t\n\v\f\r") -> np.ndarray:
    """0 for the separators, 1 for every other byte."""
    t = np.ones(256, dtype=np.uint8)
    t[list(space)] = 0
    return t


def runs(classes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one non-zero class that stay within a document: starts, ends, document."""
    n = len(classes)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    np.not_equal(classes[1:], classes[:-1], out=edge[1:n])
    edge[offs[1:-1]] = True
    at = np.flatnonzero(edge)
    keep = classes[at[:-1]] != 0
    starts, ends = at[:-1][keep], at[1:][keep]
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 8)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, m, np.uint64))]) for m in (_M, _M_INV)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing step of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[s:e] for many ranges at once; depends on the content and its order alone."""
    up, down = _power(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * down[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * up[ends] + (ends - starts).astype(np.uint64))


def segments(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """n_docs+1 offsets of each document's items, from their ascending document numbers."""
    return np.searchsorted(doc, np.arange(n_docs + 1))


def segment_sum(values: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Sum over each segment; 0 where it is empty. Works along the first axis."""
    out = np.zeros((len(seg) - 1, *values.shape[1:]), dtype=np.float64)
    full = seg[1:] > seg[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, seg[:-1][full], axis=0)
    return out
