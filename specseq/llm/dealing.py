"""Numbers dealt to buckets by their value, as packed columns.

A task that makes millions of (key, document) entries sends one row a bucket
with the entries' columns as bytes, so shuffles move few rows, and the receiving
side works on arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_width

SCHEMA = "bucket int, keys binary, docs binary, places binary"
#: Bytes of texts for which there is a bucket, beyond one for each shuffle partition. A receiving task holds the entries of one bucket.
BUCKET_BYTES = 12 << 20


def bucket_count(spark: SparkSession, text_bytes: int = 0) -> int:
    return max(shuffle_width(spark), -(-text_bytes // BUCKET_BYTES))


def planes(values: np.ndarray) -> bytes:
    """Bytes of whole numbers, all lowest bytes first and so on, with the width in front: high bytes are mostly 0 and compress away."""
    width = 8 if values.size and (values.min() < 0 or values.max() >= 1 << 32) else 4
    raw = np.ascontiguousarray(values.astype(f"<i{width}" if width == 8 else "<u4")).view(np.uint8).reshape(-1, width)
    return bytes([width]) + raw.T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T
    return np.ascontiguousarray(raw).view("<i8" if width == 8 else "<u4").reshape(-1).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers whose bits all depend on each other (splitmix64's last steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deal(keys: np.ndarray, docs: np.ndarray, places: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row a bucket. Documents go as differences of neighbours."""
    bucket = (mixed(keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    keys, docs, places, bucket = keys[order], docs[order], places[order], bucket[order]
    starts = np.append(np.nonzero(np.diff(bucket, prepend=-1))[0], len(bucket))
    rows = [(int(bucket[a]), keys[a:b].astype("<u8").tobytes(), planes(np.diff(docs[a:b], prepend=0)), planes(places[a:b])) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int32(), pa.binary(), pa.binary(), pa.binary()], strict=True)], names=["bucket", "keys", "docs", "places"])


def gathered(batches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """keys, docs and places of all rows that a task receives."""
    keys, docs, places = [], [], []
    for batch in batches:
        for k, d, p in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("keys", "docs", "places")), strict=True):
            keys.append(np.frombuffer(k, "<u8"))
            docs.append(np.cumsum(from_planes(d)))
            places.append(from_planes(p))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(places)


def dealt(entries: DataFrame, buckets: int) -> DataFrame:
    """Rows with their bucket, each bucket in a partition of its own."""
    return entries.repartitionById(buckets, F.col("bucket"))


def runs_of(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.append(0, np.nonzero(sorted_keys[1:] != sorted_keys[:-1])[0] + 1)
    return starts, np.append(starts[1:], len(sorted_keys))


def runs_of_two(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs in which both columns, sorted together, stay equal."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.append(0, np.nonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]))[0] + 1)
    return starts, np.append(starts[1:], len(a))
