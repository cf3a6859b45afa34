"""Fixed-size records shuffled as blobs: each row holds the records of one bucket, packed by numpy.

A bucket's row costs the JVM no more than copying its bytes, however many records it holds. A blob has the
columns one after another, which compress better than rows. A reader gets the buckets of its partition one
at a time, so a task needs memory for one bucket only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronolap.llm import words

SCHEMA = "bucket int, records binary"


def _bytes(r: np.ndarray) -> bytes:
    return b"".join(r[name].tobytes() for name in r.dtype.names)


def _array(blob: bytes, dtype: np.dtype) -> np.ndarray:
    r = np.empty(len(blob) // dtype.itemsize, dtype)
    at = 0
    for name in dtype.names:
        kind, shape = (dtype[name].subdtype or (dtype[name], ()))
        each = kind.itemsize * int(np.prod(shape, dtype=np.int64))
        r[name] = np.frombuffer(blob, kind, count=len(r) * each // kind.itemsize, offset=at).reshape((len(r), *shape))
        at += len(r) * each
    return r


def pack(records: np.ndarray, key: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Blobs of the records by bucket of the key's high bits."""
    if not len(records):
        return
    b = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(b, kind="stable")
    b, records = b[order], records[order]
    at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    ends = np.r_[at[1:], len(b)]
    yield pa.RecordBatch.from_arrays([pa.array(b[at]), pa.array([_bytes(records[i:j]) for i, j in zip(at, ends)], pa.binary())], names=["bucket", "records"])


def dealt(packed: DataFrame) -> DataFrame:
    """The blobs of a bucket one after another in one task."""
    return packed.repartition("bucket").sortWithinPartitions("bucket")


def unpack(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[np.ndarray]:
    """The records of each bucket of dealt() blobs."""
    now, held = None, []
    for b in batches:
        for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if bucket != now and held:
                yield np.concatenate(held)
                held = []
                words.release()
            now = bucket
            held.append(_array(blob, dtype))
    if held:
        yield np.concatenate(held)
        held.clear()
    words.release()
