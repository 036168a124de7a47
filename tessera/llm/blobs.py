"""Columns of numbers and bytes as one compressed value, for exchanges with few, large rows.

An exchange of blobs costs a row for each bucket and task, not for each element;
``grouped`` reads one back, bucket by bucket, from a sorted partition.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "bucket int, kind int, blob binary"


def pack(*columns: np.ndarray) -> bytes:
    """Numbers go byte by byte, all first bytes first, as their upper bytes are alike."""
    planes = (np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.itemsize).T for c in columns)
    raw = b"".join(struct.pack("<q", p.size) + p.tobytes() for p in planes)
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], struct.unpack_from("<q", blob)[0], codec="zstd", asbytes=True)
    out, at = [], 0
    for kind in kinds:
        (n,) = struct.unpack_from("<q", raw, at)
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n, at + 8)
        out.append(planes if size == 1 else np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1))
        at += 8 + n
    return out


def rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*found, strict=True)) if found else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "kind", "blob"])


def dealt(df: DataFrame, partitions: int) -> DataFrame:
    return df.repartition(partitions, "bucket").sortWithinPartitions("bucket", "kind")


def grouped(batches):
    """(bucket, iterator of (kind, blob)); each iterator must be read before the next bucket."""
    import itertools

    flat = ((b, k, v.as_py()) for batch in batches for b, k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True))
    for bucket, some in itertools.groupby(flat, key=lambda r: r[0]):
        yield bucket, ((k, v) for _, k, v in some)


def split(bucket: np.ndarray, *columns: np.ndarray):
    """(bucket, columns) for each bucket that occurs, rows in their order."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(b[1:] != b[:-1]) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(bucket[part[0]]), [c[part] for c in columns]
