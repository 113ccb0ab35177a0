"""Blocks of documents and shards of keys that answer each other with packed arrays: a row is one array set, not one value."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

ROW = "shard long, block long, kind int, tokens long, payload binary"


def squeezed(level: int = 1, **arrays: np.ndarray) -> bytes:
    """Named arrays as bytes; numbers as planes of bytes, which compress better."""
    out = []
    for name, a in arrays.items():
        planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T)
        out.append((name, a.dtype.str, len(a), zstandard.ZstdCompressor(level=level, write_content_size=True).compress(planes)))
    return pickle.dumps(out, protocol=5)


def unsqueezed(payload: bytes) -> dict[str, np.ndarray]:
    out = {}
    for name, kind, n, data in pickle.loads(payload):
        kind = np.dtype(kind)
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, n * kind.itemsize)), np.uint8)
        out[name] = np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind).reshape(n)
    return out


def row(shard: int, block: int, kind: int, tokens: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([block], pa.int64()), pa.array([kind], pa.int32()), pa.array([tokens], pa.int64()),
                                       pa.array([payload], pa.binary())], ["shard", "block", "kind", "tokens", "payload"])


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of a sorted stream by key."""
    rows: list[dict] = []
    for batch in batches:
        for i in range(batch.num_rows):
            r = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            if rows and r[key] != rows[0][key]:
                yield rows[0][key], rows
                rows = []
            rows.append(r)
    if rows:
        yield rows[0][key], rows
