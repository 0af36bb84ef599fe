"""Packs of texts and sorted numbers that travel between tasks as compressed bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

PACKED = "kind int, pack long, bin long, payload binary"


def freeze(arrays: list[np.ndarray], body: bytes = b"", level: int = 1) -> bytes:
    """Arrays of 64-bit integers and bytes, compressed; in front, big endian in eight bytes, their plain size."""
    head = np.array([len(arrays), *map(len, arrays)], "<i8").tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays]
    return (sum(map(len, planes)) + len(body)).to_bytes(8, "big") + zstandard.compress(b"".join([head, *planes, body]), level)


def thaw(data: bytes) -> tuple[list[np.ndarray], bytes]:
    """What freeze() was given; the arrays are signed."""
    raw = zstandard.decompress(data[8:])
    count = int.from_bytes(raw[:8], "little")
    sizes, at, out = np.frombuffer(raw, "<i8", count, 8).tolist(), 8 + 8 * count, []
    for n in sizes:
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8").reshape(n))
        at += 8 * n
    return out, raw[at:]


def rows(found: list[tuple]) -> pa.RecordBatch:
    kind, pack, bin_, payload = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(pack, pa.int64()), pa.array(bin_, pa.int64()), pa.array(payload, pa.binary())], ["kind", "pack", "bin", "payload"])


def values(batches: Iterator[pa.RecordBatch], at_once: int = 100) -> Iterator[tuple]:
    """The rows of Arrow batches as Python values, few at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, at_once):
            part = batch.slice(a, at_once)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)
