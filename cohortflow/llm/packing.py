"""Numbers packed into binary cells, so that a shuffle moves few large rows instead of many small ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray) -> bytes:
    """Bytes of an integer array, plane by plane, compressed: high bytes that are alike take no room."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T) if len(values) else np.zeros(0, np.uint8)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(cell: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(cell[:8], "little")
    width = np.dtype(kind).itemsize
    raw = pa.decompress(cell[8:], decompressed_size=size * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, size).T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """``pack`` of a sorted array by its gaps."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(cell: bytes, kind: type) -> np.ndarray:
    return np.cumsum(unpack(cell, kind), dtype=kind)
