"""Sorted codes with counts in few bytes: differences by byte planes, compressed."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

_HEAD = struct.Struct("<qqqBB")


def _planes(x: np.ndarray) -> tuple[int, bytes]:
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    return width, np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8)[:, :width].T).tobytes()


def _whole(raw: np.ndarray, m: int, width: int) -> np.ndarray:
    out = np.zeros((m, 8), np.uint8)
    out[:, :width] = raw.reshape(width, m).T
    return out.reshape(-1).view(np.int64)


def packed(codes: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending codes, one at least, and a count of each."""
    gaps = np.diff(codes, prepend=codes[:1])
    (wide, a), (deep, b) = _planes(gaps.astype(np.int64)), _planes(n.astype(np.int64))
    return _HEAD.pack(len(codes), int(codes[0]), len(a) + len(b), wide, deep) + pa.compress(a + b, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    m, base, size, wide, deep = _HEAD.unpack_from(data)
    raw = np.frombuffer(pa.decompress(memoryview(data)[_HEAD.size :], size, codec="zstd"), np.uint8)
    return np.cumsum(_whole(raw[: m * wide], m, wide)) + base, _whole(raw[m * wide :], m, deep)


def entries(data: bytes) -> int:
    return _HEAD.unpack_from(data)[0]


def summed(blocks: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of all blocks, ascending, and their counts added up."""
    parts = [unpacked(x) for x in blocks]
    codes, n = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
    order = np.argsort(codes)
    codes = codes[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(n[order], first)
