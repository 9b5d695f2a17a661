"""Arrays as compressed bytes, for rows that carry a whole block's numbers."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), ord(a.dtype.char)))], np.int64)
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + b"".join(a.tobytes() for a in arrays))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8), 8 * (1 + 2 * n), []
    for k in range(n):
        kind = np.dtype(chr(int(head[2 * k + 1])))
        out.append(np.frombuffer(raw, kind, int(head[2 * k]), at))
        at += int(head[2 * k]) * kind.itemsize
    return out


def small(x: np.ndarray) -> np.ndarray:
    """Non-negative integers in the narrowest of 16, 32 and 64 bits."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def steps(rising: np.ndarray) -> np.ndarray:
    """A rising uint64 array as byte planes of its differences, the high ones mostly zero."""
    return np.ascontiguousarray(np.diff(rising, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).ravel()


def unsteps(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).ravel().view(np.uint64), dtype=np.uint64)


def planes(x: np.ndarray) -> np.ndarray:
    """Non-negative integers under 2^32 as four planes of bytes, the high ones mostly zero."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel()


def unplanes(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(4, -1).T).ravel().view("<u4").astype(np.int64)
