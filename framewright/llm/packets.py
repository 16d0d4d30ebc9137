"""Integer and float arrays as one compressed byte string, so that a few large rows are shuffled instead of many small ones."""

import numpy as np
import zstandard

from framewright.llm.common import process_cache


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays, each stored by byte planes (all lowest bytes, then all next ones ...), which small numbers leave mostly zero."""
    press = process_cache("packets").setdefault("press", zstandard.ZstdCompressor(level=1, write_content_size=True))
    out = [np.array([len(arrays)], "<u4").tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
        body = press.compress(planes)
        out += [a.dtype.str.encode().ljust(4), np.array([len(body)], "<u4").tobytes(), body]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    unpress = process_cache("packets").setdefault("unpress", zstandard.ZstdDecompressor())
    data, arrays, at = memoryview(data), [], 4
    for _ in range(int.from_bytes(data[:4], "little")):
        kind, size = np.dtype(bytes(data[at : at + 4]).decode().strip()), int.from_bytes(data[at + 4 : at + 8], "little")
        planes = np.frombuffer(unpress.decompress(data[at + 8 : at + 8 + size]), np.uint8)
        arrays.append(np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).reshape(-1))
        at += 8 + size
    return arrays


def narrow(a: np.ndarray) -> np.ndarray:
    """Non-negative integers in the smallest of 1, 2, 4 or 8 bytes that holds them."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)
