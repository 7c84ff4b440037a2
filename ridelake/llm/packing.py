"""Arrays of numbers, bits and words as compressed bytes."""

from __future__ import annotations

import numpy as np
import zstandard

_HEAD = 9


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, compressed: planes of small numbers are nearly empty."""
    width = numbers.dtype.itemsize
    planes = np.ascontiguousarray(numbers.astype(f"<u{width}", copy=False).view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1)


def pack_bits(bits: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.packbits(bits).tobytes())


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8), count=n).astype(bool)


def pack_words(words: list[bytes]) -> bytes:
    lengths = np.array([len(w) for w in words], dtype="<u8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(b"".join((len(words).to_bytes(8, "little"), lengths, *words)))


def unpack_words(data: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(data[:8], "little")
    first = 8 + 8 * n
    ends = (first + np.cumsum(np.frombuffer(data, "<u8", n, 8), dtype=np.int64)).tolist()
    return [data[a:b] for a, b in zip([first, *ends[:-1]], ends)]
