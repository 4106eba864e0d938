"""Compression of records and signals, for use inside reading and writing tasks."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Codec numbers of the container format.
RECORD_CODECS = {0: "none", 1: "zlib", 2: "zstd", 250: "svb-zd"}
SIGNAL_CODECS = {0: "none", 1: "svb-zd", 250: "zlib", 251: "zstd"}


def codec_number(codecs: dict[int, str], name: str) -> int:
    for number, known in codecs.items():
        if known == name:
            return number
    raise ValueError(f"unknown codec: {name}")


def pack_varbytes(values: np.ndarray) -> bytes:
    """Count, two control bits for each unsigned value (bytes less one, low bits first), then the bytes."""
    v = np.ascontiguousarray(values, dtype="<u4")
    if not len(v):
        return struct.pack("<I", 0)
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    control = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    control[: len(v)] = size - 1
    packed = (control.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    keep = np.arange(4) < size[:, None]
    return struct.pack("<I", len(v)) + packed.tobytes() + v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack_varbytes(data: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<I", data)
    controls = -(-n // 4)
    raw = np.frombuffer(data, np.uint8, offset=4)
    size = ((raw[:controls, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3).ravel()[:n].astype(np.int64) + 1
    if len(raw) != controls + size.sum():
        raise ValueError("a packed signal does not have the length that its controls say")
    out = np.zeros((n, 4), dtype=np.uint8)
    out[np.arange(4) < size[:, None]] = raw[controls:]
    return out.view("<u4").ravel()


def pack_signal(signal: np.ndarray) -> bytes:
    """Differences, zig-zagged to unsigned numbers, then packed."""
    d = np.diff(signal.astype(np.int32), prepend=np.int32(0))
    return pack_varbytes(((d << 1) ^ (d >> 31)).view(np.uint32))


def unpack_signal(data: bytes) -> np.ndarray:
    z = unpack_varbytes(data)
    d = (z >> 1).astype(np.int32) ^ -(z & 1).astype(np.int32)
    return np.cumsum(d, dtype=np.int32).astype(np.int16)


def pack_signals(signals: list[np.ndarray]) -> list[bytes]:
    """``pack_signal`` of many signals, whose values are packed as one array."""
    counts = np.fromiter(map(len, signals), np.int64, len(signals))
    values = np.concatenate([np.zeros(0, np.int32), *signals]).astype(np.int32)
    first = np.cumsum(counts) - counts
    d = np.diff(values, prepend=np.int32(0))
    own = first[counts > 0]
    d[own] = values[own]
    v = ((d << 1) ^ (d >> 31)).view(np.uint32)
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    # Each signal's controls begin at a byte of their own.
    controls = -(-counts // 4)
    control_at = np.cumsum(controls) - controls
    control = np.zeros(4 * int(controls.sum()), dtype=np.uint8)
    control[np.arange(len(v)) + np.repeat(4 * control_at - first, counts)] = size - 1
    packed = (control.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()
    data = v.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    data_at = ends[np.concatenate([first, [len(v)]])].tolist()
    return [struct.pack("<I", n) + packed[c : c + m] + data[a:b] for n, c, m, a, b in zip(counts.tolist(), control_at.tolist(), controls.tolist(), data_at[:-1], data_at[1:], strict=True)]


def unpack_signals(packed: list[bytes]) -> list[np.ndarray]:
    """``unpack_signal`` of many signals: one scatter of all bytes, and sums that begin anew with each signal."""
    counts = np.array([struct.unpack_from("<I", p)[0] for p in packed], np.int64)
    controls = -(-counts // 4)
    control = np.frombuffer(b"".join(p[4 : 4 + c] for p, c in zip(packed, controls.tolist(), strict=True)), np.uint8)
    data = np.frombuffer(b"".join(p[4 + c :] for p, c in zip(packed, controls.tolist(), strict=True)), np.uint8)
    first = np.cumsum(counts) - counts
    total = int(counts.sum())
    sizes = ((control[:, None] >> np.array([0, 2, 4, 6], dtype=np.uint8)) & 3).ravel()
    size = sizes[np.arange(total) + np.repeat(4 * (np.cumsum(controls) - controls) - first, counts)].astype(np.int64) + 1
    ends = np.concatenate([[0], np.cumsum(size)])
    held = np.array([len(p) for p in packed], np.int64) - 4 - controls
    if not np.array_equal(np.diff(ends[np.concatenate([first, [total]])]), held):
        raise ValueError("a packed signal does not have the length that its controls say")
    out = np.zeros((total, 4), dtype=np.uint8)
    out[np.arange(4) < size[:, None]] = data
    z = out.view("<u4").ravel()
    sums = np.cumsum((z >> 1).astype(np.int64) ^ -(z & 1).astype(np.int64))
    before = np.concatenate([[0], sums])[first]
    whole = (sums - np.repeat(before, counts)).astype(np.int16)
    return np.split(whole, first[1:]) if len(packed) else []


def compress(data: bytes, codec: str) -> bytes:
    if codec == "none":
        return data
    if codec == "zlib":
        return zlib.compress(data)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=1).compress(data)
    if codec == "svb-zd":
        return pack_signal(np.frombuffer(data, "<i2"))
    raise ValueError(f"unknown codec: {codec}")


def decompress(data: bytes, codec: str) -> bytes:
    if codec == "none":
        return data
    if codec == "zlib":
        return zlib.decompress(data)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if codec == "svb-zd":
        return unpack_signal(data).astype("<i2").tobytes()
    raise ValueError(f"unknown codec: {codec}")
