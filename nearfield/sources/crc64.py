"""CRC-64/ECMA-182, most significant bit first, from 0, without a final inversion."""

from __future__ import annotations

import numpy as np

#: Fixed value: the polynomial.
POLYNOMIAL = 0x42F0E1EBA9EA3693
_MASK = (1 << 64) - 1
_LANES = 4096


def _times_x8(crc: int) -> int:
    for _ in range(8):
        crc = ((crc << 1) ^ POLYNOMIAL if crc >> 63 else crc << 1) & _MASK
    return crc


_TABLE = np.array([_times_x8(b << 56) for b in range(256)], np.uint64)


def _multiply(a: int, b: int) -> int:
    """Product of two residues; bit 63 - i stands for no power of x but for x^(63 - i)."""
    out = 0
    for i in range(63, -1, -1):
        out = ((out << 1) ^ POLYNOMIAL if out >> 63 else out << 1) & _MASK
        if b >> i & 1:
            out ^= a
    return out


def _shift(crc: int, n: int) -> int:
    """The checksum after ``n`` zero bytes: times x^(8 n)."""
    power, square = 1, 1 << 8
    while n:
        if n & 1:
            power = _multiply(power, square)
        square = _multiply(square, square)
        n >>= 1
    return _multiply(crc, power)


def _serial(data: np.ndarray, crc: int) -> int:
    table = _TABLE.tolist()
    for b in data.tolist():
        crc = (crc << 8 & _MASK) ^ table[crc >> 56 ^ b]
    return crc


def crc64(data: bytes | memoryview, crc: int = 0) -> int:
    """Checksum of ``data`` after what gave ``crc``. The checksum is linear, so equal stretches run side by side and are joined."""
    raw = np.frombuffer(data, np.uint8)
    each = len(raw) // _LANES
    if each < 64:
        return _serial(raw, crc)
    lanes, state = raw[: each * _LANES].reshape(_LANES, each), np.zeros(_LANES, np.uint64)
    for column in lanes.T:
        state = (state << np.uint64(8)) ^ _TABLE[(state >> np.uint64(56)).astype(np.int64) ^ column]
    power = _shift(1, each)
    for lane in state.tolist():
        crc = _multiply(crc, power) ^ lane
    return _serial(raw[each * _LANES :], crc)
