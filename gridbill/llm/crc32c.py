"""CRC-32C (Castagnoli) of many byte strings at once, and the mask that record files put on it."""

from __future__ import annotations

import numpy as np

POLYNOMIAL = 0x82F63B78  # fixed value: the reflected Castagnoli polynomial
MASK_DELTA = 0xA282EAD8  # fixed value: added after the rotation
BLOCK = 512


def _linear(columns: np.ndarray) -> np.ndarray:
    """Table of a linear map over the 16-bit words, from the images of its 16 basis vectors."""
    table = np.zeros(1, np.uint32)
    for c in columns:
        table = np.concatenate([table, table ^ c])
    return table


def _after(zeros: int) -> tuple[np.ndarray, np.ndarray]:
    """Tables (low half, high half) of the register after so many zero bytes."""
    state = np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32))
    for _ in range(zeros * 8):
        state = (state >> np.uint32(1)) ^ np.where(state & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return _linear(state[:16]), _linear(state[16:])


_WORD, _STEP = _after(4), _after(BLOCK)


def _run(state: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return tables[0][state & np.uint32(0xFFFF)] ^ tables[1][state >> np.uint32(16)]


def crc32c(data: list[bytes]) -> np.ndarray:
    """The checksum of each byte string (of four bytes or more), as unsigned 32-bit integers.

    Each string is cut into blocks, zero-padded in front (a zero register is not
    changed by zeros); the blocks of all strings go through the register side by
    side, then the blocks of a string are joined by the register's linear step.
    """
    if not data:
        return np.zeros(0, np.uint32)
    blocks = np.array([-(-len(x) // BLOCK) for x in data])
    start = np.concatenate([[0], np.cumsum(blocks)])
    lanes = bytearray(int(start[-1]) * BLOCK)
    for x, end in zip(data, start[1:].tolist(), strict=True):
        if len(x) < 4:
            raise ValueError("strings of four bytes or more only")
        lanes[end * BLOCK - len(x) : end * BLOCK] = x
    flat = np.frombuffer(lanes, np.uint8)
    first = (start[1:] * BLOCK - [len(x) for x in data])[:, None] + np.arange(4)
    flat[first] ^= 0xFF  # the register starts with all bits set
    words = np.ascontiguousarray(flat.view("<u4").reshape(-1, BLOCK // 4).T)
    state = np.zeros(words.shape[1], np.uint32)
    for w in words:
        state = _run(state ^ w, _WORD)
    out = np.zeros(len(data), np.uint32)
    for k in range(int(blocks.max())):
        own = np.flatnonzero(blocks > k)
        out[own] = _run(out[own], _STEP) ^ state[start[own] + k]
    return ~out


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated right by 15 bits, plus a constant: a checksum that may itself be checksummed."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)
