"""SHA-256 of many messages at once, with states that can be kept and resumed.

hashlib copies a running state but can't store one. A digest as hex text is 64 bytes, just one block, so the state before any
child of a node is a whole number of blocks and eight 32-bit words long. Arrays are word by message.
"""

from __future__ import annotations

from math import isqrt

import numpy as np


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _cube_root(n: int) -> int:
    low, high = 0, 1 << (n.bit_length() // 3 + 1)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if middle**3 <= n else (low, middle)
    return low


# The standard's constants, by its rule: 32 bits of the fractional parts of the roots of primes.
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], dtype=np.uint32)[:, None]
ROUNDS = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], dtype=np.uint32)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> n) | (x << (32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (8 words) after one more block (16 words)."""
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> 3)) + w[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> 10)))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + ROUNDS[t] + w[t]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return np.stack([a, b, c, d, e, f, g, h]) + state


def hex_block(digests: np.ndarray) -> np.ndarray:
    """Digests (8 words) as the block that their lower-case hex text is."""
    out = np.empty((16, digests.shape[1]), dtype=np.uint32)
    for half, shift in ((0, 16), (1, 0)):
        x = (digests >> shift) & 0xFFFF
        nibbles = ((x & 0xF000) << 12) | ((x & 0x0F00) << 8) | ((x & 0x00F0) << 4) | (x & 0x000F)
        letters = ((nibbles + 0x06060606) >> 4) & 0x01010101
        out[half::2] = nibbles + 0x30303030 + letters * 0x27
    return out


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digests of messages that end with the given number of whole blocks."""
    last = np.zeros((16, state.shape[1]), dtype=np.uint32)
    last[0] = 0x80000000
    last[15] = blocks * 512
    return compress(state, last)


def from_bytes(data: bytes) -> np.ndarray:
    """Digests or states, 32 bytes each."""
    return np.ascontiguousarray(np.frombuffer(data, dtype=">u4").astype(np.uint32).reshape(-1, 8).T)


def to_bytes(words: np.ndarray) -> bytes:
    return words.T.astype(">u4").tobytes()
