"""SHA-256 of many rows at once, with the state between blocks as a value of its own.

A digest written as text has 64 characters, just one block of the hash. So the state of a parent
before a child is eight numbers, which can be kept in a table and resumed anywhere.
"""

from __future__ import annotations

import numpy as np

# So many rows are hashed at a time; the arrays in between stay in the processor's cache.
_ROWS = 4096


def _primes(count: int) -> list[int]:
    found: list[int] = []
    candidate = 2
    while len(found) < count:
        if all(candidate % p for p in found):
            found.append(candidate)
        candidate += 1
    return found


def _root_bits(value: int, power: int) -> int:
    """The first 32 bits behind the point of a root of a small number."""
    scaled, low, high = value << (32 * power), 0, value << 32
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**power <= scaled else (low, middle - 1)
    return low & 0xFFFFFFFF


START = np.array([_root_bits(p, 2) for p in _primes(8)], np.uint32)
_ROUND = np.array([_root_bits(p, 3) for p in _primes(64)], np.uint32)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def _block(states: np.ndarray, block: np.ndarray) -> np.ndarray:
    w = list(block.T)
    for i in range(16, 64):
        a, b = w[i - 15], w[i - 2]
        low = _turned(a, 7) ^ _turned(a, 18) ^ (a >> np.uint32(3))
        high = _turned(b, 17) ^ _turned(b, 19) ^ (b >> np.uint32(10))
        w.append(w[i - 16] + low + w[i - 7] + high)
    a, b, c, d, e, f, g, h = states.T
    for i in range(64):
        mixed = _turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)
        first = h + mixed + (g ^ (e & (f ^ g))) + _ROUND[i] + w[i]
        second = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = first + second, a, b, c, d + first, e, f, g
    return states + np.stack([a, b, c, d, e, f, g, h], axis=1)


def resumed(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """States (n, 8) after one more block (n, 16) each, all unsigned 32-bit."""
    parts = [_block(states[i : i + _ROWS], blocks[i : i + _ROWS]) for i in range(0, len(states), _ROWS)]
    return np.concatenate(parts) if parts else states.copy()


def digest_blocks(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 32 bytes) written as hexadecimal text, as blocks (n, 16)."""
    shown = np.empty((len(digests), 64), np.uint8)
    shown[:, 0::2], shown[:, 1::2] = _HEX[digests >> 4], _HEX[digests & 15]
    return shown.view(">u4").astype(np.uint32)


def finished(states: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Digests (n, 32 bytes) of messages that end after so many whole blocks."""
    last = np.zeros((len(states), 16), np.uint32)
    last[:, 0], last[:, 15] = 0x80000000, counts * 512
    return resumed(states, last).astype(">u4").view(np.uint8).reshape(-1, 32)
