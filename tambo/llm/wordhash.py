"""Word positions and 64-bit word hashes of many texts at once, from their joined UTF-8 bytes."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd, so it has an inverse modulo 2^64: a word's polynomial hash does not depend on where it stands.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A"):ord("Z") + 1] += 32
LOWER = _lower
#: Word bytes: digits, letters, and every byte of a non-ASCII character.
IN_WORD = np.array([chr(b).isascii() and chr(b).isalnum() or b >= 0x80 for b in range(256)])


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, U)
    with np.errstate(over="ignore"):
        filled, step = 1, U(base)
        while filled < n:
            more = min(filled, n - filled)
            out[filled:filled + more] = out[:more] * step
            filled += more
            step = step * step
    return out


_POWERS: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _POWERS["up"], _POWERS["down"] = powers(BASE, size), powers(INVERSE, size)
    return _POWERS["up"], _POWERS["down"]


def finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte (in the joined bytes), hash and text number of every lower-cased word."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = IN_WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _tables(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum((LOWER[data].astype(U) + U(1)) * up[:len(data)], out=sums[1:])
        hashes = finish((sums[ends] - sums[starts]) * down[starts])
    heads = np.cumsum([0] + [len(t) + 1 for t in texts])
    return starts, ends, hashes, np.searchsorted(heads, starts, side="right") - 1
