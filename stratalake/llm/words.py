"""Words of many texts at once, as numpy arrays."""

from __future__ import annotations

import numpy as np

#: Odd, so that its powers have inverses modulo 2 ** 64.
_BASE, _BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)

#: For each byte its lower case if it can be part of a word (a-z, 0-9, all of UTF-8 beyond ASCII), else 0.
WORD_BYTES = np.zeros(256, dtype=np.uint8)
for _b in range(256):
    if _b >= 0x80 or chr(_b).isalnum():
        WORD_BYTES[_b] = ord(chr(_b).lower()) if _b < 0x80 else _b
#: The same as a table for bytes.translate, with a space for 0.
WORD_TABLE = bytes(int(b) or 0x20 for b in WORD_BYTES)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, _BASE_INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[size]


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd number modulo 2 ** 64."""
    return _power_tables(n)[0][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, text after text, and for each text where its words begin (with the end as a last entry)."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    raw = WORD_BYTES[np.frombuffer(b"\x00".join([*texts, b""]), dtype=np.uint8)]
    inside = np.concatenate([[0], (raw != 0).view(np.int8), [0]])
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    if not len(starts):
        return np.empty(0, dtype=np.uint64), bounds
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64, out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts]), bounds


def batches_of(texts: list[str | None], most: int = 1 << 20) -> list[tuple[int, list[bytes]]]:
    """The texts in UTF-8 (null: empty), in runs of about `most` bytes; with each run the index of its first text."""
    runs: list[tuple[int, list[bytes]]] = []
    size = most + 1
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if size + len(b) > most:
            runs.append((i, []))
            size = 0
        runs[-1][1].append(b)
        size += len(b)
    return runs
