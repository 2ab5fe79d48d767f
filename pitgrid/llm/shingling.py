"""Words and word shingles of a text as arrays of 64-bit hashes (numpy, whole texts)."""

from __future__ import annotations

import numpy as np

# An odd multiplier and its inverse modulo 2**64; the hash of a span of bytes is the sum of
# byte * BASE**position, moved back to position 0 by the inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > _powers["n"]:
        size = max(n, 2 * _powers["n"], 4096)
        up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of each hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def spans(text: str | None, width: int = 1) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in order.

    A-Z is lower-cased; words are what white space ``[\\x20\\x09-\\x0D]`` leaves.  A text of
    fewer words than ``width`` but at least one gives its whole sequence as one run.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = np.frombuffer(b" ".join(words), np.uint8)
    gaps = np.flatnonzero(line == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(line)]))
    width = min(width, len(words))
    up, down = powers(len(line) + 1)
    sums = np.zeros(len(line) + 1, np.uint64)
    np.cumsum((line.astype(np.uint64) + np.uint64(1)) * up[: len(line)], out=sums[1:])
    first, last = starts[: len(starts) - width + 1], ends[width - 1 :]
    size = (last - first).astype(np.uint64)
    return mix((sums[last] - sums[first]) * down[first] + size * np.uint64(0x2545F4914F6CDD1D))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(spans(text, width))


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that tell a set from others."""
    with np.errstate(over="ignore"):
        a = mix(shingles + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) + np.uint64(len(shingles))
        b = mix(shingles ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    pair = mix(np.array([a, b], np.uint64)).view(np.int64)
    return int(pair[0]), int(pair[1])
