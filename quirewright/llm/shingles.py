"""Hashed word windows of many texts at once, and MinHash sketches, in numpy."""

from __future__ import annotations

import numpy as np

#: White space of the data's definition: space, tab, line feed, carriage return, U+00A0, U+3000.
WHITE = (0x20, 0x09, 0x0A, 0x0D, 0xA0, 0x3000)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of code points, each text followed by a line feed; the texts' starts."""
    data = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", "<u4")
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return data, np.concatenate([[0], np.cumsum(lengths)])


def white_mask(points: np.ndarray) -> np.ndarray:
    mask = points == WHITE[0]
    for w in WHITE[1:]:
        mask |= points == w
    return mask


def hash_runs(points: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the maximal runs where ``inside`` holds."""
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    if not len(starts):
        return starts, ends, np.array([], np.uint64)
    longest = int((ends - starts).max())
    powers = np.ones(longest, np.uint64)
    powers[1:] = _ODD
    powers = np.multiply.accumulate(powers)
    at = np.nonzero(inside)[0]
    within = at - np.repeat(starts, ends - starts)
    value = (points[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    value ^= value >> np.uint64(29)
    value *= powers[within]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)[:-1]])
    return starts, ends, mix(np.add.reduceat(value, offsets))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each ``size`` consecutive values."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.array([], np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _ODD + hashes[i : i + n]
    return mix(out)


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """For each text, lower-cased and split at white space, its distinct hashed word windows, sorted."""
    points, bounds = code_points([t.lower() for t in texts])
    starts, _, hashes = hash_runs(points, ~white_mask(points))
    first = np.searchsorted(starts, bounds)
    out = []
    for i in range(len(texts)):
        out.append(np.unique(windows(hashes[first[i] : first[i + 1]], size)))
    return out


class Sketcher:
    """``width`` MinHash values of 32 bits for each set."""

    def __init__(self, width: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 2**63, width, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        self.b = rng.integers(0, 2**63, width, dtype=np.uint64)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row per set; the sets must not be empty."""
        out = np.empty((len(sets), len(self.a)), np.uint32)
        for lo in range(0, len(sets), 32):
            part = sets[lo : lo + 32]
            flat = np.concatenate(part)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in part])[:-1]])
            least = np.minimum.reduceat(flat[:, None] * self.a[None, :] + self.b[None, :], offsets, axis=0)
            out[lo : lo + 32] = (mix(least) >> np.uint64(32)).astype(np.uint32)
        return out
