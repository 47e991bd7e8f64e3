"""Content-defined anchors of byte windows, and hashes of any run of bytes, vectorised over many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Fixed odd multipliers of the two polynomial hashes, and of the final mixing.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = U(0xD6E8FEB86659FD93)
#: Bytes hashed at once, about; longer texts are hashed in slices, which leaves 24 bits enough for places.
CHUNK = 1 << 18


def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.int64).astype(U)


VALUES = (_byte_values(11), _byte_values(12))


def mixed(x: np.ndarray) -> np.ndarray:
    y = x >> U(32)
    y ^= x
    y *= MIX
    y ^= y >> U(29)
    return y


_kept_powers: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), kept for the next texts."""
    kept = _kept_powers.get(base)
    if kept is None or len(kept) < n:
        kept = np.full(max(n, CHUNK + (CHUNK >> 2)), base, U)
        kept[0] = 1
        np.multiply.accumulate(kept, out=kept)
        if len(kept) <= 8 * CHUNK:
            _kept_powers[base] = kept
    return kept[:n]


class RunHash:
    """64-bit hashes of runs data[a:b]; equal runs have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray, which: int):
        n = len(data)
        self.powers = _powers(BASES[which], n + 1)
        self.sums = np.zeros(n + 1, U)
        # sums of value[j] / base ** j; the difference times base ** a no longer depends on a
        weighed = VALUES[which][data]
        weighed *= _powers(pow(BASES[which], -1, 1 << 64), n)
        np.cumsum(weighed, out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * self.powers[a] + b.astype(U) - a.astype(U))

    def each(self, width: int) -> np.ndarray:
        """The hash of every run of that width."""
        x = self.sums[width:] - self.sums[:-width]
        x *= self.powers[: len(x)]
        x += U(width)
        return mixed(x)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(U).max, U)
    padded[:n] = values
    grid = padded.reshape(rows, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def select(data: np.ndarray, ends: np.ndarray, window: int, gram: int):
    """For texts laid end to end in data (ends: where each ends): anchors as (gram place, first and last start of
    the windows that select it, text number). A window selects its gram of least hash, the last one at ties."""
    hashed = RunHash(data, 0)
    n = len(data)
    if n > 1 << 24:
        raise ValueError("cut longer texts into slices")
    if n < window:
        none = np.empty(0, np.int64)
        return hashed, none, none, none, none
    keys = hashed.each(gram)
    keys &= U(0xFFFFFFFFFF000000)
    keys |= np.arange(0xFFFFFF, 0xFFFFFF - len(keys), -1, dtype=np.int64).view(U)
    least = sliding_min(keys, window - gram + 1)
    begins = np.append(0, ends[:-1])
    first = np.union1d(np.flatnonzero(least[1:] != least[:-1]) + 1, begins[begins < len(least)])
    text = np.searchsorted(ends, first, "right")
    last = np.minimum(np.append(first[1:], len(least)) - 1, ends[text] - window)
    fits = last >= first
    first, last, text = first[fits], last[fits], text[fits]
    chosen = (U(0xFFFFFF) - (least[first] & U(0xFFFFFF))).astype(np.int64)
    return hashed, chosen, first, last, text
