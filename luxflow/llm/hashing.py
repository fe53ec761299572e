"""Hashes of any substrings of a byte array, from one pass of prefix sums."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        held = np.full(size, base, np.uint64)
        held[0] = 1
        with np.errstate(over="ignore"):
            held = np.multiply.accumulate(held)
        if size <= 1 << 22:
            _powers[name] = held
    return held[:n]


class Spans:
    """of(starts, ends): a 64-bit hash of each span of data; equal bytes have equal hashes in any array."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_TABLE[data] * _power("up", BASE, n), out=self.sums[1:])
        self.down = _power("down", pow(BASE, -1, 1 << 64), n + 1)

    def rough(self, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        """As of, but only the leading bits are good."""
        with np.errstate(over="ignore"):
            return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def of(self, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.sums[ends] - self.sums[starts]) * self.down[starts]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
        return x


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbouring values."""
    n = len(values)
    if width == 1:
        return values
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


#: Byte classes: letters, digits and bytes of other alphabets belong to words.
WORD_BYTE = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word (run of letters and digits) of text, lower-cased."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = WORD_BYTE[data]
    edge = np.diff(inside)
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    return Spans(data).of(starts, ends)
