"""Wu-Manber multi-pattern search over arrays of code points.

Patterns of one length class are searched together by their first ``m`` characters. A
shift table over blocks of ``B`` characters says how far a window may jump; windows
ending in a block of shift 0 are looked up in buckets by the hash of their ``m`` characters.
A bucket is one bit: whether it holds a pattern at all; which one it is, is found by direct
comparison later. So a table has a fixed size for any number of patterns. Many windows
("lanes") advance side by side, so each step is one array operation.
"""

from __future__ import annotations

import numpy as np

#: (smallest length, B) of each length class; lengths up to the next one belong to it.
CLASSES = [(1, 1), (2, 2), (4, 2), (8, 3), (16, 4), (32, 4)]
SLOT_BITS = {1: 16, 2: 20, 3: 20, 4: 21}
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LANES = 8192
#: Least and most bits of a bucket number; two buckets are looked up for each window.
BUCKET_BITS = 16, 29
#: Slots that say how far the longest pattern of a window reaches.
REACH_BITS = 18


def length_class(n: int) -> tuple[int, int]:
    return next(c for c in reversed(CLASSES) if c[0] <= n)


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as code points, each followed by a 0, and where each begins."""
    flat = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = np.fromiter((len(t) + 1 for t in texts), "int64", len(texts))
    return flat, np.cumsum(sizes) - sizes


def block_slots(codes: np.ndarray, b: int) -> np.ndarray:
    """Table slot of the block that ends at each position (positions before b-1 are of no use)."""
    h = np.zeros(len(codes), dtype="uint32")
    with np.errstate(over="ignore"):
        for k in range(b):
            part = codes[: len(codes) - k] * np.uint32((2654435761 * (2 * k + 1) + k * 40503) & 0xFFFFFFFF | 1)
            part ^= part >> np.uint32(15)
            h[k:] = h[k:] * np.uint32(31) + part
        h *= np.uint32(2246822519)
    return h >> np.uint32(32 - SLOT_BITS[b])


class Powers:
    """Powers of the hash base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype="uint64")

    def upto(self, n: int):
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, _R)], dtype="uint64")
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, _RINV)], dtype="uint64")
        return self.up, self.down


POWERS = Powers()


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    up, _ = POWERS.upto(len(codes) + 1)
    with np.errstate(over="ignore"):
        return np.r_[np.uint64(0), np.cumsum(codes.astype("uint64") * up[: len(codes)], dtype="uint64")]


def window_hashes(sums: np.ndarray, start: np.ndarray, m: int) -> np.ndarray:
    """Hash of the ``m`` characters from each start; equal windows have equal hashes anywhere."""
    _, down = POWERS.upto(len(sums))
    with np.errstate(over="ignore"):
        h = (sums[start + m] - sums[start]) * down[start]
        h ^= h >> np.uint64(31)
        return h * np.uint64(0xBF58476D1CE4E5B9)


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of any length; the length is part of it."""
    _, down = POWERS.upto(len(sums))
    with np.errstate(over="ignore"):
        h = (sums[end] - sums[start]) * down[start] + (end - start).astype("uint64") * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def pattern_rows(windows: list[str], m: int, b: int):
    """Of patterns cut to their first ``m`` characters: window hashes, and (slot, shift) minima."""
    codes, start = codes_of(windows)
    hashes = window_hashes(prefix_sums(codes), start, m)
    slots = block_slots(codes, b)
    at = start[:, None] + np.arange(b - 1, m)
    shift = np.broadcast_to(np.arange(m - b, -1, -1), at.shape)
    flat, s = slots[at].ravel(), shift.ravel()
    order = np.lexsort((s, flat))
    flat, s = flat[order], s[order]
    first = np.r_[True, flat[1:] != flat[:-1]] if len(flat) else np.array([], bool)
    return hashes.view("int64"), flat[first].astype("int64"), s[first].astype("int64")


def bucket_bits(patterns: int) -> int:
    """Bits of a bucket number for so many patterns: 32 buckets each, within the bounds."""
    return min(max(int(32 * patterns).bit_length(), BUCKET_BITS[0]), BUCKET_BITS[1])


def buckets_of(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two buckets of each window hash."""
    u = hashes.view("uint64")
    with np.errstate(over="ignore"):
        return (u >> np.uint64(64 - bits)).astype("int64"), ((u * _R) >> np.uint64(64 - bits)).astype("int64")


def reach_slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view("uint64") & np.uint64((1 << REACH_BITS) - 1)).astype("int64")


def table_bytes(m: int, b: int, slots: np.ndarray, shifts: np.ndarray, reach: tuple[np.ndarray, np.ndarray], bits: int, buckets: bytes) -> bytes:
    """The table of one length class as a flat file: shift table, reach, one bit a bucket."""
    shift = np.full(1 << SLOT_BITS[b], m - b + 1, dtype="uint8")
    shift[slots] = shifts
    far = np.full(1 << REACH_BITS, m, dtype="<i4")
    far[reach[0]] = reach[1]
    return np.array([m, b, len(shift), bits], dtype="<i8").tobytes() + shift.tobytes() + far.tobytes() + buckets


class Table:
    """Memory-mapped ``table_bytes``."""

    def __init__(self, path: str) -> None:
        head = np.memmap(path, dtype="<i8", mode="r", shape=(4,))
        self.m, self.b, ns, self.bits = (int(x) for x in head)
        self.shift = np.asarray(np.memmap(path, dtype="uint8", mode="r", offset=32, shape=(ns,)))
        self.reach = np.asarray(np.memmap(path, dtype="<i4", mode="r", offset=32 + ns, shape=(1 << REACH_BITS,)))
        self.buckets = np.asarray(np.memmap(path, dtype="uint8", mode="r", offset=32 + ns + (4 << REACH_BITS), shape=(1 << self.bits - 3,)))

    def search(self, codes: np.ndarray, slots: np.ndarray, sums: np.ndarray):
        """Starts of all windows whose buckets hold a pattern, and how far the longest one may reach."""
        n, m = len(codes), self.m
        if n < m:
            return np.array([], "int64"), np.array([], "int64")
        width = max(4 * m, -(-n // LANES))
        end = np.arange(m - 1, n, width)  # window ends; lane i covers ends in [i*width+m-1, (i+1)*width+m-1)
        stop = np.minimum(end + width, n)
        found = []
        while len(end):
            jump = self.shift[slots[end]]
            zero = jump == 0
            if zero.any():
                start = end[zero] - (m - 1)
                h = window_hashes(sums, start, m)
                one, two = buckets_of(h, self.bits)
                held = (self.buckets[one >> 3] >> (one & 7).astype("uint8") & 1) & (self.buckets[two >> 3] >> (two & 7).astype("uint8") & 1)
                if held.any():
                    hit = held > 0
                    found.append((start[hit], self.reach[reach_slot(h[hit])]))
            end = end + np.maximum(jump, 1)
            live = end < stop
            if not live.all():
                end, stop = end[live], stop[live]
        if not found:
            return np.array([], "int64"), np.array([], "int64")
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]).astype("int64")
