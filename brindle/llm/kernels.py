"""Vectorised byte kernels shared by the Arrow-backed operators.

All work on one flat UTF-8 buffer and arrays of offsets, so cost per word is a few numpy operations and
memory is bounded by the piece size that :func:`pieces` cuts, not by the Arrow batch or by the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once by one Python worker.
PIECE_BYTES = 2 << 20

U = np.uint64
P1, P2, P3 = U(0x9E3779B185EBCA87), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
P4, P5 = U(0x85EBCA77C2B2AE63), U(0x27D4EB2F165667C5)

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of the batch with about ``limit`` bytes of text each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every row; null counts as empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all parts (32 zero bytes follow) and the parts' offsets."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return np.frombuffer(b"".join([*parts, bytes(32)]), dtype=np.uint8), offsets


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word ``[^\\x20\\x09-\\x0D]+``, and the words' offsets by part."""
    n = int(offsets[-1])
    black = ~WHITE[buf[:n]]
    first = black.copy()
    first[1:] &= ~black[:-1]
    last = black.copy()
    last[:-1] &= ~black[1:]
    edges = np.unique(offsets[(offsets > 0) & (offsets < n)])
    first[edges] = black[edges]
    last[edges - 1] = black[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _lane(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return rotl(acc + lane * P2, 31) * P1


def xxh64(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 42, block: int = 1 << 15) -> np.ndarray:
    """XXH64 of many slices of one padded buffer."""
    # Every byte position as an aligned 8-byte lane: numpy gathers from unaligned views far more slowly.
    stride = len(buf) // 8 - 1
    words = np.concatenate([buf[k : k + 8 * stride].view(np.uint64) for k in range(8)]) if stride > 0 else np.zeros(0, np.uint64)
    out = np.empty(len(starts), dtype=np.uint64)
    for i in range(0, len(starts), block):
        out[i : i + block] = _xxh64(buf, words, stride, starts[i : i + block], lens[i : i + block], U(seed))
    return out


def _xxh64(buf, words, stride, starts, lens, seed):
    def lanes(p):
        return words[(p & 7) * stride + (p >> 3)]

    pos, left = starts.copy(), lens.copy()
    with np.errstate(over="ignore"):
        h = np.full(len(starts), seed + P5, dtype=np.uint64)
        long = np.flatnonzero(lens >= 32)
        if len(long):
            v = [np.full(len(long), x, dtype=np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            at, n = pos[long], left[long]
            live = np.arange(len(long))
            while len(live):
                for k in range(4):
                    v[k][live] = _lane(v[k][live], lanes(at[live] + 8 * k))
                at[live] += 32
                n[live] -= 32
                live = live[n[live] >= 32]
            x = rotl(v[0], 1) + rotl(v[1], 7) + rotl(v[2], 12) + rotl(v[3], 18)
            zero = np.zeros(len(long), dtype=np.uint64)
            for k in range(4):
                x = (x ^ _lane(zero, v[k])) * P1 + P4
            h[long], pos[long], left[long] = x, at, n
        h += lens.astype(np.uint64)
        for k in range(3):
            live = np.flatnonzero(left >= 8)
            if not len(live):
                break
            h[live] = rotl(h[live] ^ (rotl(lanes(pos[live]) * P2, 31) * P1), 27) * P1 + P4
            pos[live] += 8
            left[live] -= 8
        live = np.flatnonzero(left >= 4)
        if len(live):
            h[live] = rotl(h[live] ^ ((lanes(pos[live]) & U(0xFFFFFFFF)) * P1), 23) * P2 + P3
            pos[live] += 4
            left[live] -= 4
        for k in range(3):
            live = np.flatnonzero(left > k)
            if not len(live):
                break
            h[live] = rotl(h[live] ^ (buf[pos[live] + k].astype(np.uint64) * P5), 11) * P1
        h ^= h >> U(33)
        h *= P2
        h ^= h >> U(29)
        h *= P3
        h ^= h >> U(32)
    return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def grams(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every run of k consecutive values; the ``len(h) - k + 1`` results are scrambled polynomials."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        acc = h[:n].copy()
        for j in range(1, k):
            acc *= U(base | 1)
            acc += h[j : j + n]
    return mix(acc)


def inside(offsets: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n-k+1 runs of k consecutive items lie within one part."""
    m = max(0, n - k + 1)
    part = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return part[:m] == part[k - 1 : k - 1 + m]


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def word_hashes(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """A quick 64-bit hash of many short slices of one padded buffer, for uses that no contract fixes."""
    stride = len(buf) // 8 - 1
    lanes = np.concatenate([buf[k : k + 8 * stride].view(np.uint64) for k in range(8)])
    masks = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
    out = np.empty(len(starts), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(starts), block):
            at, left = starts[i : i + block], lens[i : i + block]
            h = left.astype(np.uint64) * P5 + P4
            h = (h ^ (lanes[(at & 7) * stride + (at >> 3)] & masks[np.minimum(left, 8)])) * P1
            live = np.flatnonzero(left > 8)
            k = 8
            while len(live):
                a = at[live] + k
                h[live] = (rotl(h[live], 29) ^ (lanes[(a & 7) * stride + (a >> 3)] & masks[np.minimum(left[live] - k, 8)])) * P2
                k += 8
                live = live[left[live] > k]
            out[i : i + block] = mix(h)
    return out
