"""Vectorised work on many byte strings at once: one buffer, starts and lengths."""

from __future__ import annotations

import numpy as np

U = np.uint64
# XXH64's primes (fixed values of the public algorithm).
P1, P2, P3, P4, P5 = (U(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Longer strings go through the C library one by one; so the vectorised rounds are bounded.
LONG = 2048

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow binary or string array, without copies of single rows; nulls are empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def eights(buf: np.ndarray) -> np.ndarray:
    """A view whose item i is the little-endian 8 bytes at i; ``buf`` must go on 8 bytes beyond the last one wanted."""
    return np.lib.stride_tricks.as_strided(buf.view(), shape=(max(0, len(buf) - 7), 8), strides=(1, 1)) if len(buf) > 7 else np.zeros((0, 8), np.uint8)


def load8(win: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(win[at]).view("<u8").ravel()


def rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc, x):
    return rotl(acc + x * P2, 31) * P1


def xxh64(buf: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of every buf[start : start + length]."""
    padded = np.concatenate([buf, np.zeros(40, np.uint8)])
    win, s, n = eights(padded), U(seed), length.astype(np.int64)
    pos, h = start.astype(np.int64).copy(), np.full(len(start), s + P5, np.uint64)
    big = np.flatnonzero((n >= 32) & (n <= LONG))
    with np.errstate(over="ignore"):
        if len(big):
            big = big[np.argsort(-n[big], kind="stable")]
            stripes, p = n[big] // 32, pos[big].copy()
            v = [np.full(len(big), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            for k in range(int(stripes[0])):
                m = int(np.searchsorted(-stripes, -k, side="left"))  # those with more than k stripes come first
                for j in range(4):
                    v[j][:m] = _round(v[j][:m], load8(win, p[:m] + 8 * j))
                p[:m] += 32
            acc = rotl(v[0], 1) + rotl(v[1], 7) + rotl(v[2], 12) + rotl(v[3], 18)
            for x in v:
                acc = (acc ^ _round(U(0), x)) * P1 + P4
            h[big], pos[big] = acc, p
        h += n.astype(np.uint64)
        rest = np.where(n > LONG, 0, n % 32)
        for k in range(3):
            i = np.flatnonzero(rest >= 8 * (k + 1))
            if not len(i):
                break
            h[i] = rotl(h[i] ^ _round(U(0), load8(win, pos[i])), 27) * P1 + P4
            pos[i] += 8
        rest %= 8
        i = np.flatnonzero(rest >= 4)
        if len(i):
            h[i] = rotl(h[i] ^ (load8(win, pos[i]) & U(0xFFFFFFFF)) * P1, 23) * P2 + P3
            pos[i] += 4
            rest[i] -= 4
        for k in range(3):
            i = np.flatnonzero(rest > k)
            if not len(i):
                break
            h[i] = rotl(h[i] ^ padded[pos[i]].astype(np.uint64) * P5, 11) * P1
            pos[i] += 1
        h ^= h >> U(33)
        h *= P2
        h ^= h >> U(29)
        h *= P3
        h ^= h >> U(32)
    if len(long := np.flatnonzero(n > LONG)):
        import xxhash

        h[long] = [xxhash.xxh64_intdigest(buf[start[i] : start[i] + n[i]].tobytes(), seed=seed) for i in long]
    return h


def joined_words(buf: np.ndarray, off: np.ndarray):
    """Every text's words with one space after each: bytes, each word's start and end, each text's first word.

    Words never run across texts, and the result holds no other white space.
    """
    if not len(buf):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~SPACE[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True  # a text begins here
    begins = word & np.r_[True, ~word[:-1] | first[1:-1]]
    start = np.flatnonzero(begins)
    ends = word & (np.r_[~word[1:], True] | first[1:])
    length = np.flatnonzero(ends) + 1 - start
    at = np.r_[0, np.cumsum(length + 1)]
    out = np.full(at[-1], 32, np.uint8)
    target = np.ones(at[-1], bool)
    target[at[1:] - 1] = False
    out[target] = buf[word]
    return out, at[:-1], at[:-1] + length, np.searchsorted(start, off)
