"""Content hashes. SHA-256 is built in and the default; BLAKE3, which the store's own files use, comes from its published
specification in numpy, many inputs at a time, behind an Arrow function."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Fixed values of the BLAKE3 specification: initial chaining value, message permutation, domain flags.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
BLOCK, CHUNK = 64, 1024


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return x >> np.uint32(n) | x << np.uint32(32 - n)


def _compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """cv: 8 x lanes, words: 16 x lanes, the rest a number for each lane. The next chaining values."""
    v = [*cv, *(np.broadcast_to(x, cv.shape[1]) for x in IV[:4]), counter.astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), size.astype(np.uint32), flags.astype(np.uint32)]
    m = list(words)
    columns, diagonals = [(i, 4 + i, 8 + i, 12 + i) for i in range(4)], [(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4) for i in range(4)]
    for _ in range(7):
        for k, (a, b, c, d) in enumerate(columns + diagonals):
            for word, first, second in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = v[a] + v[b] + word
                v[d] = _rotated(v[d] ^ v[a], first)
                v[c] = v[c] + v[d]
                v[b] = _rotated(v[b] ^ v[c], second)
        m = [m[p] for p in PERMUTATION]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)])


def _hash_lanes(inputs: list[bytes]) -> list[bytes]:
    """Every chunk of every input is a lane; then, level by level, every pair of nodes."""
    sizes = np.array([len(x) for x in inputs], np.int64)
    width = np.maximum(1, -(-sizes // CHUNK))
    data = np.frombuffer(b"".join(x.ljust(int(w) * CHUNK, b"\0") for x, w in zip(inputs, width, strict=True)), "<u4").reshape(-1, CHUNK // 4)
    of = np.repeat(np.arange(len(inputs)), width)
    place = np.arange(len(of)) - np.repeat(np.cumsum(width) - width, width)
    held = np.minimum(CHUNK, sizes[of] - place * CHUNK)
    blocks = np.maximum(1, -(-held // BLOCK))
    cv = np.repeat(IV[:, None], len(of), 1)
    for b in range(int(blocks.max())):
        on = np.flatnonzero(blocks > b)
        last = blocks[on] == b + 1
        flags = (CHUNK_START if b == 0 else 0) + CHUNK_END * last + ROOT * (last & (width[of[on]] == 1))
        words = data[on, b * 16 : (b + 1) * 16].T.astype(np.uint32)
        cv[:, on] = _compress(cv[:, on], words, place[on].astype(np.uint64), np.minimum(BLOCK, held[on] - b * BLOCK), flags)
    while (width > 1).any():
        left = np.flatnonzero(place % 2 == 0)
        paired = place[left] + 1 < width[of[left]]  # an odd node goes up as it is
        pair = left[paired]
        up = cv[:, left]
        n = len(pair)
        flags = PARENT + ROOT * (width[of[pair]] == 2)
        up[:, paired] = _compress(np.repeat(IV[:, None], n, 1), np.concatenate([cv[:, pair], cv[:, pair + 1]]), np.zeros(n, np.uint64), np.full(n, BLOCK), flags)
        cv, of, place, width = up, of[left], place[left] // 2, (width + 1) // 2
    raw = np.ascontiguousarray(cv.T).astype("<u4").tobytes()
    return [raw[32 * k : 32 * k + 32] for k in range(len(inputs))]


def blake3_many(inputs: list[bytes]) -> list[bytes]:
    out: list[bytes] = []
    part: list[bytes] = []
    held = 0
    for x in inputs:
        if part and held + len(x) > 8 << 20:
            out += _hash_lanes(part)
            part, held = [], 0
        part.append(x)
        held += max(CHUNK, len(x))
    return out + (_hash_lanes(part) if part else [])


def blake3(data: bytes) -> bytes:
    return _hash_lanes([data])[0]


@F.pandas_udf(BinaryType())
def _blake3_column(x: pd.Series) -> pd.Series:
    known = x.notna()
    out = pd.Series([None] * len(x), dtype=object)
    out[known.to_numpy()] = blake3_many([bytes(v) for v in x[known]])
    return out


HASHERS = {"sha256": lambda c: F.unhex(F.sha2(c, 256)), "blake3": lambda c: _blake3_column(c)}


def content_hash(c: Column, kind: str = "sha256") -> Column:
    """The hash of a binary column."""
    return HASHERS[kind](c)


def batch_hash(ordered_hashes: Column, kind: str = "sha256") -> Column:
    """The hash over an array of binary hashes, in order."""
    return content_hash(F.unhex(F.array_join(F.transform(ordered_hashes, F.hex), "")), kind)
