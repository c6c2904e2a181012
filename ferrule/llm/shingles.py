"""Word shingles of Arrow text columns, hashed without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words of a shingle.
WIDTH = 5
#: Bytes of text hashed at a time.
CHUNK = 1 << 18
#: The base of the polynomial hash, its inverse modulo 2^64, and the weight of each word of a shingle: odd numbers from a fixed seed.
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_RANDOM.integers(1 << 61, 1 << 62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = _RANDOM.integers(1 << 61, 1 << 62, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_powers: list[np.ndarray] = []


def _fit_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, CHUNK), b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of texts that lie end to end, and the index of each text's first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = (data != 32) & ((data < 9) | (data > 13))
    opens = np.zeros(n + 1, bool)
    opens[offsets] = True
    before = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & (~before | opens[:-1]))
    after = np.concatenate([solid[1:], [False]])
    ends = np.flatnonzero(solid & (~after | opens[1:])) + 1
    powers, inverses = _fit_powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * powers[:n])])
    return scramble((sums[ends] - sums[starts]) * inverses[starts]), np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct shingles of each text in turn, as sorted 64-bit hashes.

    A word is a run of bytes other than ASCII white space, A-Z as a-z. A text of one to four words has one shingle, all
    of it; a null text or one without words has none. Memory is a multiple of ``CHUNK`` or of the longest text.
    """
    texts = texts.cast(pa.large_string())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + CHUNK, "right")) - 1)
        last = min(last, len(texts))
        own = edges[first : last + 1]
        words, at = _word_hashes(data[own[0] : own[-1]], own - own[0])
        whole = np.zeros(max(len(words) - WIDTH + 1, 0), np.uint64)
        for k in range(WIDTH):
            whole += words[k : k + len(whole)] * _PLACES[k]
        whole = scramble(whole)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= WIDTH:
                yield np.unique(whole[a : b - WIDTH + 1])
            elif b > a:
                yield scramble(np.array([(words[a:b] * _PLACES[: b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield np.empty(0, np.uint64)
        first = last
