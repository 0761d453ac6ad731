"""Word shingles of whole texts as sets of 64-bit hashes, and their HyperMinHash registers."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

from tempora.llm.common import SLICE_BYTES, distinct, grouped, mix, prefix_sums, range_hash, ranges

WORDS = 5
#: Bands of registers; rows with a Jaccard of 0.85 miss all of them with a chance below 1e-6, those of 0.8 below 1e-4.
BANDS, ROWS, MANTISSA = 24, 5, 10
EMPTY = 0xFFFF
_SPREAD = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(4 * BANDS + 4 * WORDS)], np.uint64)


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with A-Z as a-z, and starts and ends of the words of all documents."""
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    if not len(data):
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = (data != 0x20) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    return data, start, np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False))) + 1


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all documents, A-Z as a-z, their starts, and the words before each document (and the total)."""
    data, start, end = word_spans(data, at)
    return range_hash(prefix_sums(data), start, end), start, np.searchsorted(start, at)


def digests(data: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A cryptographic digest of each document's words in their order."""
    data, start, end = word_spans(data, at)
    length = end - start + 1
    flat = np.full(int(length.sum()), 32, np.uint8)
    place = np.cumsum(length) - length
    flat[ranges(place, length - 1)] = data[ranges(start, length - 1)]
    cut, raw = np.append(place, len(flat))[np.searchsorted(start, at)].tolist(), memoryview(flat)
    return [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(cut, cut[1:], strict=False)]


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document, one after another, and their offsets. Fewer words than size make one shingle."""
    hashes, _, word_at = words(data, at)
    return sets_of_words(hashes, word_at, size)


def shingle_hashes(hashes: np.ndarray, word_at: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All shingles of the documents' words, their first words, their numbers of words, and their offsets by document."""
    n = np.diff(word_at)
    padded = np.append(hashes, np.zeros(size, np.uint64))
    full = mix(sum(padded[k : k + len(hashes)] * _SPREAD[k] for k in range(size))) if len(hashes) else hashes
    many = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    flat = np.empty(int(many.sum()), np.uint64)
    out_at = np.concatenate([[0], np.cumsum(many)])
    first, length = ranges(word_at[:-1], many).astype(np.int32), np.repeat(np.minimum(n, size).astype(np.uint8), many)
    long = n >= size
    flat[ranges(out_at[:-1][long], many[long])] = full[ranges(word_at[:-1][long], many[long])]
    for m in range(1, size):
        rows = np.flatnonzero(n == m)
        if len(rows):
            at = word_at[:-1][rows]
            flat[out_at[:-1][rows]] = mix(sum(hashes[at + k] * _SPREAD[k] for k in range(m)) + np.full(1, m, np.uint64) * _SPREAD[size])
    return flat, first, length, out_at


def sets_of_words(hashes: np.ndarray, word_at: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document, one after another, and their offsets."""
    flat, _, _, out_at = shingle_hashes(hashes, word_at, size)
    return sorted_sets(flat, out_at)


def exact_sets(data: np.ndarray, at: np.ndarray, size: int = WORDS, estimated: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As shingle_sets, but with a number of its own for each shingle that differs, as its words' bytes are compared: these hold in one call only. With estimated, the documents' registers too."""
    low, start, end = word_spans(data, at)
    hashes = np.concatenate([range_hash(prefix_sums(low[a:b]), start[i:j] - a, end[i:j] - a) for a, b, i, j in _blocks(start, at)]) if len(start) else np.zeros(0, np.uint64)
    _, word = distinct(low, start, end, hashes)
    word = word.astype(np.int32)
    flat, first, length, out_at = shingle_hashes(hashes, np.searchsorted(start, at), size)
    register = registers(flat, out_at) if estimated else np.zeros((0, BANDS * ROWS), np.uint16)
    leader, shingle = grouped(flat)
    del flat, low, hashes
    of = leader.astype(np.int32)[shingle]
    same = length == length[of]
    padded = np.append(word, np.zeros(size, word.dtype))
    for k in range(size):
        same &= (k >= length) | (padded[first + k] == padded[first[of] + k])
    if not same.all():
        apart: dict[tuple[int, ...], int] = {}
        for i in np.flatnonzero(~same).tolist():
            shingle[i] = apart.setdefault(tuple(word[first[i] : first[i] + length[i]].tolist()), len(leader) + len(apart))
    return *sorted_sets(shingle.astype(np.uint64), out_at), register


def _blocks(start: np.ndarray, at: np.ndarray):
    """Runs of documents of about SLICE_BYTES: first byte, end, first word, end of words."""
    row, n = 0, len(at) - 1
    word_at = np.searchsorted(start, at)
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + SLICE_BYTES, side="right")) - 1)
        yield int(at[row]), int(at[end]), int(word_at[row]), int(word_at[end])
        row = end


def sorted_sets(flat: np.ndarray, out_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sets, kept = [], np.zeros(len(out_at) - 1, np.int64)
    for d, (a, b) in enumerate(zip(out_at[:-1].tolist(), out_at[1:].tolist(), strict=True)):
        if b > a:
            x = np.sort(flat[a:b])
            x = x[np.concatenate([[True], x[1:] != x[:-1]])]
            kept[d] = len(x)
            sets.append(x)
    return (np.concatenate(sets) if sets else flat[:0]), np.concatenate([[0], np.cumsum(kept)])


def compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros of 32-bit minima with the MANTISSA bits after the first one; EMPTY where no shingle fell."""
    fraction, exponent = np.frexp(least.astype(np.float64))
    register = (32 - exponent) * (1 << MANTISSA) + ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    register = np.where(least == 0, 33 << MANTISSA, register)
    return np.where(least == np.uint64(0xFFFFFFFF), EMPTY, register).astype(np.uint16)


def registers(sets: np.ndarray, at: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """bands * rows registers of each document. Each band hashes anew and deals the shingles to its buckets."""
    n = len(at) - 1
    out = np.empty((n, bands * rows), np.uint16)
    base = np.repeat(np.arange(n) * rows, np.diff(at))
    for band in range(bands):
        x = sets * _SPREAD[2 * band]
        x ^= x >> np.uint64(29)
        x *= _SPREAD[2 * band + 1]
        bucket = (((x & np.uint64(0xFFFFFF)) * np.uint64(rows)) >> np.uint64(24)).astype(np.int64)
        least = np.full(n * rows, 0xFFFFFFFF, np.uint64)
        np.minimum.at(least, base + bucket, x >> np.uint64(32))
        out[:, band * rows : (band + 1) * rows] = compress(least).reshape(n, rows)
    return out


def band_keys(register: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of each band of each document."""
    x = register.astype(np.uint64).reshape(len(register), bands, rows)
    return mix((x * _SPREAD[:rows]).sum(2, dtype=np.uint64) + (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * _SPREAD[rows + 1]).view(np.int64)


@lru_cache(maxsize=1)
def _register_shares() -> tuple[np.ndarray, np.ndarray]:
    """Loads of a bucket and, for each, the chance of every register value."""
    loads = 2.0 ** np.arange(-3, 22)
    lz = np.arange(0, 33)[:, None]
    low = 2.0 ** (31.0 - lz) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA)) / 2**32
    step = 2.0 ** (31.0 - lz) / (1 << MANTISSA) / 2**32
    low, high = low.ravel(), np.minimum(1, (low + step).ravel())
    share = np.stack([np.exp(-n * low) - np.exp(-n * high) for n in loads])
    return loads, share


@lru_cache(maxsize=1)
def _collisions() -> np.ndarray:
    _, share = _register_shares()
    return share @ share.T


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Jaccard estimates of pairs of documents from their registers, less the expected share of chance collisions."""
    loads, _ = _register_shares()
    place = lambda n: np.clip(np.rint(np.log2(np.maximum(n, 1) / rows)) + 3, 0, len(loads) - 1).astype(int)
    chance = _collisions()[place(n_a), place(n_b)]
    used = (a != EMPTY) | (b != EMPTY)
    share = ((a == b) & used).sum(1) / np.maximum(used.sum(1), 1)
    return (share - chance) / (1 - chance)
