"""Words, word hashes and hashes of runs of words, for many texts at once, in numpy and Arrow.

A word is a run of characters other than space and U+0009 to U+000D.  UTF-8 keeps ASCII bytes apart
from all others, so words are found on bytes.  A word's hash is XXH3 (64 bits) of its bytes, worked out
once for each distinct word of a batch.  The hash of a run of words is a sum of its words' hashes times powers
of an odd number, then mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
NARROW, WIDE = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_KEPT: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept between calls while short."""
    have = _KEPT.get(base)
    if have is None or len(have) <= n:
        have = _powers(base, max(n, 1 << 16))
        if len(have) <= 1 << 20:
            _KEPT[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


@dataclass
class Words:
    """start and end: each word's bytes in data; first: each text's first word, and the end; hash: each word's hash."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    hash: np.ndarray


def run_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Sums of values[i] * base**(i - start) over start <= i < end, modulo 2**64."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values))[: len(values)], out=total[1:])
    back = powers(pow(base, -1, 2**64), len(values))
    return (total[end] - total[start]) * back[start]


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(code of each word from start to end, the distinct words); data has the words' bytes alone."""
    if not len(start):
        return np.zeros(0, np.int64), []
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=at[1:])
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(data)])
    coded = column.dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary.to_pylist()


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each word from start to end; data has the words' bytes alone.  Distinct words are told apart by their bytes."""
    codes, words = word_codes(data, start, end)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[codes]


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all texts' bytes side by side, where each begins and the end); a null text has none."""
    texts = texts.fill_null("").cast(pa.large_string())
    offset = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    body = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(body, dtype=np.uint8)[offset[0] : offset[-1]] if body is not None and offset[-1] > offset[0] else np.zeros(0, np.uint8)
    return raw, offset - offset[0]


def bounds(inside: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each run of bytes inside words; texts begin at offset and no run crosses from one to the next."""
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offset[:-1][np.diff(offset) > 0]
    begins[heads] = inside[heads]  # texts stand side by side
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    tails = offset[1:][np.diff(offset) > 0] - 1
    ends[tails] = inside[tails]
    return start, np.flatnonzero(ends) + 1


def split(texts: pa.Array, lower: bool = False) -> Words:
    """The words of each text; a null text has none."""
    raw, offset = raw_bytes(texts)
    inside = ~_BLANK[raw]
    start, end = bounds(inside, offset)
    return Words(raw, start, end, np.searchsorted(start, offset), offset, word_hashes(LOWER[raw[inside]] if lower else raw[inside], start, end))


def runs(w: Words, k: int, base: int = NARROW) -> tuple[np.ndarray, np.ndarray]:
    """(at, hash): each place where k words of one text begin, and the hash of these words."""
    n = len(w.hash)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - k + 1)
    h = mix(run_sums(w.hash, at, at + k, base))
    last = np.repeat(w.first[1:], np.diff(w.first))
    ok = at + k <= last[: n - k + 1]
    return at[ok], h[ok]


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of k words; the whole text as one where it has fewer; empty without words."""
    at, h = runs(w, k)
    lo = np.searchsorted(at, w.first)
    count = np.diff(w.first)
    out = []
    for i in range(len(count)):
        if count[i] >= k:
            out.append(np.unique(h[lo[i] : lo[i + 1]]))
        elif count[i]:
            a, b = w.first[i], w.first[i + 1]
            out.append(mix(run_sums(w.hash[a:b], np.zeros(1, np.int64), np.array([b - a]), NARROW) + _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
