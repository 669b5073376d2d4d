"""Word hashes of whole Arrow batches with numpy: no Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes that are hashed at a time; a longer text is cut between words, so only a longer word is hashed as a whole.
STEP = 1 << 20


class Words(NamedTuple):
    """Words of the texts ``first`` to ``first + len(starts) - 1`` of a batch: their hashes, and where each text's
    words start (one more entry than texts)."""

    first: int
    hashes: np.ndarray
    starts: np.ndarray


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for bytes outside all the given ranges (both ends included): the bytes of words."""
    out = np.ones(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = False
    return out


#: `[^\x20\x09-\x0D]+` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lower-casing).
SPACED = byte_class((0x09, 0x0D), (0x20, 0x20))
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return lower, mix(np.arange(1, 257, dtype=U64))[lower]


_powers: list[np.ndarray] = [np.empty(0, U64), np.empty(0, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n at least; those up to ``STEP`` are kept."""

    def table(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, U64)
        out[0] = 1
        return np.cumprod(out, dtype=U64)

    if n > STEP:
        return table(_BASE, n + 1), table(_INVERSE, n + 1)
    if not len(_powers[0]):
        _powers[:] = [table(_BASE, STEP + 1), table(_INVERSE, STEP + 1)]
    return _powers[0], _powers[1]


def _hash_words(data: np.ndarray, text_starts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``data`` and where each text's words start. Texts are adjacent; no word spans two."""
    n = len(data)
    if n == 0:
        return np.empty(0, U64), np.zeros(len(text_starts), np.int64)
    lower, codes = _tables()
    word = inside[lower[data]]
    begins = np.empty(n, bool)
    begins[0] = word[0]
    np.logical_and(word[1:], ~word[:-1], out=begins[1:])
    ends = np.empty(n, bool)
    ends[-1] = word[-1]
    np.logical_and(word[:-1], ~word[1:], out=ends[:-1])
    cuts = text_starts[(text_starts > 0) & (text_starts < n)]
    begins[cuts] = word[cuts]
    ends[cuts - 1] = word[cuts - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power_tables(n)
    sums = np.zeros(n + 1, U64)
    np.cumsum(codes[data] * up[:n], out=sums[1:])
    return mix((sums[e] - sums[s]) * down[s]), np.searchsorted(s, text_starts)


def _long_text(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Word hashes of one text of more than ``STEP`` bytes, piece by piece."""
    lower, _ = _tables()
    out, at, n = [], 0, len(data)
    while at < n:
        upto = min(at + STEP, n)
        if upto < n:
            gaps = np.flatnonzero(~inside[lower[data[at:upto]]])
            if len(gaps):
                upto = at + int(gaps[-1]) + 1
            while upto < n and not len(gaps):  # a word goes on: to its end
                gaps = np.flatnonzero(~inside[lower[data[upto : upto + STEP]]])
                upto = upto + int(gaps[0]) + 1 if len(gaps) else min(upto + STEP, n)
        out.append(_hash_words(data[at:upto], np.array([0, upto - at]), inside)[0])
        at = upto
    return np.concatenate(out)


def hashed(texts: pa.Array, inside: np.ndarray) -> Iterator[Words]:
    """Words of all texts of a string array, some ``STEP`` bytes at a time; null has no words."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP, "right")) - 1)
        piece = data[offsets[at] : offsets[upto]]
        if len(piece) > STEP:
            hashes = _long_text(piece, inside)
            starts = np.array([0, len(hashes)])
        else:
            hashes, starts = _hash_words(piece, offsets[at : upto + 1] - offsets[at], inside)
        yield Words(at, hashes, starts)
        at = upto


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    out = words[:n].copy()
    for k in range(1, width):
        out = out * U64(0xD6E8FEB86659FD93) + words[k : k + n]
    return mix(out)
