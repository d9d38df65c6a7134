"""Vectorised helpers over Arrow string columns, used inside Spark tasks.

An Arrow string column already holds all its texts as one UTF-8 buffer with offsets, so
words, hashes and n-grams come from a few numpy passes over that buffer, without a Python
object per text. Work goes in chunks of about a quarter of a megabyte, which suits the caches and bounds a task's memory
by the longest text and not by the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240131)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

#: The six ASCII white-space characters: words are runs of anything else.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets into them; a null is an empty text."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = 1 << 18, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) for runs of whole texts of about ``limit`` bytes, and at most ``rows`` texts.

    ``bounds`` has the start of each text within the bytes, and the end as its last entry.
    A text above the limit makes a chunk of its own.
    """
    if len(column) == 0:
        return
    data, offsets = buffer_of(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, lo + rows, len(column))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n+1 entries).

    ``inside`` marks the bytes that belong to words; by default all but ASCII white space.
    """
    inside = ~SPACE[data] if inside is None else inside
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds), np.int64)
    full = bounds[:-1] < bounds[1:]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[bounds[:-1][full]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[bounds[1:][full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def _reach(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers))
        for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte code times position power, modulo 2^64; the hash of any span follows from two of them."""
    _reach(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers[: len(data)], dtype=np.uint64, out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal bytes have equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _inverses[starts])


#: Words above so many bytes are hashed one by one: sums of powers modulo 2^64 are equal for some words of two letters (Thue-Morse) from about a thousand bytes on, whatever the base.
LONG_WORD = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = 1 << 20) -> np.ndarray:
    """Hashes of words in order, in slices of about ``limit`` bytes, so that the sums of a very long text are never held at once."""
    if len(data) <= limit:
        out = span_hashes(prefix_sums(data), starts, ends)
    else:
        out, lo = np.empty(len(starts), np.uint64), 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + limit, "right")))
            sums = prefix_sums(data[starts[lo] : ends[hi - 1]])
            out[lo:hi] = span_hashes(sums, starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo])
            lo = hi
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


def slices(data: np.ndarray, limit: int = 1 << 20) -> Iterator[np.ndarray]:
    """A text's bytes in runs of about ``limit``, cut behind white space, so that no word is cut."""
    lo = 0
    while lo < len(data):
        hi = min(lo + limit, len(data))
        while hi < len(data):
            gap = np.flatnonzero(SPACE[data[max(lo, hi - limit) : hi]])
            if len(gap):
                hi = max(lo, hi - limit) + int(gap[-1]) + 1
                break
            hi = min(hi + limit, len(data))  # a word longer than the limit goes on
        yield data[lo:hi]
        lo = hi


def owner(first: np.ndarray) -> np.ndarray:
    """For each word the index of its text, from the first words of the texts."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
