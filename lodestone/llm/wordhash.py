"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

Characters outside ASCII have no byte below 0x80, so rules on ASCII characters can be
applied to bytes. A word's hash is a polynomial of its bytes; all sums wrap at 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
SLICE_TEXTS = 50_000  # fits 16 bits, which sort fast

_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# letters a-z, digits and everything outside ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

# everything but blanks: space, tab, line feed, vertical tab, form feed, carriage return
UNSPACED = np.ones(256, dtype=bool)
UNSPACED[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
# factors of the words of a run, by place
_PLACES = [int(x) | 1 for x in mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))]

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """The base and its inverse, raised to 0 .. n, kept for the largest slice so far."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        _powers.clear()
        for base in (_BASE, _INVERSE):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of texts (nulls empty), and where each text starts and ends."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1)
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of whole texts of bounded size (one long text alone may be larger)."""
    raw, offsets = string_bytes(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        last = min(max(last, first + 1), first + SLICE_TEXTS, n)
        yield raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


@dataclass
class Words:
    """Words in order of the texts: hash, number of the text, and the first word of each text."""

    hashes: np.ndarray
    text: np.ndarray
    firsts: np.ndarray  # one more than texts: text i has the words firsts[i] to firsts[i + 1]
    starts: np.ndarray
    ends: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.firsts)

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return self.firsts[1:][self.text] - np.arange(len(self.text))

    def runs(self, k: int, at: np.ndarray | None = None, salt: int = 0) -> np.ndarray:
        """Hash of the ``k`` words from each position (of ``at``); the caller keeps inside texts."""
        if at is None:
            at = np.arange(max(0, len(self.hashes) - k + 1))
        total = np.full(len(at), k + 1000 * salt, dtype=np.uint64)
        for j in range(k):
            total += self.hashes[at + j] * np.uint64(_PLACES[(j + 17 * salt) % 64])
        return mix(total)


def words_of(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """The maximal runs of bytes that ``inside`` marks, after lowering A-Z."""
    lowered = LOWER[raw]
    member = np.zeros(len(raw) + 2, dtype=bool)
    member[1:-1] = inside[lowered]
    begins = np.zeros(len(raw) + 1, dtype=bool)
    begins[offsets] = True
    starts = np.flatnonzero(member[1:-1] & (~member[:-2] | begins[:-1]))
    ends = np.flatnonzero(member[1:-1] & (~member[2:] | begins[1:])) + 1
    power, inverse = _power_tables(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_LETTERS[lowered] * power[: len(raw)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    firsts = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    return Words(hashes, text, firsts, starts, ends)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An array of lists from their values, end to end, and their lengths."""
    ends = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
