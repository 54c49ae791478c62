"""Words and hashes of whole text columns, computed in numpy over Arrow buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is the same on UTF-8 bytes and on code
points. Everything works on chunks of about a megabyte, so that a task's memory does not depend on its batch size;
a single longer text makes one chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1_000_000  # just below a power of two, as tables of powers are rounded up to one
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
BYTE_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
WORD_BASES = (np.uint64(0xD1B54A32D192ED03), np.uint64(0xA0761D6478BD642F))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Words(NamedTuple):
    """Words of a chunk of texts. ``first`` has one entry more than there are texts."""

    data: np.ndarray  # uint8, all texts
    offsets: np.ndarray  # of the texts in data
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # index of each text's first word
    text: np.ndarray  # index of each word's text


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n, kept for later calls."""
    key, wanted = int(base), n
    have = _powers.get(key)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        n = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(key, -1, 1 << 64))
        both = []
        for b in (base, inverse):
            a = np.full(n, b, np.uint64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        have = _powers[key] = (both[0], both[1])
    return have[0][:wanted], have[1][:wanted]


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most about ``limit`` bytes of ``column``, its nulls made empty strings."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0), np.int64))
        begin = 0
        while begin < batch.num_rows:
            done = ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(ends, done + limit, side="right")))
            part = batch.slice(begin, stop - begin)
            text = pc.fill_null(part.column(at).cast(pa.large_string()), "")  # of the slice: a batch is never copied whole
            yield pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(part.columns)], names=part.schema.names)
            begin = stop


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its n + 1 offsets in them, starting at 0."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def find_words(column: pa.Array, separator: np.ndarray = SEPARATOR, folded: np.ndarray | None = None) -> Words:
    """``folded`` is a table of 256 bytes that the data goes through first."""
    data, offsets = bytes_of(column)
    data = data if folded is None else folded[data]
    inside = ~separator[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]  # where a text that isn't empty starts
    before[edge] = False
    after[edge[edge > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    return Words(data, offsets, start, end, first, np.repeat(np.arange(len(offsets) - 1), np.diff(first)))


LONG = 128  # bytes; some texts that are much longer have equal polynomials modulo 2**64 whatever the base


class Spans:
    """64-bit hashes of any spans of bytes: by differences of prefix sums, of spans over LONG bytes by XXH3 of the bytes."""

    def __init__(self, data: np.ndarray):
        self.data = np.ascontiguousarray(data)
        self.power, self.inverse = powers(BYTE_BASE, len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:-1], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = mix((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64))
        for i in np.flatnonzero(end - start > LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[start[i] : end[i]])
        return out


def word_hashes(words: Words) -> np.ndarray:
    return Spans(words.data).of(words.start, words.end)


class Runs:
    """Hashes of any runs of consecutive words, by differences of prefix sums. ``lane`` 0 and 1 are independent."""

    def __init__(self, hashes: np.ndarray, lane: int = 0):
        self.power, self.inverse = powers(WORD_BASES[lane], len(hashes) + 1)
        self.total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum((hashes if lane == 0 else mix(hashes + np.uint64(lane))) * self.power[:-1], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of words start .. end - 1; equal runs of equal length have equal hashes."""
        return mix((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def windows(words: Words, n: int) -> np.ndarray:
    """Indexes of the words at which n consecutive words of one text start."""
    if len(words.start) < n:
        return np.zeros(0, np.int64)
    return np.flatnonzero(words.text[: len(words.text) - n + 1] == words.text[n - 1 :])


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a window of n words that starts at one of ``starts``."""
    change = np.zeros(total + n + 1, np.int64)
    np.add.at(change, starts, 1) if len(starts) != len(np.unique(starts)) else change.__setitem__(starts, 1)
    change[n:] -= change[:-n].copy()
    return np.cumsum(change)[:total] > 0


def per_text(words: Words, values: np.ndarray) -> np.ndarray:
    """Sums of one value a word over each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[words.first[1:]] - total[words.first[:-1]]


def code_points(data: np.ndarray) -> np.ndarray:
    """Prefix counts of code points: how many start before each byte."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=total[1:])
    return total
