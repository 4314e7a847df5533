"""Whole texts as numpy arrays: words, lines and their 64-bit hashes.

Everything works on UTF-8 bytes of many texts laid end to end, so the cost a
byte is a few vectorised passes whatever the texts look like.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(7)
#: A random odd number for each byte and each place in a word.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = 1 << 16
PLACE = _rng.integers(1, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def free_name(taken: list[str], name: str) -> str:
    """``name``, lengthened until no column in ``taken`` has it in any case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """``run`` over a task's batches, after which the worker waits for its next task without the memory of this one."""

    @wraps(run)
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return outer


def text_parts(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first row, end row, bytes, offsets`` of stretches of about ``most`` bytes; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of a stretch: place, length, row and hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE):
        held = ~gap[data]
        at = np.flatnonzero(held)
        if not len(at):
            self.start = self.size = self.row = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
        else:
            first = np.empty(len(at), bool)
            first[0] = True
            first[1:] = np.diff(at) > 1
            edges = np.zeros(len(data) + 1, bool)
            edges[offsets] = True
            first |= edges[at]
            head = np.flatnonzero(first)
            self.start = at[head]
            self.size = np.diff(np.append(head, len(at)))
            self.row = np.searchsorted(offsets, self.start, "right") - 1
            place = np.arange(len(at)) - np.repeat(head, self.size)
            if self.size.max() > PLACES:
                place %= PLACES
            self.hash = mix(np.add.reduceat(BYTE[data[at]] * PLACE[place], head) + self.size.astype(np.uint64))
        #: words of each row: ``first[r]`` to ``first[r + 1]``
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``row, hash`` of each run of ``n`` words; a row with fewer words has one run of all of them."""
    count = np.diff(words.first)
    h = np.zeros(len(words.hash), np.uint64)
    odd = [np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64) for k in range(n)]
    for k in range(min(n, len(h))):
        h[: len(h) - k] += mix(words.hash[k:] * odd[k])
    left = np.repeat(words.first[1:], count) - np.arange(len(h))  # words from here to the row's end
    whole = left >= n
    row, value = words.row[whole], mix(h[whole])
    for r in np.flatnonzero((count > 0) & (count < n)):
        x = np.array([count[r]], np.uint64)
        for k in range(count[r]):
            x += mix(words.hash[words.first[r] + k : words.first[r] + k + 1] * odd[k])
        row, value = np.append(row, r), np.append(value, mix(x ^ np.uint64(0x5555555555555555)))
    return row, value


def distinct_runs(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each row, sorted by row and value, and how often each occurs."""
    order = np.argsort(value)
    narrow = row[order].astype(np.uint16 if len(row) == 0 or row.max() < 1 << 16 else np.int64)
    order = order[np.argsort(narrow, kind="stable")]
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (value[1:] != value[:-1])
    head = np.flatnonzero(new)
    return row[head], value[head], np.diff(np.append(head, len(row)))
