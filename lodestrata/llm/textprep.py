"""Vectorised splitting of Arrow text columns at the byte level.

All word classes used here treat every byte from 0x80 upwards as part of a word, so splitting UTF-8 bytes gives the
words that splitting code points gives.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20


def _table(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
ALNUM = _table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: Words ``[^\x20\x09-\x0D]+``.
NON_SPACE = _table(lambda b: b != 32 and not 9 <= b <= 13)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row offsets into them (from 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    if data is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def release_unused() -> None:
    """Give freed memory back to the system: workers are used again by later stages, beside a JVM that may have grown."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Whole rows in pieces of about ``limit`` bytes of text, so that working arrays stay bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = raw(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
        del batch, offs
    release_unused()


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A string column over consecutive byte runs."""
    offs = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offs[1:])
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data)))


class Words:
    """Words of each row: ``start``/``end`` byte places, and ``first`` so that row i has words first[i]:first[i+1]."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, table: np.ndarray):
        n = len(buf)
        mask = table[buf] if n else np.zeros(0, bool)
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        begin, stop = mask.copy(), mask.copy()
        if n:
            begin[1:] &= ~mask[:-1] | edge[1:n]
            stop[:-1] &= ~mask[1:] | edge[1:n]
        self.buf, self.mask = buf, mask
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offs)

    def __len__(self) -> int:
        return len(self.start)

    def column(self) -> pa.Array:
        return strings(self.buf[self.mask], self.end - self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def index_in(column: pa.Array, values: list[str] | pa.Array) -> np.ndarray:
    """The place of each string in ``values``, or -1."""
    if not len(column) or not len(values):
        return np.full(len(column), -1, np.int64)
    found = pc.index_in(column, value_set=values if isinstance(values, pa.Array) else pa.array(values, pa.string()))
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def gather_ranges(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of consecutive ranges, and the offsets of each range in them."""
    offs = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=offs[1:])
    index = np.repeat(start - offs[:-1], length)
    index += np.arange(offs[-1])
    return index, offs
