"""Runs of bytes in flat text buffers, as Arrow arrays: exact terms without a Python object for each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the maximal runs of member bytes; a run ends with its row."""
    if not len(member):
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing
    begins = offsets[:-1][np.diff(offsets) > 0]
    first = np.zeros(len(member) + 1, bool)
    first[begins] = True
    first[-1] = True
    before = np.r_[False, member[:-1]] & ~first[:-1]
    after = np.r_[member[1:], False] & ~first[1:]
    start = np.flatnonzero(member & ~before)
    end = np.flatnonzero(member & ~after) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def gather(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places of the given ranges, end to end."""
    first = np.cumsum(length) - length
    return np.repeat(start - first, length) + np.arange(int(length.sum()))


def as_array(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.LargeBinaryArray:
    """The given ranges of a byte buffer as an array of binary values."""
    length = end - start
    offsets = np.r_[0, np.cumsum(length)].astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[gather(start, length)]))])


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
