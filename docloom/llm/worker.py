"""What Python workers keep between tasks, and small numpy helpers for ragged arrays."""

import ctypes
import functools
import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text that a task works on at once: what is made of them takes some ten to a hundred times the room.
CHARS = 1 << 20


def kept(key, make):
    """make() once per Python worker: tasks that run later in the same worker get the same object.

    A cache of tables that are costly to build; a result never depends on what is in it.
    """
    store = sys.modules.setdefault("_docloom_kept", types.ModuleType("_docloom_kept")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def freeing(run: Callable) -> Callable:
    """run, with what it held given back to the system when its task ends: workers live on, for tasks of other kinds."""

    @functools.wraps(run)
    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of GNU's library
        if trim:
            trim(0)

    return outer


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Where each piece starts when pieces of these lengths stand one after another."""
    out = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=out[1:])
    return out


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the pieces [start, start + length), one after another."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    return np.repeat(starts - starts_of(lengths), lengths) + np.arange(total)


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each consecutive piece of these lengths."""
    ends = np.concatenate([[0], np.cumsum(values)])
    cut = np.concatenate([[0], np.cumsum(lengths)])
    return ends[cut[1:]] - ends[cut[:-1]]


def parts(batch: pa.RecordBatch, sizes: pa.Array, most: int = CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose sizes sum to at most so much, but of a row at least; nothing of an empty batch."""
    total = np.cumsum(np.asarray(pc.fill_null(sizes, 0)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def text_parts(batches: Iterator[pa.RecordBatch], column: int, most: int = CHARS) -> Iterator[pa.RecordBatch]:
    """All rows in slices of about so many characters in a column of texts."""
    for batch in batches:
        yield from parts(batch, pc.utf8_length(batch.column(column)), most)
