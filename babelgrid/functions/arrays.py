"""List columns as flat numpy arrays, for Arrow functions.

Spark interprets the lambdas of higher-order functions, element by element; an
Arrow function sees a batch of lists as one array of elements and one of
offsets, and works on all of them at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def ragged(a: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of a batch of lists, and where each list begins (one more at the end); a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
    return a.flatten(), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def to_lists(values: pa.Array, offsets: np.ndarray, null: pa.Array | None = None) -> pa.Array:
    """The reverse of ``ragged``; rows where ``null`` is true are null."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=null)


def row_of(offsets: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
    """The list that each element is in, or that those at ``places`` are in."""
    if places is None:
        return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return np.searchsorted(offsets, places, "right") - 1


def place_of(offsets: np.ndarray) -> np.ndarray:
    """The place of each element in its list."""
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))


def firsts(offsets: np.ndarray) -> np.ndarray:
    """Whether an element is the first of its list."""
    out = np.zeros(offsets[-1], bool)
    out[offsets[:-1][np.diff(offsets) > 0]] = True
    return out


def count_true(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many elements of each list are marked."""
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])


def ints(values: pa.Array, missing: int) -> np.ndarray:
    """Integers in their own width, ``missing`` where null."""
    return (values.fill_null(missing) if values.null_count else values).to_numpy(zero_copy_only=False)
