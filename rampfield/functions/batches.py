"""Array columns of an Arrow batch as numpy arrays and back."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the rows of an array column, and all values with NaN for NULL."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = column.offsets.to_numpy(zero_copy_only=False)[:-1].astype(np.int64)
    return starts, lengths, column.values.to_numpy(zero_copy_only=False)


def places(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place among all values) of every element of the rows."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    return row, np.arange(len(row)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def as_lists(values: np.ndarray, lengths: np.ndarray, absent: np.ndarray | None = None) -> pa.Array:
    """Consecutive values as rows of the given lengths; rows in ``absent`` are NULL."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=None if absent is None else pa.array(absent))


def medians(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Medians of consecutive values dealt into rows of the given lengths, none of them empty."""
    ordered = values[np.lexsort((values, np.repeat(np.arange(len(lengths)), lengths)))]
    begin = np.cumsum(lengths) - lengths
    return (ordered[begin + (lengths - 1) // 2] + ordered[begin + lengths // 2]) / 2


def steps(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Differences of neighbours in the same row; a row has one fewer than values."""
    inside = np.ones(len(values), bool)
    inside[np.cumsum(lengths) - lengths] = False
    return np.diff(values, prepend=0.0)[inside]
