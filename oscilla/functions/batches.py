"""Arrow columns of signals as matrices, one for each length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def row_sizes(column: pa.Array) -> np.ndarray:
    """Length of each signal, -1 for null."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.where(column.is_valid().to_numpy(zero_copy_only=False), lengths, -1)


#: Samples of one matrix, so that what is computed from it stays small.
SAMPLES = 1 << 19


def stacked(column: pa.Array, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the signals of each length above 0, about SAMPLES at a time."""
    column = column.cast(pa.large_list(pa.float64()))
    flat, at = column.values.to_numpy(zero_copy_only=False), np.asarray(column.offsets)[:-1]
    for size in np.unique(sizes[sizes > 0]):
        all_ = np.flatnonzero(sizes == size)
        few = max(1, SAMPLES // int(size))
        for k in range(0, len(all_), few):
            rows = all_[k : k + few]
            yield rows, flat[at[rows][:, None] + np.arange(size)]


def on_rows(column: pa.Array, f: Callable[[np.ndarray], np.ndarray | None]) -> pa.Array:
    """f on the signals of a column, stacked by length; f gives as many rows, or None for null."""
    sizes = row_sizes(column)
    out: list[np.ndarray | None] = [None] * len(column)
    for rows, x in stacked(column, sizes):
        made = f(x)
        if made is not None:
            for k, row in zip(rows, made, strict=True):
                out[k] = row
    for k in np.flatnonzero(sizes == 0):
        out[k] = np.zeros(0)
    return pa.array(out, pa.list_(pa.float64()))
