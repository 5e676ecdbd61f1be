"""Arrow lists by numpy, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def sizes_of(lists: pa.Array) -> np.ndarray:
    """Elements of each list; 0 for null."""
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def group_lists(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct strings of lists, and for each element its number among them, its list and its place in it. Strings must not be null."""
    sizes, flat = sizes_of(lists), lists.flatten().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    return flat.dictionary, codes, row, np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def running_sums(lists: pa.Array) -> pa.Array:
    """Running sums within each list of 32-bit numbers; null lists stay null. Numbers must not be null."""
    sizes = sizes_of(lists)
    total = np.concatenate([[0], np.cumsum(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    sums = pa.array(total[1:] - np.repeat(total[ends[:-1]], sizes), pa.int32())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), sums, mask=lists.is_null() if lists.null_count else None)
