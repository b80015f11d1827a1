"""Array functions that the built-in ones can only express in quadratic time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _bounds(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0], lists.flatten().to_numpy(zero_copy_only=False)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def sums_before(lengths: pa.Array) -> pa.Array:
    """For every item of an array of numbers the sum of the items before it."""
    bounds, flat = _bounds(lengths)
    sums = np.concatenate(([0], np.cumsum(flat, dtype=np.int64)))
    own = sums[:-1] - np.repeat(sums[bounds[:-1]], np.diff(bounds))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(own, pa.int32()))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def merge_marks(starts: pa.Array, sizes: pa.Array) -> pa.Array:
    """Marks of a sentence's ``sizes`` tokens: 1 where a phrase begins, 2 where it ends, 0 elsewhere.

    Phrases are pairs of neighbours at ``starts`` and are taken from the left; a token is in one at most.
    """
    out = []
    for found, size in zip(starts, sizes.to_pylist(), strict=True):
        marks = np.zeros(size or 0, dtype=np.int32)
        for i in sorted(found.as_py() or ()):
            if not marks[i]:
                marks[i], marks[i + 1] = 1, 2
        out.append(marks)
    return pa.array(out, pa.list_(pa.int32()))
