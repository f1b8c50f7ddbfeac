"""Arrow arrays worked through a few rows at a time: a batch's texts are never all Python objects at once."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

ROWS = 128


def by_slices(work: Callable[..., pa.Array], kind: pa.DataType, *arrays: pa.Array) -> pa.Array:
    """work over slices of arrays of equal length, its results put together."""
    parts = [work(*(a.slice(at, ROWS) for a in arrays)) for at in range(0, len(arrays[0]), ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)
