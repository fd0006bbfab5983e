"""Arrow batches in parts of bounded size, so that a worker's memory does not follow a batch's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are Python objects at once.
PART = 1 << 20


def parts(texts: pa.Array, size: int = PART) -> Iterator[slice]:
    """Consecutive rows with at most ``size`` bytes of text; a longer text is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield slice(at, stop)
        at = stop
