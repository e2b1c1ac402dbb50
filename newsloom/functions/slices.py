"""Arrow columns of texts, a few megabytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20


def by_bytes(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of a column of texts, of about ``most`` bytes or one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most)) + 1
    for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(texts)]):
        if end > start:
            yield texts.slice(start, end - start)
