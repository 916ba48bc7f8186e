"""Arrow batches of texts taken a few at a time, so that a task's memory does not grow with its batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

# Texts parsed together inside a batch: their parsed form takes many times their bytes.
PIECE_BYTES = 256 << 10


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """First row and number of rows of runs of texts with at most ``limit`` bytes, or one longer text."""
    start = total = 0
    for i, size in enumerate(pc.binary_length(texts).to_pylist()):
        if i > start and total + (size or 0) > limit:
            yield start, i - start
            start, total = i, 0
        total += size or 0
    yield start, len(texts) - start


def by_pieces(build: Callable[..., pa.Array], texts: pa.Array, *others: pa.Array) -> pa.Array:
    """``build`` applied to the lists of each piece; only its Arrow form is kept."""
    return pa.concat_arrays([build(*(x.slice(start, n).to_pylist() for x in (texts, *others))) for start, n in pieces(texts)])
