"""Groups of a sorted partition, handed over one after another without collecting the partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def key_runs(batches: Iterator[pa.RecordBatch], least: int = 2) -> Iterator[pa.RecordBatch]:
    """Runs of equal values in the first column, of `least` rows or more, across the bounds of batches."""
    held: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None and held.num_rows:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        key = b.column(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.concatenate((starts[1:], [len(key)]))
        for s, e in zip(starts[:-1], ends[:-1], strict=True):
            if e - s >= least:
                yield b.slice(s, e - s)
        held = b.slice(starts[-1])
    if held is not None and held.num_rows >= least:
        yield held
