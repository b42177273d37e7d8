"""Arrow batches of a sorted partition, cut only between groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that never split a group of equal ``keys``.

    The partition must be sorted by ``keys``. No more than ``rows`` rows and one group are held at a time.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            whole = pa.Table.from_batches(held).combine_chunks()
            cut = _last_start(whole, keys)
            if cut:
                yield whole.slice(0, cut).combine_chunks()
            rest = whole.slice(cut).combine_chunks()
            held, n = rest.to_batches(), rest.num_rows
            rows = max(rows, 2 * n)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _last_start(t: pa.Table, keys: list[str]) -> int:
    """Where the last group of ``t`` begins."""
    same = np.ones(t.num_rows, bool)
    for k in keys:
        c = t[k].combine_chunks()
        last = c[len(c) - 1]
        eq = pc.is_null(c) if not last.is_valid else pc.fill_null(pc.equal(c, last), False)
        same &= np.asarray(eq)
    return int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0


def group_codes(t: pa.Table, keys: list[str]) -> np.ndarray:
    """A number per row that grows by one where the ``keys`` of a sorted table change."""
    new = np.zeros(t.num_rows, bool)
    for k in keys:
        c = t[k]
        c = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).dictionary_encode()
        codes = np.asarray(c.indices.fill_null(-1))
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)
