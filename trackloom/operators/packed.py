"""Several values packed in one field: quote parity and delimiter masks over Arrow string buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_POW = 10 ** np.arange(19, dtype=np.int64)


def number_lists(strings: pa.Array) -> pa.ListArray:
    """The numbers written in each string, in order, as a list array; NULL and strings without numbers give [].

    Any character that is no digit delimits. Exceptions: inside a pair of double quotes a comma between 1 to 3 digits and groups of
    exactly 3 digits groups thousands ("12,067" is 12067); a decimal point followed by zeros alone belongs to its
    number (19.0 is 19). Leading zeros do not count. Zero and numbers beyond an int name nothing and are left out.
    """
    strings = strings.cast(pa.large_string()).fill_null("")
    n = len(strings)
    _, off_buf, data = strings.buffers()
    off = np.frombuffer(off_buf, np.int64, n + 1, strings.offset * 8)
    base, end = int(off[0]), int(off[-1])
    lists = np.zeros(n + 1, np.int32)
    if base == end:
        return pa.ListArray.from_arrays(pa.array(lists), pa.array([], pa.int32()))
    b = np.frombuffer(data, np.uint8)[base:end]
    off = off - base
    m = len(b)
    row = np.repeat(np.arange(n), np.diff(off))
    digit = (b >= 48) & (b <= 57)
    start = np.zeros(m + 1, bool)
    start[off[:-1]] = True  # nothing joins over a row's edge
    start[off[-1]] = True
    edge = start[:-1]
    before = np.zeros(m, bool)
    before[1:] = digit[:-1]
    before &= ~edge
    # digit runs
    first = digit & ~before
    run = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    last = digit & np.append(~digit[1:] | start[1:-1], True)
    stop = np.flatnonzero(last) + 1
    size = stop - begin
    # quote parity from the row's start
    quotes = np.cumsum(b == 34)
    at_row = np.concatenate([[0], quotes])[off[:-1]]
    inside = ((quotes - at_row[row]) & 1).astype(bool)
    follows = np.zeros(len(begin), bool)  # run i+1 begins right after the one character after run i, in the same row
    follows[:-1] = (begin[1:] == stop[:-1] + 1) & (row[begin[1:]] == row[begin[:-1]])
    sep = np.where(follows, b[np.minimum(stop, m - 1)], 0)
    grouped = (sep == 44) & inside[begin] & np.append(size[1:] == 3, False)
    lead = np.append(False, grouped[:-1])
    grouped &= np.where(lead, size == 3, size <= 3)
    head = ~np.append(False, grouped[:-1])  # a group stands only behind a number's head or another group
    zero = np.add.reduceat((b != 48).astype(np.int64) * digit, begin)[: len(begin)] == 0 if len(begin) else np.zeros(0, bool)
    if not len(begin):
        return pa.ListArray.from_arrays(pa.array(lists), pa.array([], pa.int32()))
    fraction = np.append(False, (sep == 46)[:-1]) & zero & head
    # digits of a number: those of its head and its groups
    member = ~fraction
    number = np.cumsum(head & member) - 1
    d_at = np.flatnonzero(digit)
    d_run = run[d_at]
    ok = member[d_run]
    d_at, d_num = d_at[ok], number[d_run[ok]]
    ends = np.append(np.flatnonzero(np.diff(d_num)) + 1, len(d_num))
    place = ends[d_num] - 1 - np.arange(len(d_num))
    value = b[d_at].astype(np.int64) - 48
    starts = np.append(0, ends[:-1])
    huge = np.add.reduceat(((value > 0) & (place > 9)).astype(np.int64), starts) > 0
    value = np.add.reduceat(value * _POW[np.minimum(place, 18)] * (place <= 18), starts)
    keep = ~huge & (value > 0) & (value < 1 << 31)
    of = row[begin[head & member]][keep]
    np.cumsum(np.bincount(of, minlength=n), out=lists[1:])
    return pa.ListArray.from_arrays(pa.array(lists), pa.array(value[keep].astype(np.int32)))


def _flatten(column: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = b.column(column).dictionary_encode()
            lists = number_lists(packed.dictionary).take(packed.indices)
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            parent = pa.array(np.repeat(np.arange(len(size)), size))
            ordinal = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + 1
            rest = [(n, b.column(i).take(parent)) for i, n in enumerate(b.schema.names) if i != column]
            yield pa.RecordBatch.from_arrays([x for _, x in rest] + [pa.array(ordinal.astype(np.int32)), lists.flatten()], names=[n for n, _ in rest] + ["pos", "child_id"])

    return run


def split_numbers(df: DataFrame, keep: list[str], packed: str) -> DataFrame:
    """One row per number in ``packed``: the columns ``keep``, ``pos`` (from 1, in the order written) and ``child_id``.

    See ``number_lists`` for the notations. Rows without a number (NULL, empty, words) give no row; repeated rows are kept.
    ``keep`` may not hold ``pos`` or ``child_id``. Nothing is shuffled.
    """
    if {"pos", "child_id"} & set(keep):
        raise ValueError("keep may not hold pos or child_id")
    d = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{packed}`").cast("string").alias("_packed"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1])
    return d.mapInArrow(_flatten(len(keep)), f"{schema}, pos int, child_id int")
