"""Consensus over several trackers: segments, groups by start and place, representatives, extension, renumbering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from ..functions.chunks import group_codes, whole_groups
from ..functions.ranks import numbered
from . import hierarchy


def segments(rows: DataFrame) -> DataFrame:
    """Unbroken runs of frames of each tracker's cells, with place and size at both ends.

    ``rows``: algorithm, fov, cell_id, frame, x, y, area, volume, label (boolean); one row per tracker, cell and frame.
    """
    w = Window.partitionBy("algorithm", "fov", "cell_id").orderBy("frame")
    d = rows.withColumn("island", F.col("frame") - F.row_number().over(w))
    at = lambda f, v, n: f(v, "frame").alias(n)
    return d.groupBy("algorithm", "fov", "cell_id", "island").agg(
        F.min("frame").alias("start"), F.max("frame").alias("end"), F.count(F.lit(1)).alias("n"), at(F.min_by, "x", "x0"), at(F.min_by, "y", "y0"), at(F.max_by, "x", "x1"), at(F.max_by, "y", "y1"),
        at(F.min_by, "area", "area0"), at(F.max_by, "area", "area1"), F.avg("area").alias("area"), F.avg("volume").alias("volume"), F.bool_or("label").alias("label")).drop("island")


def cell_of(c: str, width: int) -> Column:
    """The grid line next to a coordinate, halves to the even one."""
    return (F.bround(F.col(c) / width) * width).cast("int")


def groups(seg: DataFrame, width: int = 10, late: int = 370, least: int = 3, least_late: int = 2) -> DataFrame:
    """Segments that begin at one frame and place in enough trackers: fov, start, gx, gy, n_algorithms, n_segments, label (any), algorithms."""
    g = seg.groupBy("fov", "start", cell_of("x0", width).alias("gx"), cell_of("y0", width).alias("gy")).agg(
        F.countDistinct("algorithm").alias("n_algorithms"), F.count(F.lit(1)).alias("n_segments"), F.bool_or("label").alias("label"), F.array_join(F.sort_array(F.collect_set("algorithm")), ",").alias("algorithms"))
    return g.where(F.col("n_algorithms") >= F.when(F.col("start") >= late, least_late).otherwise(least))


def representatives(seg: DataFrame, width: int = 10, late: int = 370, least: int = 3, least_late: int = 2) -> DataFrame:
    """The segment that stands for each group: the shortest, then the largest, then by place, tracker and number."""
    key = F.struct("n", (-F.col("area")).alias("a"), (-F.col("volume")).alias("v"), "x0", "y0", "algorithm", "cell_id", "end", "x1", "y1", "area1")
    g = seg.groupBy("fov", "start", cell_of("x0", width).alias("gx"), cell_of("y0", width).alias("gy")).agg(F.countDistinct("algorithm").alias("n_algorithms"), F.min(key).alias("m"))
    g = g.where(F.col("n_algorithms") >= F.when(F.col("start") >= late, least_late).otherwise(least))
    return g.select("fov", "start", "gx", "gy", "n_algorithms", "m.algorithm", "m.cell_id", "m.end", "m.n", "m.x1", "m.y1", "m.area1")


def extensions(reps: DataFrame, seg: DataFrame, apart: float = 50.0, ratio: float = 0.6) -> DataFrame:
    """One round of extension: the longest segment that begins right after a representative's end, near and of like size."""
    s = seg.select("fov", (F.col("start") - 1).alias("end"), F.col("algorithm").alias("via"), F.col("cell_id").alias("next"), F.col("n").alias("length"), "x0", "y0", "area0")
    d = reps.join(s, ["fov", "end"]).withColumn("distance", F.hypot(F.col("x0") - F.col("x1"), F.col("y0") - F.col("y1")))
    d = d.where((F.col("distance") <= apart) & (F.least("area0", "area1") >= ratio * F.greatest("area0", "area1")))
    best = d.groupBy("fov", "start", "gx", "gy").agg(F.min(F.struct((-F.col("length")).alias("k"), "distance", "via", "next")).alias("m"))
    return best.select("fov", "start", "gx", "gy", "m.via", "m.next", (-F.col("m.k")).alias("length"), "m.distance")


#: Pairs of segments that are looked at together.
_PAIRS = 1 << 19


def _best_pair(ratio: np.ndarray, x: np.ndarray, y: np.ndarray, rank: np.ndarray, tracker: np.ndarray | None, near: float, far: float, most: float) -> tuple[int, int, float, float] | None:
    """Of segments sorted by ``ratio``: the pair with the smallest error, then the nearest siblings, then the smallest ranks, as (smaller rank, larger, sibling, error).

    Pairs are listed by growing error until one fits, so few are looked at. With ``tracker``, only pairs of two trackers count.
    """
    n = len(ratio)
    rest, after = 1 - ratio, np.arange(1, n + 1)
    within = min(most, 1 / max(n, 1))
    while True:
        # a little wider than within: all pairs whose rounded error is as good are among those listed
        lo = np.maximum(np.searchsorted(ratio, rest - within - 2e-9), after)
        ends = np.cumsum(np.maximum(np.searchsorted(ratio, rest + within + 2e-9, "right") - lo, 0))
        best, found, i0 = None, None, 0
        while i0 < n:
            done = int(ends[i0 - 1]) if i0 else 0
            i1 = max(i0 + 1, int(np.searchsorted(ends, done + _PAIRS, "right")))
            count = np.diff(ends[i0:i1], prepend=done)
            i = np.repeat(np.arange(i0, i1), count)
            j = np.arange(len(i)) - np.repeat(ends[i0:i1] - count - done, count) + np.repeat(lo[i0:i1], count)
            i0 = i1
            error, sibling = np.abs(ratio[i] + ratio[j] - 1), np.hypot(x[i] - x[j], y[i] - y[j])
            ok = (sibling >= near) & (sibling <= far) & (error <= most)
            if tracker is not None:
                ok &= tracker[i] != tracker[j]
            left = np.flatnonzero(ok)
            if not len(left):
                continue
            order = (np.floor(error * 1e9 + 0.5), np.floor(sibling * 1e9 + 0.5), np.minimum(rank[i], rank[j]), np.maximum(rank[i], rank[j]))
            for v in order:
                left = left[v[left] == v[left].min()]
            k = left[0]
            this = tuple(v[k] for v in order)
            if best is None or this < best:
                a, b = (i[k], j[k]) if rank[i[k]] < rank[j[k]] else (j[k], i[k])
                best, found = this, (int(a), int(b), float(sibling[k]), float(error[k]))
        if within >= most or best is not None and best[0] <= within * 1e9:
            return found
        within = min(most, within * 8)


def _daughters(apart: float, low: float, high: float, schema: pa.Schema) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["fov", "next"]):
            code = group_codes(t, ["fov", "next"])
            via = group_codes(t, ["fov", "next", "via"])
            mother = np.asarray(t["via"].combine_chunks().is_null())
            x, y, area, cell = (t[c].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for c in ("x", "y", "area", "cell"))
            rank = np.empty(len(code), np.int64)
            rank[np.lexsort((cell, via))] = np.arange(len(code))
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            rows, pairs = [], []
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(code)], strict=True):
                mid = lo + int(mother[lo:hi].sum())  # mothers come first, then the trackers by name, each by size
                cuts = (mid + np.flatnonzero(np.diff(via[mid:hi], prepend=-1))).tolist()
                trackers = [np.arange(a, b) for a, b in zip(cuts, [*cuts[1:], hi], strict=True)] if mid < hi else []
                every = mid + np.argsort(area[mid:hi], kind="stable")
                for r in range(lo, mid):
                    for own in (*trackers, every):
                        ratio = area[own] / area[r]
                        some = slice(np.searchsorted(ratio, low, "right"), np.searchsorted(ratio, high))
                        c, ratio = own[some], ratio[some]
                        close = np.hypot(x[c] - x[r], y[c] - y[r]) < apart
                        c, ratio = c[close], ratio[close]
                        limits = (None, 10, 300, 0.5) if own is not every else (via[c], 15, 350, 0.6)
                        p = _best_pair(ratio, x[c], y[c], rank[c], *limits) if len(c) > 1 else None
                        if p:
                            rows.append(r)
                            pairs.append((int(c[p[0]]), int(c[p[1]]), own is not every, p[2], p[3]))
                            break
            if rows:
                a, b, same, sibling, error = zip(*pairs, strict=True)
                key = t.select(["fov", "start", "gx", "gy"]).take(rows)
                named = [t[c].take(pa.array(i)) for i in (a, b) for c in ("via", "cell")]
                yield from pa.table([*key.columns, *named, pa.array(same), pa.array(sibling), pa.array(error)], names=schema.names).cast(schema).to_batches()

    return run


def divisions(reps: DataFrame, seg: DataFrame, apart: float = 400.0, low: float = 0.2, high: float = 0.9) -> DataFrame:
    """The two segments that begin right after a representative's end and are its daughters: fov, start, gx, gy, via_a, cell_a, via_b, cell_b, same, sibling, error.

    Pairs of one tracker go first, the first tracker by name that has any (siblings 10 to 300 apart, sizes that add up to the parent's within a half), then pairs of two trackers (15 to
    350, 0.6). The best pair has the smallest error of size, then the nearest siblings, then the smallest names and numbers. A task sees the segments that begin in one frame of a
    field of view with the representatives that end before; of a tracker's segments of one place and size the smallest number stands for all, as siblings lie apart.
    """
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    s = seg.where(F.col("fov").isNotNull() & F.col("start").isNotNull() & F.col("algorithm").isNotNull() & F.col("cell_id").isNotNull() & number("x0") & number("y0") & number("area0"))
    s = s.groupBy("fov", F.col("start").alias("next"), F.col("algorithm").alias("via"), F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("area0").alias("area")).agg(F.min("cell_id").alias("cell"))
    p = reps.where(F.col("fov").isNotNull() & F.col("end").isNotNull() & number("x1") & number("y1") & number("area1") & (F.col("area1") > 0))
    p = p.select("fov", (F.col("end") + 1).alias("next"), F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("area1").alias("area"), "start", "gx", "gy")
    d = s.unionByName(p, allowMissingColumns=True).repartition("fov", "next").sortWithinPartitions("fov", "next", "via", "area")
    kind = {f.name: f.dataType for f in d.schema}
    names = {"fov": "fov", "start": "start", "gx": "gx", "gy": "gy", "via_a": "via", "cell_a": "cell", "via_b": "via", "cell_b": "cell"}
    schema = StructType([*(StructField(n, kind[c]) for n, c in names.items()), StructField("same", BooleanType()), StructField("sibling", DoubleType()), StructField("error", DoubleType())])
    return d.mapInArrow(_daughters(apart, low, high, to_arrow_schema(schema)), schema)


def renumber(tracks: DataFrame) -> DataFrame:
    """New numbers from 1 per seq, generation by generation, then by first frame and old number: seq, cell_id, new_id, new_parent.

    Cells on or below rings come last; a parent that does not exist becomes 0.
    """
    f = hierarchy.forest(tracks, "seq", "cell_id", "parent_id").select("seq", "cell_id", "depth")
    d = tracks.join(f, ["seq", "cell_id"])
    new = numbered(d, ["seq"], [F.col("depth").asc_nulls_last(), F.col("start_frame").asc(), F.col("cell_id").asc()], "new_id")
    up = new.select("seq", F.col("cell_id").alias("parent_id"), F.col("new_id").alias("new_parent"))
    return new.join(up, ["seq", "parent_id"], "left").select("seq", "cell_id", "new_id", F.coalesce("new_parent", F.lit(0)).alias("new_parent"))
