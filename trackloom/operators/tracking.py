"""Trackers as joins: objects of successive frames are linked by overlap or by cheapest assignment, and links become tracks.

A frame's objects meet only those of the next frame nearby, so the work is an equi-join over places; the sequential part of a
tracker, giving numbers to chains of links, is the merging of only children in a forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunks import group_codes, whole_groups
from ..session import stage
from . import hierarchy
from .scoring import assign


def overlap_links(px: DataFrame, reach: int = 1, threshold: float = 0.1) -> DataFrame:
    """Each object with the object of the frame before that covers it best once grown by ``reach`` pixels: seq, frame, label, before, score.

    ``px``: seq, frame, y, x, label. The score is the covered share of the object's grown pixels; below ``threshold`` there is no link. Of equal scores the
    smaller label wins.
    """
    steps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    o = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps))).alias("o")
    grown = px.select("seq", "frame", "label", (F.col("y") + 0).alias("y"), "x", o).select("seq", "frame", "label", (F.col("y") + F.col("o.i")).alias("y"), (F.col("x") + F.col("o.j")).alias("x")).distinct()
    size = grown.groupBy("seq", "frame", "label").agg(F.count(F.lit(1)).alias("size"))
    past = px.select("seq", (F.col("frame") + 1).alias("frame"), "y", "x", F.col("label").alias("before"))
    n = grown.join(past, ["seq", "frame", "y", "x"]).groupBy("seq", "frame", "label", "before").agg(F.count(F.lit(1)).alias("n"))
    s = n.join(size, ["seq", "frame", "label"]).withColumn("score", F.col("n") / F.col("size")).where(F.col("score") >= threshold)
    best = s.groupBy("seq", "frame", "label").agg(F.max(F.struct("score", (-F.col("before")).alias("b"))).alias("m"))
    return best.select("seq", "frame", "label", (-F.col("m.b")).cast("int").alias("before"), F.col("m.score").alias("score"))


def tracks_of(objects: DataFrame, links: DataFrame) -> DataFrame:
    """Numbers objects into tracks: seq, frame, label, track, parent.

    An object linked alone to one before goes on with its track; of several linked to one, each begins a track whose parent is that one's. ``objects``: seq, frame, label,
    ``links``: seq, frame, label, before (label in the frame before). A track's number is that of its first object: frame * 2^16 + label, so labels lie below 2^16.
    """
    code = lambda f, l: (F.col(f) * 65536 + F.col(l)).cast("int")
    d = objects.select("seq", "frame", "label").join(links.select("seq", "frame", "label", "before"), ["seq", "frame", "label"], "left")
    d = d.select("seq", "frame", "label", code("frame", "label").alias("node"), F.when(F.col("before").isNotNull(), (F.col("frame") - 1) * 65536 + F.col("before")).cast("int").alias("up"))
    alone = F.count(F.lit(1)).over(Window.partitionBy("seq", "up"))
    d = stage(d.withColumn("only", F.when(F.col("up").isNotNull() & (alone == 1), F.col("up"))))
    f = stage(hierarchy.forest(d, "seq", "node", "only", block=1 << 20).select("seq", "node", F.col("root").alias("track")))
    heads = d.where("only is null and up is not null").select("seq", F.col("node").alias("track"), F.col("up").alias("node"))
    parents = heads.join(f.withColumnRenamed("track", "parent"), ["seq", "node"]).select("seq", "track", "parent")
    return d.join(f, ["seq", "node"]).join(parents, ["seq", "track"], "left").select("seq", "frame", "label", "track", F.coalesce("parent", F.lit(0)).alias("parent"))


def near_candidates(objects: DataFrame, radius: float, steps: int = 1) -> DataFrame:
    """Pairs of objects at most ``steps`` frames and ``radius`` apart: seq, frame (of the later), a (before), b, distance and, for several steps, step."""
    d = objects.where("x is not null and y is not null").select("seq", "frame", "label", "x", "y", F.floor(F.col("x") / radius).alias("gx"), F.floor(F.col("y") / radius).alias("gy"))
    o = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("o")
    a = d.select("seq", "frame", F.col("label").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), "gx", "gy", o).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    a = a.select("seq", (F.col("frame") + F.col("step")).alias("frame"), "step", "a", "xa", "ya", (F.col("gx") + F.col("o.i")).alias("gx"), (F.col("gy") + F.col("o.j")).alias("gy"))
    b = d.select("seq", "frame", F.col("label").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), "gx", "gy")
    p = a.join(b, ["seq", "frame", "gx", "gy"]).withColumn("distance", F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")))
    return p.where(F.col("distance") <= radius).select("seq", "frame", "a", "b", "distance", *(["step"] if steps > 1 else []))


def _choose(a: np.ndarray, b: np.ndarray, distance: np.ndarray, radius: float, split: float) -> tuple[np.ndarray, np.ndarray]:
    """Every later object gets an earlier one or appears (cost: radius); an earlier one may go on twice, the second time at a dearer price."""
    if len(a) == 1:
        return (b, a) if distance[0] < radius else (b[:0], a[:0])
    ua, i = np.unique(a, return_inverse=True)
    ub, j = np.unique(b, return_inverse=True)
    cost = np.full((len(ub), 2 * len(ua) + len(ub)), 1e9)
    cost[j, i] = distance
    cost[j, len(ua) + i] = distance + split
    cost[np.arange(len(ub)), 2 * len(ua) + np.arange(len(ub))] = radius
    at = assign(cost)
    on = at < 2 * len(ua)
    return ub[on], ua[at[on] % len(ua)]


def _cheapest(radius: float, split: float) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["seq", "frame"]):
            code = group_codes(t, ["seq", "frame"])
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            a, b, d = (t[c].to_numpy() for c in ("a", "b", "distance"))
            rows, labels, befores = [], [], []
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(code)], strict=True):
                label, before = _choose(a[lo:hi], b[lo:hi], d[lo:hi], radius, split)
                rows += [lo] * len(label)
                labels.append(label)
                befores.append(before)
            at = pa.array(np.array(rows, np.int64))
            yield pa.RecordBatch.from_arrays(
                [t["seq"].combine_chunks().take(at), t["frame"].combine_chunks().take(at), pa.array(np.concatenate(labels).astype(np.int32)), pa.array(np.concatenate(befores).astype(np.int32))], names=["seq", "frame", "label", "before"])

    return run


def cheapest_links(objects: DataFrame, radius: float = 20.0, split: float = 10.0) -> DataFrame:
    """Links between successive frames that cost least in all: the distance, ``split`` more for a second successor, ``radius`` for an object that appears.

    Candidates come from a grid join; one assignment sees the candidates of one pair of frames, bounded by what a frame holds. ``objects``: seq, frame, label, x, y.
    """
    c = near_candidates(objects, radius).repartition("seq", "frame").sortWithinPartitions("seq", "frame", "a", "b")
    return c.mapInArrow(_cheapest(radius, split), "seq string, frame int, label int, before int")
