"""Images as pixel rows (seq, frame, y, x, v): statistics, thresholds, connected components, simple transforms."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import group_codes, whole_groups


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def statistics(px: DataFrame) -> DataFrame:
    """Per frame: n, mean, std (population), largest value, and the two thresholds of detection and segmentation."""
    g = px.groupBy("seq", "frame").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.max("v").alias("largest"))
    return g.select("*", clamp(F.col("mean") + 2 * F.col("std"), 80, 200).alias("bright"), clamp(F.col("mean") + 1.5 * F.col("std"), 60, 200).alias("threshold"))


def presence(px: DataFrame, least: int = 80, std: float = 15.0, low: float = 0.0005, high: float = 0.4) -> DataFrame:
    """Whether a frame shows bright cells, and the first reason against it: seq, frame, bright_ratio, present, reason."""
    s = statistics(px)
    n = px.join(s.select("seq", "frame", "bright"), ["seq", "frame"]).groupBy("seq", "frame").agg((F.count(F.when(F.col("v") > F.col("bright"), 1)) / F.count(F.lit(1))).alias("bright_ratio"))
    r = F.col("bright_ratio")
    reason = F.when(F.col("largest") < least, "dark").when(F.col("std") < std, "flat").when(r <= low, "few").when(r >= high, "many").otherwise("bright")
    return s.join(n, ["seq", "frame"]).select("seq", "frame", "bright_ratio", (reason == "bright").alias("present"), reason.alias("reason"))


def binarized(px: DataFrame) -> DataFrame:
    """255 where the value exceeds its frame's segmentation threshold, else 0."""
    s = statistics(px).select("seq", "frame", "threshold")
    return px.join(s, ["seq", "frame"]).select("seq", "frame", "y", "x", F.when(F.col("v") > F.col("threshold"), 255).otherwise(0).alias("v"))


def _components(pdf: pd.DataFrame) -> pd.DataFrame:
    y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
    key = y.astype(np.int64) * (1 << 20) + x
    order = np.argsort(key)
    key = key[order]
    label = np.arange(len(key))
    links = []
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        at = np.searchsorted(key, key + dy * (1 << 20) + dx)
        hit = (at < len(key)) & (key[np.minimum(at, len(key) - 1)] == key + dy * (1 << 20) + dx)
        links.append(np.stack([np.flatnonzero(hit), at[hit]]))
    a, b = np.concatenate(links, axis=1)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return pd.DataFrame({"seq": pdf["seq"].iloc[0], "frame": pdf["frame"].iloc[0], "y": y[order], "x": x[order], "ty": (key[label] >> 20).astype(np.int32), "tx": (key[label] & ((1 << 20) - 1)).astype(np.int32)})


def components(px: DataFrame) -> DataFrame:
    """8-connected components of the given pixels, one image at a time: seq, frame, y, x and the component's first pixel ty, tx.

    An image is what one camera frame holds, so a group is bounded by the image's size. Pixels must be unique.
    """
    return px.select("seq", "frame", "y", "x").groupBy("seq", "frame").applyInPandas(_components, "seq string, frame int, y int, x int, ty int, tx int")


def objects(labels: DataFrame, least: int = 1) -> DataFrame:
    """Objects of at least ``least`` pixels: first pixel, area, centroid, box and extent (area over box)."""
    g = labels.groupBy("seq", "frame", "ty", "tx").agg(F.count(F.lit(1)).alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    return g.where(F.col("area") >= least).withColumn("extent", F.col("area") / ((F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1)))


_ROOT2 = 2**0.5


def perimeters(labels: DataFrame) -> DataFrame:
    """The perimeter of each object, from the 2 x 2 squares of pixels around its border: seq, frame, ty, tx, perimeter.

    A square with two pixels side by side counts 1, one with one or three 1 / sqrt(2), one with two at opposite corners twice that. ``labels``: rows of ``components``.
    """
    quad = F.explode(F.array(*(F.struct((F.col("y") - i).alias("qy"), (F.col("x") - j).alias("qx"), F.lit(1 << (2 * i + j)).alias("bit")) for i in (0, 1) for j in (0, 1)))).alias("q")
    g = labels.select("seq", "frame", "ty", "tx", quad).groupBy("seq", "frame", "ty", "tx", "q.qy", "q.qx").agg(F.sum("q.bit").alias("m"))
    n = F.bit_count("m")
    length = F.when(F.col("m").isin(6, 9), 2 / _ROOT2).when(n == 2, 1.0).when(n < 4, 1 / _ROOT2).otherwise(0.0)
    return g.groupBy("seq", "frame", "ty", "tx").agg(F.sum(length).alias("perimeter"))


def gradients(px: DataFrame) -> DataFrame:
    """The size of the gradient at every pixel by central differences; a neighbour that is missing has the pixel's own value: seq, frame, y, x, gradient."""
    to = F.explode(F.array(*(F.struct((F.col("y") + i).alias("y"), (F.col("x") + j).alias("x"), F.lit(k).alias("from")) for i, j, k in ((0, 0, "own"), (1, 0, "up"), (-1, 0, "down"), (0, 1, "left"), (0, -1, "right"))))).alias("to")
    d = px.select("seq", "frame", "v", to).groupBy("seq", "frame", "to.y", "to.x").agg(*(F.max(F.when(F.col("to.from") == k, F.col("v"))).alias(k) for k in ("own", "up", "down", "left", "right")))
    side = lambda k: F.coalesce(k, "own")
    return d.where("own is not null").select("seq", "frame", "y", "x", F.hypot((side("right") - side("left")) / 2, (side("down") - side("up")) / 2).alias("gradient"))


def features(labels: DataFrame, px: DataFrame) -> DataFrame:
    """Shape and brightness of each object: seq, frame, ty, tx and 16 measures. ``labels``: rows of ``components``; ``px``: seq, frame, y, x, v.

    Volume is the number of pixels, area the perimeter, and the axes of the ellipse are those of the pixels' second moments; displacement is the centroid's distance from the
    origin. The share of the nucleus is fixed at 0.6.
    """
    key = ["seq", "frame", "ty", "tx"]
    d = labels.join(px, ["seq", "frame", "y", "x"]).join(gradients(px), ["seq", "frame", "y", "x"])
    g = d.groupBy(*key).agg(
        F.count(F.lit(1)).alias("volume"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.var_pop("y").alias("vy"), F.var_pop("x").alias("vx"), F.covar_pop("x", "y").alias("cxy"), ((F.max("y") - F.min("y") + 1) * (F.max("x") - F.min("x") + 1)).alias("box"),
        F.avg("v").alias("intensity_mean"), F.sum("v").alias("intensity_sum"), F.stddev_pop("v").alias("intensity_std"), F.max("v").alias("intensity_max"), F.min("v").alias("intensity_min"), F.avg("gradient").alias("gradient"))
    g = g.join(perimeters(labels), key)
    root = F.sqrt((F.col("vx") - F.col("vy")) * (F.col("vx") - F.col("vy")) + 4 * F.col("cxy") * F.col("cxy"))
    # rounding can leave a line of pixels a tiny width
    axis = lambda v: F.greatest(2 * F.sqrt(F.greatest(F.round(v / 2, 9), F.lit(0.0))), F.lit(0.001))
    g = g.withColumn("b", axis(F.col("vx") + F.col("vy") + root)).withColumn("c", axis(F.col("vx") + F.col("vy") - root))
    a2, b2, c2 = F.lit(0.25), F.col("b") * F.col("b"), F.col("c") * F.col("c")
    area = F.col("perimeter")
    return g.select(
        *key, "volume", area.alias("area"), "perimeter", (area * area / (4 * math.pi * area)).alias("compactness"), (math.pi ** (1 / 3) * F.pow(6 * F.col("volume"), F.lit(2 / 3)) / area).alias("sphericity"), (area / F.col("box")).alias("extent"),
        (2 * a2 / (a2 + b2) * F.greatest(1 - (a2 + b2) / (2 * c2), F.lit(0.0))).alias("prolate"), (2 * b2 / (b2 + c2) * F.greatest(1 - 2 * a2 / (b2 + c2), F.lit(0.0))).alias("oblate"), F.lit(1.5).alias("nucleus_ratio"),
        F.hypot("cy", "cx").alias("displacement"), "intensity_mean", "intensity_sum", "intensity_std", "intensity_max", "intensity_min", "gradient")


def _hulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key = ["seq", "frame", "ty", "tx"]
    for t in whole_groups(batches, key):
        code = group_codes(t, key)
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        y, x0, x1 = (t[c].to_numpy() for c in ("y", "x0", "x1"))
        areas = [hull_area(y[a:b], x0[a:b], x1[a:b]) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(y)], strict=True)]
        at = pa.array(first)
        yield pa.RecordBatch.from_arrays([*(t[c].combine_chunks().take(at) for c in key), pa.array(areas, pa.float64())], names=[*key, "hull"])


def hull_area(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> float:
    """Area of the convex hull of pixels' centres, given the first and last column of each row; ``y`` rises."""
    chains = []
    for x, side in ((x0, 1), (x1, -1)):
        chain: list[tuple[int, int]] = []
        for p in zip(y.tolist(), x.tolist(), strict=True):
            while len(chain) > 1 and side * ((chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0])) <= 0:
                chain.pop()
            chain.append(p)
        chains.append(chain)
    ring = chains[0] + chains[1][::-1]
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def hulls(labels: DataFrame) -> DataFrame:
    """The area of each object's convex hull: seq, frame, ty, tx, hull. Only the first and last pixel of an object's rows are sorted and looked at."""
    key = ["seq", "frame", "ty", "tx"]
    rows = labels.groupBy(*key, "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).repartition(*key).sortWithinPartitions(*key, "y")
    return rows.mapInArrow(_hulls, "seq string, frame int, ty int, tx int, hull double")


def contrasted(px: DataFrame, factors: tuple[float, ...] = (0.8, 0.9, 1.1, 1.2, 1.3, 1.4, 1.5)) -> DataFrame:
    """A copy of every pixel per factor, the value times the factor, cut off at 255."""
    f = F.explode(F.array(*(F.lit(v) for v in factors))).alias("factor")
    return px.select("*", f).withColumn("v", F.least(F.col("v") * F.col("factor"), F.lit(255.0)))


def cropped(px: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """Rows y0..y1-1 and columns x0..x1-1, moved to the origin."""
    return px.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1)).withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})


def flipped(px: DataFrame, height: int, width: int, horizontal: bool = True) -> DataFrame:
    return px.withColumn("x", width - 1 - F.col("x")) if horizontal else px.withColumn("y", height - 1 - F.col("y"))


def normalized(px: DataFrame, mean: float = 0.5, std: float = 0.5) -> DataFrame:
    return px.withColumn("v", (F.col("v") / 255 - mean) / std)


def dice(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """Dice coefficient of two 0/1 columns, as an aggregate."""
    return (2 * F.sum(a * b) + eps) / (F.sum(a) + F.sum(b) + eps)
