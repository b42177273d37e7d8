"""Seeded disturbances of tracks and matches. The order of drawing is a hash of the rows' keys and the seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_order(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def drawn(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """The first ``n`` rows of every seq in drawing order. Ranks are cut per task first, so a seq sends at most n rows per task on."""
    w = Window.partitionBy("seq").orderBy("_h")
    return df.withColumn("_h", draw_order(seed, *keys)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_h")


def without_splits(tracks: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Tracks in which the children of ``n`` drawn splitting parents have no parent any more."""
    p = tracks.where("parent > 0").groupBy("seq", "parent").count().where("count > 1").select("seq", "parent")
    gone = drawn(p, n, seed, "seq", "parent").select("seq", "parent", F.lit(0).alias("none"))
    return tracks.join(gone, ["seq", "parent"], "left").select("seq", "label", "birth", "end", F.coalesce("none", "parent").alias("parent"))


def without_matches(matches: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Matches less ``n`` drawn ones of frame 1 on."""
    gone = drawn(matches.where("frame >= 1").select("seq", "frame", "ref"), n, seed, "seq", "frame", "ref")
    return matches.join(gone.select("seq", "frame", "ref"), ["seq", "frame", "ref"], "left_anti")


def with_false_positives(tracks: DataFrame, frames: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Tracks with ``n`` new ones of one frame each, numbered on from the largest label; ``frames``: seq, frame to draw from."""
    new = drawn(frames.select("seq", "frame").distinct(), n, seed, "seq", "frame")
    top = tracks.groupBy("seq").agg(F.max("label").alias("top"))
    new = new.join(top, "seq").select("seq", (F.col("top") + F.col("_r")).cast("int").alias("label"), F.col("frame").alias("birth"), F.col("frame").alias("end"), F.lit(0).alias("parent"))
    return tracks.select("seq", "label", "birth", "end", "parent").unionByName(new)


def without_detections(vertices: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Objects less ``n`` drawn ones; what is left of a label after a lost frame gets a new label: seq, frame, label, new_label."""
    gone = drawn(vertices, n, seed, "seq", "frame", "label").select("seq", "frame", "label")
    d = vertices.join(gone, ["seq", "frame", "label"], "left_anti")
    lost = gone.groupBy("seq", "label").agg(F.sort_array(F.collect_list("frame")).alias("lost"))
    d = d.join(lost, ["seq", "label"], "left").withColumn("piece", F.coalesce(F.size(F.filter("lost", lambda f: f < F.col("frame"))), F.lit(0)))
    pieces = d.where("piece > 0").select("seq", "label", "piece").distinct()
    top = vertices.groupBy("seq").agg(F.max("label").alias("top"))
    number = pieces.withColumn("r", F.row_number().over(Window.partitionBy("seq").orderBy("label", "piece"))).join(top, "seq").select("seq", "label", "piece", (F.col("top") + F.col("r")).cast("int").alias("fresh"))
    return d.join(number, ["seq", "label", "piece"], "left").select("seq", "frame", "label", F.coalesce("fresh", "label").alias("new_label"))


def with_switches(vertices: DataFrame, tracks: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Objects in which ``n`` drawn pairs of labels are swapped from a frame on: seq, frame, label, new_label.

    Pairs are neighbours in drawing order and disjoint, so that the swaps do not depend on each other; a pair is swapped from the later birth on.
    """
    t = drawn(tracks, 2 * n, seed, "seq", "label").withColumn("pair", F.floor((F.col("_r") - 1) / 2))
    p = t.groupBy("seq", "pair").agg(F.min_by("label", "_r").alias("a"), F.max_by("label", "_r").alias("b"), F.max("birth").alias("since")).where("a <> b")
    both = p.select("seq", F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("b").alias("other")), F.struct(F.col("b").alias("label"), F.col("a").alias("other")))).alias("s"), "since").select("seq", "s.*", "since")
    d = vertices.join(both, ["seq", "label"], "left")
    return d.select("seq", "frame", "label", F.when(F.col("frame") >= F.col("since"), F.col("other")).otherwise(F.col("label")).alias("new_label"))


def settings(repeats: DataFrame, kinds: tuple[str, ...], most: int, step: int) -> DataFrame:
    """A row per seed, kind of noise and magnitude; ``repeats``: seed."""
    k = F.explode(F.array(*(F.lit(x) for x in kinds))).alias("kind")
    return repeats.select("seed", k).select("seed", "kind", F.explode(F.sequence(F.lit(0), F.lit(most), F.lit(step))).alias("magnitude"))
