"""Scores of computed against reference objects and tracks, per sequence.

``Comparison`` holds what all scores need, derived from one table of pixels (seq, frame, ref, comp; label 0 is background): the
contingency of labels, the matches (more than half of the reference object is covered), the objects of either side and
their tracks. Every score is a plan over these; nothing is built that is not asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import numbered
from ..session import stage
from . import hierarchy


@dataclass
class Comparison:
    contingency: DataFrame  # seq, frame, ref, comp, n
    ref_tracks: DataFrame  # seq, label, birth, end, parent (0: none)
    comp_tracks: DataFrame
    matches: DataFrame = field(init=False)  # seq, frame, ref, comp, inter, ref_area, comp_area, iou
    ref: DataFrame = field(init=False)  # seq, frame, label
    comp: DataFrame = field(init=False)

    def __post_init__(self) -> None:
        c = self.contingency
        by = lambda side: F.sum("n").over(Window.partitionBy("seq", "frame", side))
        m = c.withColumn("ref_area", by("ref")).withColumn("comp_area", by("comp")).where("ref <> 0 and comp <> 0 and 2 * n > ref_area")
        self.matches = m.select("seq", "frame", "ref", "comp", F.col("n").alias("inter"), "ref_area", "comp_area", (F.col("n") / (F.col("ref_area") + F.col("comp_area") - F.col("n"))).alias("iou"))
        self.ref, self.comp = (c.where(F.col(s) != 0).select("seq", "frame", F.col(s).alias("label")).distinct() for s in ("ref", "comp"))


def contingency(px: DataFrame) -> DataFrame:
    """Pixels counted per (seq, frame, ref, comp); combined on the map side, then staged, as every score starts from it."""
    return stage(px.groupBy("seq", "frame", "ref", "comp").agg(F.count(F.lit(1)).alias("n")))


def observed_tracks(counts: DataFrame, side: str, parent: Column) -> DataFrame:
    """First and last frame of every label of a side; ``parent`` is an expression over ``label``."""
    t = counts.where(F.col(side) != 0).groupBy("seq", F.col(side).alias("label")).agg(F.min("frame").alias("birth"), F.max("frame").alias("end"))
    return t.withColumn("parent", parent)


def degrees(c: Comparison) -> DataFrame:
    """How many reference objects each matched computed object covers: seq, frame, comp, degree."""
    return c.matches.groupBy("seq", "frame", "comp").agg(F.count(F.lit(1)).alias("degree"))


def node_counts(c: Comparison) -> DataFrame:
    """Per seq: v, c (objects), tp, fn, fp, vs (computed objects over several), ns (missing splits), one (matched one to one)."""
    d = degrees(c).groupBy("seq").agg(
        F.sum("degree").alias("tp"), F.count(F.lit(1)).alias("hit"), F.count(F.when(F.col("degree") == 1, 1)).alias("one"), F.count(F.when(F.col("degree") > 1, 1)).alias("vs"))
    v = c.ref.groupBy("seq").agg(F.count(F.lit(1)).alias("v"))
    k = c.comp.groupBy("seq").agg(F.count(F.lit(1)).alias("c"))
    x = v.join(k, "seq", "full").join(d, "seq", "left").na.fill(0)
    return x.select("seq", "v", "c", "tp", (F.col("v") - F.col("tp")).alias("fn"), (F.col("c") - F.col("hit")).alias("fp"), "vs", (F.col("tp") - F.col("one") - F.col("vs")).alias("ns"), "one", "hit")


def edges(vertices: DataFrame, tracks: DataFrame) -> DataFrame:
    """Links of one label over successive frames (semantic 0) and from a parent's end to a child's birth (1)."""
    w = Window.partitionBy("seq", "label").orderBy("frame")
    same = vertices.withColumn("next", F.lead("frame").over(w)).where("next = frame + 1")
    same = same.select("seq", F.col("frame").alias("t1"), F.col("label").alias("id1"), F.col("next").alias("t2"), F.col("label").alias("id2"), F.lit(0).alias("semantic"))
    p = tracks.select("seq", F.col("label").alias("parent"), F.col("end").alias("t1"))
    links = tracks.where("parent > 0").select("seq", "parent", F.col("label").alias("id2"), F.col("birth").alias("t2")).join(p, ["seq", "parent"])
    links = links.select("seq", "t1", F.col("parent").alias("id1"), "t2", "id2", F.lit(1).alias("semantic"))
    for t, i in (("t1", "id1"), ("t2", "id2")):
        links = links.join(vertices.select("seq", F.col("frame").alias(t), F.col("label").alias(i)), ["seq", t, i], "left_semi")
    return same.unionByName(links)


def edge_diff(c: Comparison) -> DataFrame:
    """Reference edges against computed edges whose ends match one to one: seq, t1, id1, t2, id2, ref_semantic, comp_semantic."""
    one = c.matches.join(degrees(c).where("degree = 1"), ["seq", "frame", "comp"]).select("seq", "frame", "comp", "ref")
    e = edges(c.comp, c.comp_tracks)
    for t, i, r in (("t1", "id1", "r1"), ("t2", "id2", "r2")):
        e = e.join(one.select("seq", F.col("frame").alias(t), F.col("comp").alias(i), F.col("ref").alias(r)), ["seq", t, i])
    e = e.select("seq", "t1", F.col("r1").alias("id1"), "t2", F.col("r2").alias("id2"), F.col("semantic").alias("comp_semantic"))
    r = edges(c.ref, c.ref_tracks).withColumnRenamed("semantic", "ref_semantic")
    return r.join(e, ["seq", "t1", "id1", "t2", "id2"], "full")


def edge_counts(c: Comparison) -> DataFrame:
    """Per seq: e (reference edges), ed (to delete), ea (to add), ec (to change)."""
    d = edge_diff(c)
    n = lambda cond: F.count(F.when(cond, 1))
    r, k = F.col("ref_semantic"), F.col("comp_semantic")
    return d.groupBy("seq").agg(n(r.isNotNull()).alias("e"), n(r.isNull()).alias("ed"), n(k.isNull()).alias("ea"), n(r != k).alias("ec"))


def technical(c: Comparison) -> DataFrame:
    """Detection, segmentation, tracking and linking scores and their means, per seq. A score over nothing is NULL."""
    v = stage(node_counts(c))
    e = edge_counts(c)
    seg = c.matches.groupBy("seq").agg(F.sum("iou").alias("iou"))
    x = v.join(e, "seq", "left").join(seg, "seq", "left").na.fill(0)
    n = lambda a: F.col(a).cast("double")
    nodes, links = 5 * n("ns") + 10 * n("fn") + n("fp"), n("ed") + 1.5 * n("ea") + n("ec")
    score = lambda cost, worst: F.when(worst > 0, 1 - F.least(cost, worst) / worst)
    x = x.select(
        "seq", score(nodes, 10 * n("v")).alias("det"), (n("iou") / F.greatest(n("v"), F.lit(1.0))).alias("seg"), score(nodes + links, 10 * n("v") + 1.5 * n("e")).alias("tra"),
        score(links, 1.5 * n("e")).alias("lnk"), (nodes + links).alias("aogm"), (10 * n("v") + 1.5 * n("e")).alias("aogm_0"))
    return x.select("*", ((F.col("seg") + F.col("det")) / 2).alias("op_csb"), ((F.col("seg") + F.col("tra")) / 2).alias("op_ctb"))


def confusion(c: Comparison) -> DataFrame:
    """Frames per pair of labels: seq, ref, comp, n; comp 0 for missed reference objects, ref 0 for computed ones without match."""
    m = c.matches.select("seq", "frame", "ref", "comp")
    missed = c.ref.withColumnRenamed("label", "ref").join(m, ["seq", "frame", "ref"], "left_anti").select("seq", "ref", F.lit(0).alias("comp"))
    extra = c.comp.withColumnRenamed("label", "comp").join(m, ["seq", "frame", "comp"], "left_anti").select("seq", F.lit(0).alias("ref"), "comp")
    return m.drop("frame").unionByName(missed).unionByName(extra).groupBy("seq", "ref", "comp").agg(F.count(F.lit(1)).alias("n"))


def hota(conf: DataFrame) -> DataFrame:
    """Higher-order tracking score at one threshold, per seq."""
    row, col = Window.partitionBy("seq", "ref"), Window.partitionBy("seq", "comp")
    x = conf.withColumn("row", F.sum("n").over(row)).withColumn("col", F.sum("n").over(col))
    a = F.when((F.col("ref") > 0) & (F.col("comp") > 0), F.col("n") * F.col("n") / (F.col("row") + F.col("col") - F.col("n")))
    return x.groupBy("seq").agg(F.sqrt(F.coalesce(F.sum(a), F.lit(0.0)) / F.sum("n")).alias("hota"))


def cliques(tracks: DataFrame) -> DataFrame:
    """Every track with itself, its ancestors and its descendants: seq, label, member. Tracks on rings have themselves alone."""
    p = hierarchy.paths(tracks.select("seq", "label", F.when(F.col("parent") > 0, F.col("parent")).alias("parent")), "seq", "label", "parent")
    up = p.where("path is not null").select("seq", "label", F.explode("path").alias("member"))
    down = up.where("label <> member").select("seq", F.col("member").alias("label"), F.col("label").alias("member"))
    return up.unionByName(down).unionByName(p.where("path is null").select("seq", "label", F.col("label").alias("member")))


def chota(c: Comparison, conf: DataFrame) -> DataFrame:
    """The same score over cliques of related tracks: sums of rows first, then of columns, so no cell meets a whole clique pair by pair."""
    conf = stage(conf)
    r = stage(cliques(c.ref_tracks)).select("seq", F.col("label").alias("i"), F.col("member").alias("ref"))
    k = stage(cliques(c.comp_tracks)).select("seq", F.col("label").alias("j"), F.col("member").alias("comp"))
    a = stage(r.join(conf, ["seq", "ref"]).groupBy("seq", "i", "comp").agg(F.sum("n").alias("n")))
    row = a.groupBy("seq", "i").agg(F.sum("n").alias("row"))
    both = a.where("comp > 0").join(k, ["seq", "comp"]).groupBy("seq", "i", "j").agg(F.sum("n").alias("tpa"))
    col = k.join(conf.groupBy("seq", "comp").agg(F.sum("n").alias("n")), ["seq", "comp"]).groupBy("seq", "j").agg(F.sum("n").alias("col"))
    cell = conf.where("ref > 0 and comp > 0").select("seq", F.col("ref").alias("i"), F.col("comp").alias("j"), "n")
    x = cell.join(both, ["seq", "i", "j"]).join(row, ["seq", "i"]).join(col, ["seq", "j"])
    s = x.groupBy("seq").agg(F.sum(F.col("n") * F.col("tpa") / (F.col("row") + F.col("col") - F.col("tpa"))).alias("s"))
    return conf.groupBy("seq").agg(F.sum("n").alias("t")).join(s, "seq", "left").select("seq", F.sqrt(F.coalesce("s", F.lit(0.0)) / F.col("t")).alias("chota"))


def id_switches(c: Comparison) -> DataFrame:
    """Matched objects whose reference was last matched to another label: seq, frame, ref, comp, before."""
    w = Window.partitionBy("seq", "ref").orderBy("frame")
    return c.matches.select("seq", "frame", "ref", "comp", F.lag("comp").over(w).alias("before")).where("before <> comp")


def mota(c: Comparison) -> DataFrame:
    sw = id_switches(c).groupBy("seq").agg(F.count(F.lit(1)).alias("idsw"))
    x = node_counts(c).join(sw, "seq", "left").na.fill(0).withColumn("multi", F.col("tp") - F.col("hit"))
    x = x.withColumn("fp", F.col("c") - F.col("tp") + F.col("multi"))
    return x.select(
        "seq", (1 - (F.col("fn") + F.col("fp") + F.col("idsw") + F.col("multi")) / F.col("v")).alias("mota"), "tp", "fp", "fn", "idsw", "multi",
        (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"), (F.col("tp") / F.col("v")).alias("recall"))


def mostly_tracked(conf: DataFrame) -> DataFrame:
    """Shares of reference tracks with their longest row cell at least 0.8 (mt) or below 0.2 (ml); missed frames count as a cell."""
    t = conf.where("ref > 0").groupBy("seq", "ref").agg((F.max("n") / F.sum("n")).alias("ratio"))
    return t.groupBy("seq").agg(F.avg((F.col("ratio") >= 0.8).cast("int")).alias("mt"), F.avg((F.col("ratio") < 0.2).cast("int")).alias("ml"))


def false_alarms(c: Comparison) -> DataFrame:
    frames = c.contingency.groupBy("seq").agg(F.countDistinct("frame").alias("frames"))
    return node_counts(c).join(frames, "seq").select("seq", ((F.col("c") - F.col("one")) / F.col("frames")).alias("faf"), "frames")


def assignments(c: Comparison) -> DataFrame:
    """seq, ref, frame, assigned for every reference object: the computed label, 0 if missed or if that label covers several."""
    d = c.matches.join(degrees(c), ["seq", "frame", "comp"]).select("seq", "frame", "ref", F.when(F.col("degree") == 1, F.col("comp")).otherwise(0).alias("assigned"))
    return c.ref.withColumnRenamed("label", "ref").join(d, ["seq", "frame", "ref"], "left").select("seq", "ref", "frame", F.coalesce("assigned", F.lit(0)).alias("assigned"))


def complete_tracks(c: Comparison) -> DataFrame:
    """Reference tracks covered by one computed track from birth to end: seq, ref, comp."""
    a = assignments(c).groupBy("seq", "ref").agg(F.min("assigned").alias("comp"), F.max("assigned").alias("most")).where("comp = most and comp <> 0")
    r = c.ref_tracks.select("seq", F.col("label").alias("ref"), "birth", "end")
    k = c.comp_tracks.select("seq", F.col("label").alias("comp"), "birth", "end")
    return a.join(r, ["seq", "ref"]).join(k, ["seq", "comp", "birth", "end"]).select("seq", "ref", "comp")


def _sizes(c: Comparison) -> DataFrame:
    n = lambda t, a: t.groupBy("seq").agg(F.count(F.lit(1)).alias(a))
    return n(c.ref_tracks, "n_ref").join(n(c.comp_tracks, "n_comp"), "seq", "full").na.fill(0)


def ct(c: Comparison) -> DataFrame:
    n = complete_tracks(c).groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    return _sizes(c).join(n, "seq", "left").na.fill(0).select("seq", (2 * F.col("n") / (F.col("n_ref") + F.col("n_comp"))).alias("ct"))


def track_fractions(c: Comparison) -> DataFrame:
    """Longest unbroken stretch of each reference track under one computed track, as a share of its length: seq, ref, comp, fraction.

    For one computed track, reference tracks numbered above the first that it covers wholly do not count.
    """
    w = Window.partitionBy("seq", "ref", "assigned").orderBy("frame")
    runs = assignments(c).where("assigned > 0").withColumn("island", F.col("frame") - F.row_number().over(w))
    runs = runs.groupBy("seq", "ref", F.col("assigned").alias("comp"), "island").agg(F.count(F.lit(1)).alias("n")).groupBy("seq", "ref", "comp").agg(F.max("n").alias("n"))
    t = runs.join(c.ref_tracks.select("seq", F.col("label").alias("ref"), "birth", "end"), ["seq", "ref"])
    t = t.select("seq", "ref", "comp", (F.col("n") / (F.col("end") - F.col("birth") + 1)).alias("fraction"))
    whole = F.min(F.when(F.col("fraction") == 1, F.col("ref"))).over(Window.partitionBy("seq", "comp"))
    return t.withColumn("whole", whole).where("whole is null or ref <= whole").drop("whole")


def tf(c: Comparison) -> DataFrame:
    best = track_fractions(c).groupBy("seq", "ref").agg(F.max("fraction").alias("f"))
    return _sizes(c).join(best.groupBy("seq").agg(F.avg("f").alias("tf")), "seq", "left").select("seq", F.coalesce("tf", F.lit(0.0)).alias("tf"))


def splits(tracks: DataFrame) -> DataFrame:
    """Tracks that end in a split: seq, label, children (sorted), end."""
    k = tracks.where("parent > 0").groupBy("seq", F.col("parent").alias("label")).agg(F.sort_array(F.collect_list("label")).alias("children")).where(F.size("children") > 1)
    return k.join(tracks.select("seq", "label", "end"), ["seq", "label"])


def split_matches(c: Comparison, tolerance: int = 3) -> DataFrame:
    """Splits of both sides that agree in parents and children: seq, ref, comp, apart (frames between them, at most ``tolerance``)."""
    r = splits(c.ref_tracks).select("seq", F.col("label").alias("ref"), F.col("children").alias("rc"), F.col("end").alias("tr"))
    k = splits(c.comp_tracks).select("seq", F.col("label").alias("comp"), F.col("children").alias("cc"), F.col("end").alias("tc"))
    k = k.withColumn("tr", F.explode(F.sequence(F.col("tc") - tolerance, F.col("tc") + tolerance)))
    p = r.join(k, ["seq", "tr"]).where(F.size("rc") == F.size("cc")).withColumn("frame", F.least("tr", "tc")).withColumn("later", F.greatest("tr", "tc") + 1)
    p = p.join(c.matches.select("seq", "frame", "ref", "comp"), ["seq", "frame", "ref", "comp"], "left_semi")
    child = p.select("seq", "ref", "comp", "rc", F.size("cc").alias("n"), F.abs(F.col("tr") - F.col("tc")).alias("apart"), F.col("later").alias("frame"), F.explode("cc").alias("child"))
    seen = child.join(c.matches.select("seq", "frame", F.col("comp").alias("child"), F.col("ref").alias("under")), ["seq", "frame", "child"])
    g = seen.groupBy("seq", "ref", "comp", "apart", "n").agg(F.countDistinct("child").alias("seen"), F.min(F.array_contains("rc", F.col("under"))).alias("kin"))
    return g.where("seen = n and kin").select("seq", "ref", "comp", "apart")


def bc(c: Comparison, tolerances: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """Branching correctness per seq and tolerance: F1 of splits. NULL if the reference has none, 0 if the other side has none."""
    n = lambda t, a: splits(t).groupBy("seq").agg(F.count(F.lit(1)).alias(a))
    m = split_matches(c, max(tolerances))
    at = _sizes(c).select("seq", F.explode(F.array(*(F.lit(i) for i in tolerances))).alias("i"))
    hit = at.join(m, "seq").where(F.col("apart") <= F.col("i")).groupBy("seq", "i").agg(F.count(F.lit(1)).alias("tp"))
    x = at.join(n(c.ref_tracks, "r"), "seq", "left").join(n(c.comp_tracks, "k"), "seq", "left").join(hit, ["seq", "i"], "left").na.fill(0)
    p, r = F.col("tp") / F.greatest(F.col("k"), F.lit(1)), F.col("tp") / F.greatest(F.col("r"), F.lit(1))
    return x.select("seq", "i", F.when(F.col("r") > 0, 2 * p * r / F.greatest(p + r, F.lit(1e-4))).alias("bc"))


def cycle_lengths(tracks: DataFrame) -> DataFrame:
    """Lengths (end - birth) of tracks that begin and end in a split: seq, length, n."""
    s = splits(tracks).select("seq", "label")
    t = tracks.join(s, ["seq", "label"], "left_semi").join(s.withColumnRenamed("label", "parent"), ["seq", "parent"], "left_semi")
    return t.groupBy("seq", (F.col("end") - F.col("birth")).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def cycle_cdf(c: Comparison) -> DataFrame:
    """Cumulative shares of cycle lengths of both sides over the lengths that occur: seq, length, ref_cdf, comp_cdf."""
    a = cycle_lengths(c.ref_tracks).withColumnRenamed("n", "r")
    x = a.join(cycle_lengths(c.comp_tracks).withColumnRenamed("n", "k"), ["seq", "length"], "full").na.fill(0)
    w = Window.partitionBy("seq").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("seq")
    cdf = lambda s: F.sum(s).over(w) / F.nullif(F.sum(s).over(whole), F.lit(0))
    return x.select("seq", "length", cdf("r").alias("ref_cdf"), cdf("k").alias("comp_cdf"))


def cca(c: Comparison) -> DataFrame:
    """1 less the largest gap of the two distributions; NULL without reference cycles, 0 without computed ones."""
    g = cycle_cdf(c).groupBy("seq").agg(F.max(F.abs(F.col("ref_cdf") - F.col("comp_cdf"))).alias("gap"), F.max("ref_cdf").alias("r"), F.max("comp_cdf").alias("k"))
    v = F.when(F.col("r").isNull(), None).when(F.col("k").isNull(), 0.0).otherwise(1 - F.col("gap"))
    return _sizes(c).select("seq").join(g, "seq", "left").select("seq", v.alias("cca"))


def biological(c: Comparison) -> DataFrame:
    """ct, tf, cca, bc_0..bc_3 and the means bio_i of those that are not NULL, per seq."""
    b = bc(c).groupBy("seq").pivot("i", [0, 1, 2, 3]).agg(F.first("bc"))
    x = ct(c).join(tf(c), "seq").join(cca(c), "seq").join(b.select("seq", *(F.col(str(i)).alias(f"bc_{i}") for i in range(4))), "seq", "left")
    mean = lambda i: F.aggregate(F.filter(F.array("ct", "tf", "cca", f"bc_{i}"), lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v) / F.size(F.filter(F.array("ct", "tf", "cca", f"bc_{i}"), lambda v: v.isNotNull()))
    return x.select("*", *(mean(i).alias(f"bio_{i}") for i in range(4)))


def merge_tracks(tracks: DataFrame) -> DataFrame:
    """Joins every only child to its parent: seq, label (new, from 1), birth, end, parent (new), n (tracks joined)."""
    only = Window.partitionBy("seq", "parent")
    t = tracks.withColumn("up", F.when((F.col("parent") > 0) & (F.count(F.lit(1)).over(only) == 1), F.col("parent")))
    f = stage(hierarchy.forest(t, "seq", "label", "up").select("seq", "label", F.coalesce("root", "label").alias("root")))
    d = t.join(f, ["seq", "label"])
    g = d.groupBy("seq", "root").agg(F.min("birth").alias("birth"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("label") == F.col("root"), F.col("parent"))).alias("parent"))
    new = numbered(g, ["seq"], [F.col("root").asc()], "label")
    up = f.select("seq", F.col("label").alias("parent"), "root").join(new.select("seq", "root", F.col("label").alias("up")), ["seq", "root"]).select("seq", "parent", "up")
    return new.join(up, ["seq", "parent"], "left").select("seq", "label", "birth", "end", F.coalesce("up", F.lit(0)).alias("parent"), "n")


def validity(c: DataFrame, tracks: DataFrame, vertices: DataFrame) -> DataFrame:
    """Integrity of a side: seq, check, violations. A sequence is valid if all are 0."""
    seqs = c.select("seq").distinct()
    up = tracks.select("seq", F.col("label").alias("parent"), F.col("end").alias("up_end")).distinct()
    child = tracks.where("parent <> 0").join(up, ["seq", "parent"], "left")
    span = tracks.select("seq", "label", F.explode(F.when(F.col("end") >= F.col("birth"), F.sequence("birth", "end"))).alias("frame"))
    parts = {
        "label_not_unique": tracks.groupBy("seq", "label").count().where("count > 1"),
        "parent_negative": tracks.where("parent < 0"),
        "parent_missing": child.where("up_end is null"),
        "parent_ends_late": child.where("up_end >= birth"),
        "ends_before_birth": tracks.where("end < birth"),
        "object_outside_track": vertices.join(span, ["seq", "frame", "label"], "left_anti"),
        "track_without_object": span.join(vertices, ["seq", "frame", "label"], "left_anti"),
    }
    out = None
    for name, rows in parts.items():
        n = seqs.join(rows.groupBy("seq").agg(F.count(F.lit(1)).alias("n")), "seq", "left").select("seq", F.lit(name).alias("check"), F.coalesce("n", F.lit(0)).alias("violations"))
        out = n if out is None else out.unionByName(n)
    return out


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a cheapest assignment of all rows; needs at least as many columns as rows (shortest augmenting paths)."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, way, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            done[j0] = True
            i0 = row_of[j0]
            cut = cost[i0 - 1] - u[i0] - v[1:]
            better = ~done[1:] & (cut < least[1:])
            least[1:][better], way[1:][better] = cut[better], j0
            free = np.where(done[1:], np.inf, least[1:])
            j1 = int(free.argmin()) + 1
            step = free[j1 - 1]
            u[row_of[done]] += step
            v[done] -= step
            least[1:][~done[1:]] -= step
            j0 = j1
            if row_of[j0] == 0:
                break
        while j0:
            row_of[j0], j0 = row_of[way[j0]], way[j0]
    out = np.zeros(n, int)
    out[row_of[1:][row_of[1:] > 0] - 1] = np.flatnonzero(row_of[1:])
    return out


def _identity(pdf: pd.DataFrame) -> pd.DataFrame:
    c = pdf[(pdf["ref"] > 0) & (pdf["comp"] > 0)]
    total_ref, total_comp = pdf.loc[pdf["ref"] > 0, "n"].sum(), pdf.loc[pdf["comp"] > 0, "n"].sum()
    tp = 0
    if len(c):
        i, ri = np.unique(c["ref"], return_inverse=True)
        j, ci = np.unique(c["comp"], return_inverse=True)
        w = np.zeros((len(i), len(j)))
        w[ri, ci] = c["n"]
        w = w if len(i) <= len(j) else w.T
        # a row may stay without partner: pairs that share nothing weigh 0
        tp = int(w[np.arange(len(w)), assign(-w)].sum())
    fp, fn = int(total_comp) - tp, int(total_ref) - tp
    ratio = lambda a, b: a / b if b else np.nan
    return pd.DataFrame([[pdf["seq"].iloc[0], tp, fp, fn, ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn)]], columns=["seq", "idtp", "idfp", "idfn", "idp", "idr", "idf1"])


def identity(conf: DataFrame) -> DataFrame:
    """Identity scores by a heaviest matching of reference and computed tracks; a task holds the distinct label pairs of one sequence."""
    return conf.groupBy("seq").applyInPandas(_identity, "seq string, idtp long, idfp long, idfn long, idp double, idr double, idf1 double")
