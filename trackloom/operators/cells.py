"""Per-cell tables: filling, motion, gaps, counts, lineage reports, neighbours, phases and track quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from . import hierarchy

#: The phases of a recording, first and last frame each.
PHASES = ((1, 0, 101), (2, 102, 142), (3, 143, 232), (4, 233, 274), (5, 275, 302), (6, 303, 316), (7, 317, 354), (8, 355, 400))
MINUTES_PER_FRAME = 10


def valid(c: str) -> Column:
    """The number in ``c``, NULL for NaN."""
    return F.when(~F.isnan(c), F.col(c))


def fill_positions(rows: DataFrame, columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Linear interpolation of missing numbers over (seq, cell_id, frame); before the first and after the last known one that one is taken.

    Adds ``filled`` for rows where any of ``columns`` was missing. A cell without any known number keeps NULLs. A cell's rows are one
    window: at most one per frame.
    """
    w = Window.partitionBy("seq", "cell_id").orderBy("frame")
    past, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    out = rows
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    out = out.withColumn("filled", missing)
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.struct("frame", F.col(c).alias("v")))
        out = out.withColumn("_p", F.last(known, ignorenulls=True).over(past)).withColumn("_n", F.first(known, ignorenulls=True).over(ahead))
        line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col("frame") - F.col("_p.frame")) / (F.col("_n.frame") - F.col("_p.frame"))
        out = out.withColumn(c, F.coalesce(F.col(c), line, "_p.v", "_n.v")).drop("_p", "_n")
    return out


def motion(rows: DataFrame) -> DataFrame:
    """speed: distance to the cell's last seen position; displacement: distance from the image's origin; both NULL without position."""
    w = Window.partitionBy("seq", "cell_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct("x", "y"))
    d = rows.withColumn("_p", F.last(seen, ignorenulls=True).over(w))
    return d.select("seq", "cell_id", "frame", F.hypot(F.col("x") - F.col("_p.x"), F.col("y") - F.col("_p.y")).alias("speed"), F.hypot("x", "y").alias("displacement"))


def carry_label(rows: DataFrame) -> DataFrame:
    """The last label 0 or 1 seen so far of each cell."""
    w = Window.partitionBy("seq", "cell_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("seq", "cell_id", "frame", F.last(F.when(F.col("label").isin(0, 1), F.col("label")), ignorenulls=True).over(w).alias("label"))


def missing_frames(tracks: DataFrame, seen: DataFrame) -> DataFrame:
    """Frames inside a track without an observation: seq, cell_id, frame. Tracks that end before they begin have none."""
    span = tracks.where("end_frame >= start_frame").select("seq", "cell_id", F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))
    return span.join(seen.select("seq", "cell_id", "frame"), ["seq", "cell_id", "frame"], "left_anti")


def gap_runs(missing: DataFrame) -> DataFrame:
    """Runs of missing frames per cell: seq, cell_id, n_gaps, longest, n_missing."""
    w = Window.partitionBy("seq", "cell_id").orderBy("frame")
    runs = missing.withColumn("island", F.col("frame") - F.row_number().over(w)).groupBy("seq", "cell_id", "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("seq", "cell_id").agg(F.count(F.lit(1)).alias("n_gaps"), F.max("n").alias("longest"), F.sum("n").alias("n_missing"))


def tolerated(start: Column, n_segments: Column, share: Column) -> Column:
    """Gap length that a track may have: the least of three ladders (by start frame, by number of segments, by share of frames seen)."""
    by_start = F.when(start <= 150, 1).when(start <= 303, 2).otherwise(3)
    by_segments = F.when(n_segments >= 20, 1).when(n_segments >= 10, 2).otherwise(3)
    by_share = F.when(share >= 0.9, 3).when(share >= 0.7, 2).otherwise(1)
    return F.least(by_start, by_segments, by_share)


def continuity(tracks: DataFrame, seen: DataFrame) -> DataFrame:
    """Whether a track's longest gap is tolerated: seq, cell_id, longest, allowed, continuous."""
    gaps = gap_runs(missing_frames(tracks, seen))
    t = tracks.where("end_frame >= start_frame").select("seq", "cell_id", "start_frame", (F.col("end_frame") - F.col("start_frame") + 1).alias("n"))
    d = t.join(gaps, ["seq", "cell_id"], "left").na.fill(0, ["n_gaps", "longest", "n_missing"])
    share = (F.col("n") - F.col("n_missing")) / F.col("n")
    d = d.withColumn("allowed", tolerated(F.col("start_frame"), F.col("n_gaps") + 1, share))
    return d.select("seq", "cell_id", "longest", "allowed", (F.col("longest") <= F.col("allowed")).alias("continuous"))


def nearest_frames(seen: DataFrame, last: int) -> DataFrame:
    """For every frame 0..last of a sequence the nearest one with an object, the earlier of two: seq, frame, source."""
    have = seen.select("seq", "frame").distinct()
    w = Window.partitionBy("seq").orderBy("frame")
    all_ = seen.select("seq").distinct().select("seq", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("frame"))
    d = all_.join(have.withColumn("own", F.col("frame")), ["seq", "frame"], "left")
    d = d.withColumn("before", F.last("own", ignorenulls=True).over(w)).withColumn("after", F.first("own", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    far = F.col("after") - F.col("frame")
    return d.select("seq", "frame", F.when(F.col("before").isNull() | (far < F.col("frame") - F.col("before")), F.coalesce("after", "before")).otherwise(F.col("before")).alias("source"))


def neighbours(rows: DataFrame, radius: float) -> DataFrame:
    """Pairs of cells of one frame at most ``radius`` apart: seq, frame, a, b, distance (a < b). Joined over grid cells of that width."""
    d = rows.where("x is not null and y is not null").select("seq", "frame", "cell_id", "x", "y", F.floor(F.col("x") / radius).alias("gx"), F.floor(F.col("y") / radius).alias("gy"))
    a = d.select("seq", "frame", F.col("cell_id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), "gx", "gy")
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("o")
    b = d.select("seq", "frame", F.col("cell_id").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), "gx", "gy", around)
    b = b.select("seq", "frame", "b", "xb", "yb", (F.col("gx") + F.col("o.i")).alias("gx"), (F.col("gy") + F.col("o.j")).alias("gy"))
    dist = F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb"))
    p = a.join(b, ["seq", "frame", "gx", "gy"]).where("a < b").withColumn("distance", dist)
    return p.where(F.col("distance") <= radius).select("seq", "frame", "a", "b", "distance")


def phase(frame: Column) -> Column:
    """The phase that a frame lies in, NULL outside all."""
    out = F.lit(None).cast("int")
    for p, a, b in PHASES:
        out = F.when(frame.between(a, b), F.lit(p)).otherwise(out)
    return out


def clock(frame: Column) -> Column:
    """Frame number as hours and minutes, such as 16h50min."""
    m = frame * MINUTES_PER_FRAME
    return F.format_string("%dh%02dmin", F.floor(m / 60), m % 60)


def lineage(tracks: DataFrame) -> DataFrame:
    """A report row per cell: parent, children, generation, counts of ancestors and descendants, place in the family, chain.

    ``tracks``: seq, cell_id, start_frame, end_frame, parent_id (NULL: none), one row per cell. Parents that do not exist count as none.
    """
    p = stage(hierarchy.paths(tracks, "seq", "cell_id", "parent_id"))
    below = hierarchy.descendants(p, "seq", "cell_id").groupBy("seq", "cell_id").agg(F.count(F.lit(1)).alias("n_descendants"))
    here = tracks.select("seq", F.col("cell_id").alias("parent_id")).distinct()
    kids = tracks.join(here, ["seq", "parent_id"]).groupBy("seq", F.col("parent_id").alias("cell_id")).agg(F.sort_array(F.collect_list("cell_id")).alias("children"))
    d = tracks.join(p.select("seq", "cell_id", "root", "depth", "path", "ring"), ["seq", "cell_id"]).join(below, ["seq", "cell_id"], "left").join(kids, ["seq", "cell_id"], "left")
    place = F.when(F.col("ring").isNotNull(), "Ring").when((F.col("depth") == 0) & F.col("children").isNull(), "Single").when(F.col("depth") == 0, "Root").when(F.col("children").isNull(), "Terminal").otherwise("Intermediate")
    return d.select(
        "seq", "cell_id", "start_frame", "end_frame", (F.col("end_frame") - F.col("start_frame") + 1).alias("lifespan"), F.when(F.col("depth") > 0, F.element_at("path", -2)).alias("parent"),
        F.array_join("children", ",").alias("children"), F.col("root").alias("root_id"), F.col("depth").alias("generation"), F.col("depth").alias("n_ancestors"),
        F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"), place.alias("position"), F.array_join("path", " → ").alias("chain"))


def families(report: DataFrame) -> DataFrame:
    """Per root: members, deepest generation, mean lifespan, first and last frame."""
    return report.where("root_id is not null").groupBy("seq", "root_id").agg(
        F.count(F.lit(1)).alias("members"), F.max("generation").alias("generations"), F.avg("lifespan").alias("mean_lifespan"), F.min("start_frame").alias("first_frame"), F.max("end_frame").alias("last_frame"))


def track_quality(rows: DataFrame) -> DataFrame:
    """Completeness and steadiness of each cell's rows: seq, cell_id, n, completeness, largest gap, largest jump, way, area variation."""
    w = Window.partitionBy("seq", "cell_id").orderBy("frame")
    d = rows.withColumn("gap", F.col("frame") - F.lag("frame").over(w)).withColumn("jump", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    g = d.groupBy("seq", "cell_id").agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / (F.max("frame") - F.min("frame") + 1)).alias("completeness"), F.max("gap").alias("largest_gap"), F.max("jump").alias("largest_jump"),
        F.hypot(F.max_by("x", "frame") - F.min_by("x", "frame"), F.max_by("y", "frame") - F.min_by("y", "frame")).alias("way"), (F.stddev_pop("area") / F.nullif(F.avg("area"), F.lit(0.0))).alias("area_variation"))
    return g


def moving_tracks(rows: DataFrame, height: int = 1024) -> DataFrame:
    """Tracks that stay after cleaning: at least max(3, 0.3 x the sequence's median length) rows and a mean movement below a fifth of the height.

    Movement is the mean over the two coordinates of the norm of all steps in it.
    """
    w = Window.partitionBy("seq", "cell_id").orderBy("frame")
    d = rows.where("x is not null and y is not null").withColumn("dx", F.col("x") - F.lag("x").over(w)).withColumn("dy", F.col("y") - F.lag("y").over(w))
    t = d.groupBy("seq", "cell_id").agg(F.count(F.lit(1)).alias("n"), ((F.sqrt(F.sum(F.col("dx") * F.col("dx"))) + F.sqrt(F.sum(F.col("dy") * F.col("dy")))) / 2).alias("movement"))
    m = t.groupBy("seq").agg(F.median("n").alias("median"))
    d = t.join(m, "seq").where((F.col("n") >= F.greatest(F.lit(3.0), 0.3 * F.col("median"))) & (F.coalesce("movement", F.lit(0.0)) < 0.2 * height))
    return d.select("seq", "cell_id", "n", "movement")


def daughter_candidates(tracks: DataFrame, apart: float = 400.0, low: float = 0.2, high: float = 0.9) -> DataFrame:
    """Tracks that begin one frame after another one's end, near and smaller: seq, parent, daughter, distance, ratio.

    ``tracks``: seq, cell_id, first, last, x0, y0, a0 (at its first row), x1, y1, a1 (at its last).
    """
    p = tracks.select("seq", F.col("cell_id").alias("parent"), "x1", "y1", "a1", (F.col("last") + 1).alias("first"))
    k = tracks.select("seq", F.col("cell_id").alias("daughter"), "x0", "y0", "a0", "first")
    d = p.join(k, ["seq", "first"]).where("parent <> daughter").withColumn("distance", F.hypot(F.col("x0") - F.col("x1"), F.col("y0") - F.col("y1"))).withColumn("ratio", F.col("a0") / F.nullif("a1", F.lit(0.0)))
    return d.where((F.col("distance") < apart) & (F.col("ratio") > low) & (F.col("ratio") < high)).select("seq", "parent", "daughter", "distance", "ratio", "x0", "y0")


def daughter_pairs(candidates: DataFrame) -> DataFrame:
    """The best pair of daughters per parent: siblings 10 to 300 apart whose sizes add up to the parent's within a half.

    The best pair has the smallest error of size, then the nearest siblings, then the smallest numbers.
    """
    a = candidates.select("seq", "parent", F.col("daughter").alias("a"), F.col("ratio").alias("ra"), F.col("x0").alias("xa"), F.col("y0").alias("ya"))
    b = candidates.select("seq", "parent", F.col("daughter").alias("b"), F.col("ratio").alias("rb"), F.col("x0").alias("xb"), F.col("y0").alias("yb"))
    d = a.join(b, ["seq", "parent"]).where("a < b").withColumn("sibling", F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb"))).withColumn("error", F.abs(F.col("ra") + F.col("rb") - 1))
    d = d.where(F.col("sibling").between(10, 300) & (F.col("error") <= 0.5))
    best = d.groupBy("seq", "parent").agg(F.min(F.struct("error", "sibling", "a", "b")).alias("m"))
    return best.select("seq", "parent", "m.a", "m.b", "m.sibling", "m.error")


# marks along lineages


def ancestors_of(tracks: DataFrame, marked: DataFrame) -> DataFrame:
    """The ``marked`` cells (seq, cell_id) of ``tracks`` and all their ancestors: seq, cell_id. Only the marked cells' paths are taken apart.

    ``tracks``: seq, cell_id, parent_id (NULL: none), one row per cell. Cells on or below rings have neither ancestors nor descendants.
    """
    p = hierarchy.paths(tracks, "seq", "cell_id", "parent_id").where("path is not null")
    return p.join(marked.select("seq", "cell_id"), ["seq", "cell_id"], "left_semi").select("seq", F.explode("path").alias("cell_id")).distinct()


def _tops(tracks: DataFrame, cut: DataFrame) -> DataFrame:
    """The top of each cell's line once the lines end at the cells ``cut``: seq, cell_id, root."""
    d = tracks.join(cut.select("seq", "cell_id").distinct().withColumn("cut", F.lit(True)), ["seq", "cell_id"], "left")
    d = d.select("seq", "cell_id", F.when(F.col("cut").isNull(), F.col("parent_id")).alias("parent_id"))
    return hierarchy.forest(d, "seq", "cell_id", "parent_id").where("ring is null").select("seq", "cell_id", "root")


def descendants_of(tracks: DataFrame, marked: DataFrame) -> DataFrame:
    """The ``marked`` cells of ``tracks`` and all their descendants, as ``ancestors_of``: those whose line, ended at marked cells, has a marked top. No pairs are formed."""
    tops = _tops(tracks, marked).join(marked.select("seq", F.col("cell_id").alias("root")).distinct(), ["seq", "root"], "left_semi")
    rings = hierarchy.forest(tracks, "seq", "cell_id", "parent_id").where("ring is not null").select("seq", "cell_id")
    return tops.select("seq", "cell_id").join(rings, ["seq", "cell_id"], "left_anti")


def validated(tracks: DataFrame, judged: DataFrame) -> DataFrame:
    """Whether a track stands: its longest gap is tolerated, or exceeds that by one and its parent stands: seq, cell_id, stands, own.

    ``judged``: rows of ``continuity``. Lines end at tracks that are judged by themselves: fine ones, and ones with gaps too long for the parent to help.
    """
    own = judged.select("seq", "cell_id", F.col("continuous").alias("own"), (F.col("longest") == F.col("allowed") + 1).alias("near"))
    t = tracks.join(own, ["seq", "cell_id"])
    tops = _tops(t, t.where("own or not near"))
    good = own.where("own").select("seq", F.col("cell_id").alias("root"), F.lit(True).alias("stands"))
    d = own.join(tops, ["seq", "cell_id"], "left").join(good, ["seq", "root"], "left")
    return d.select("seq", "cell_id", F.coalesce("stands", F.lit(False)).alias("stands"), "own")


def ground_truth(rows: DataFrame) -> DataFrame:
    """Cells of class 1 that have a row in frame 0; all cells of class 1 of a sequence where none has: seq, cell_id."""
    g = rows.groupBy("seq", "cell_id").agg(F.max(F.coalesce(F.col("label") == 1, F.lit(False))).alias("rare"), (F.min("frame") == 0).alias("first")).where("rare")
    some = F.max("first").over(Window.partitionBy("seq"))
    return g.withColumn("some", some).where("first or not some").select("seq", "cell_id")


def final_labels(tracks: DataFrame, rows: DataFrame, detected: DataFrame, radius: float = 50.0) -> DataFrame:
    """The label of every cell that has a track or a row: seq, cell_id, label (0 or 1), reason.

    Class 1 are the cells of the ground truth, and of those related to it or to ``detected`` cells the ones whose track has no gap too long or that have rows only: ancestors of detected
    cells, detected cells, descendants of the ground truth without long gaps. Cells that begin in frame 0 are of class 1 only as ground
    truth. In a sequence without any parent the neighbours of those cells, in some frame at most ``radius`` apart, stand for relatives.
    """
    rows, detected = stage(rows.select("seq", "cell_id", "frame", "x", "y", "label")), stage(detected.select("seq", "cell_id").distinct())
    truth = stage(ground_truth(rows))
    fine = stage(continuity(tracks, rows).where("continuous").select("seq", "cell_id"))
    here = tracks.select("seq", F.col("cell_id").alias("parent_id")).distinct()
    linked = stage(tracks.join(here, ["seq", "parent_id"], "left_semi").select("seq").distinct())
    key = ["seq", "cell_id"]
    forward = descendants_of(tracks, truth)
    forward = forward.join(fine, key, "left_semi").unionByName(truth)
    seeds = stage(detected.unionByName(truth).distinct().join(linked, "seq", "left_anti"))
    lone = rows.join(seeds.select("seq").distinct(), "seq", "left_semi")
    near = neighbours(lone, radius)
    pairs = near.select("seq", F.col("a").alias("cell_id"), F.col("b").alias("other")).unionByName(near.select("seq", F.col("b").alias("cell_id"), F.col("a").alias("other"))).distinct()
    around = pairs.join(seeds.withColumnRenamed("cell_id", "other"), ["seq", "other"], "left_semi").select("seq", "cell_id")
    chosen = ancestors_of(tracks, detected).join(linked, "seq", "left_semi").unionByName(detected).unionByName(forward.join(linked, "seq", "left_semi")).unionByName(seeds).unionByName(around).unionByName(truth).distinct()
    flag = lambda d, name: d.select(*key).distinct().withColumn(name, F.lit(True))
    every = tracks.select(*key, "start_frame").join(rows.select(*key).distinct(), key, "full")
    d = every.join(flag(chosen, "kin"), key, "left").join(flag(truth, "gt"), key, "left").join(flag(fine, "fine"), key, "left")
    none = F.col("kin").isNull() | (F.col("start_frame") == 0)
    reason = F.when(F.col("gt"), "ground truth").when(none, "none").when(F.col("start_frame").isNull() | F.col("fine"), F.when(F.col("start_frame").isNull(), "rows only").otherwise("continuous")).otherwise("gap")
    return d.select(*key, F.when(reason.isin("none", "gap"), 0).otherwise(1).alias("label"), reason.alias("reason"))
