"""Queries over cells: filling, motion, gaps, counts, lineage, neighbours, phases, quality, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells as c
from ..operators import hierarchy
from ..session import stage, table
from .problems import _EXISTING, LAST_FRAME, readings, tracks_in_force
from .scores import rounded


def observations(spark: SparkSession, d: str) -> DataFrame:
    """seq, cell_id, frame, x, y, area, volume, label, fov of the rows in force; NaN is NULL."""
    r = readings(spark, d, ["X", "Y", "Area", "Volume", "Label", "fov"])
    return r.select("seq", "cell_id", "frame", c.valid("X").alias("x"), c.valid("Y").alias("y"), c.valid("Area").alias("area"), c.valid("Volume").alias("volume"), F.col("Label").alias("label"), "fov")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Existing cells: seq, cell_id, start_frame, end_frame, parent_id (NULL: none), fov."""
    t = tracks_in_force(spark, d).where("live")
    return t.select("seq", "cell_id", "start_frame", "end_frame", F.when(F.col("parent_id") != 0, F.col("parent_id")).alias("parent_id"), "fov")


def arranged(spark: SparkSession, d: str) -> DataFrame:
    """Rows in force with a position, without lineage columns, frame last."""
    return observations(spark, d).where("x is not null and y is not null").select("seq", "cell_id", "label", "area", "volume", "x", "y", "frame")


def interpolate_positions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(c.fill_positions(observations(spark, d).select("seq", "cell_id", "frame", "x", "y")))


def speed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(c.motion(observations(spark, d)))


def label_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    return c.carry_label(observations(spark, d))


def missing_frames(spark: SparkSession, d: str) -> DataFrame:
    return c.missing_frames(cells(spark, d), observations(spark, d))


def gap_runs(spark: SparkSession, d: str) -> DataFrame:
    return c.gap_runs(c.missing_frames(cells(spark, d), observations(spark, d)))


def continuity(spark: SparkSession, d: str) -> DataFrame:
    return c.continuity(cells(spark, d), observations(spark, d))


def nearest_frame_fill(spark: SparkSession, d: str) -> DataFrame:
    return c.nearest_frames(observations(spark, d), LAST_FRAME)


def spatial_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return rounded(c.neighbours(observations(spark, d), 50.0))


def frame_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per seq and frame: cells there, of class 1 or not, dividing (last frame of a cell with children), missing, total."""
    t = stage(cells(spark, d).where("end_frame >= start_frame"))
    o = stage(observations(spark, d).select("seq", "cell_id", "frame", "label"))
    rare = o.groupBy("seq", "cell_id").agg(F.max(F.coalesce(F.col("label") == 1, F.lit(False))).alias("rare"))
    parents = t.where("parent_id is not null").select("seq", F.col("parent_id").alias("cell_id")).distinct().withColumn("splits", F.lit(True))
    x = t.join(rare, ["seq", "cell_id"], "left").join(parents, ["seq", "cell_id"], "left").select("seq", "cell_id", "end_frame", F.coalesce("rare", F.lit(False)).alias("rare"), F.coalesce("splits", F.lit(False)).alias("splits"), F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))
    x = x.join(o.select("seq", "cell_id", "frame", F.lit(True).alias("seen")), ["seq", "cell_id", "frame"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    n = lambda cond: F.count(F.when(cond, 1))
    r, s, v = F.col("rare"), F.col("splits") & (F.col("frame") == F.col("end_frame")), F.col("seen")
    return x.groupBy("seq", "frame").agg(n(r & v).alias("ips"), n(~r & v).alias("normal"), n(r & v & s).alias("divided_ips"), n(~r & v & s).alias("divided_normal"), n(r & ~v).alias("missing_ips"), n(~r & ~v).alias("missing_normal"), F.count(F.lit(1)).alias("total"))


def overall_counts(spark: SparkSession, d: str) -> DataFrame:
    """Cells by fov and class with subtotals (NULL stands for all)."""
    o = observations(spark, d).groupBy("seq", "cell_id").agg(F.max(F.coalesce(F.col("label") == 1, F.lit(False)).cast("int")).alias("rare"), F.min("fov").alias("fov"), F.count(F.lit(1)).alias("n"))
    return o.rollup("fov", "rare").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_rows"))


def lineage_report(spark: SparkSession, d: str) -> DataFrame:
    return c.lineage(stage(cells(spark, d)))


def families(spark: SparkSession, d: str) -> DataFrame:
    return rounded(c.families(c.lineage(stage(cells(spark, d)))))


def reported_levels(spark: SparkSession, d: str) -> DataFrame:
    """Reported generation levels of detailed_lineage against those of the tracks: counts by both."""
    f = hierarchy.forest(cells(spark, d), "seq", "cell_id", "parent_id").select("seq", "cell_id", "depth")
    r = table(spark, d, "detailed_lineage").select("seq", F.col("Cell_ID").alias("cell_id"), F.col("Generation_Level").alias("reported")).distinct()
    j = r.join(f, ["seq", "cell_id"], "left").withColumn("off", F.col("reported") - F.col("depth"))
    return j.groupBy("off").agg(F.count(F.lit(1)).alias("n"))


def phase_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows, cells and share of class 1 by phase, with the times at which a phase begins and ends."""
    o = observations(spark, d).withColumn("phase", c.phase(F.col("frame"))).where("phase is not null")
    g = o.groupBy("phase").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("seq", "cell_id").alias("n_cells"), F.avg(F.coalesce(F.col("label") == 1, F.lit(False)).cast("int")).alias("share"), F.min("frame").alias("a"), F.max("frame").alias("b"))
    return rounded(g.select("phase", "n_rows", "n_cells", "share", c.clock(F.col("a")).alias("begins"), c.clock(F.col("b")).alias("ends")))


def track_quality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(c.track_quality(observations(spark, d).where("x is not null and y is not null")))


def moving_tracks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(c.moving_tracks(observations(spark, d)))


def _ends(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).where("x is not null and y is not null and area is not null")
    at = lambda f, v, name: f(v, "frame").alias(name)
    return o.groupBy("seq", "cell_id").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), *(at(F.min_by, v, f"{v[0]}0") for v in ("x", "y", "area")), *(at(F.max_by, v, f"{v[0]}1") for v in ("x", "y", "area")))


def daughter_candidates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(c.daughter_candidates(stage(_ends(spark, d))).drop("x0", "y0"))


def daughter_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(c.daughter_pairs(stage(c.daughter_candidates(stage(_ends(spark, d))))))


def feature_stats(spark: SparkSession, d: str) -> DataFrame:
    """Count, mean, population deviation, least and largest of the features of each cell."""
    o = observations(spark, d)
    stats = [f(v).alias(f"{v}_{n}") for v in ("area", "volume") for n, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return rounded(o.groupBy("seq", "cell_id").agg(*stats))


def track_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Violations among existing cells: seq, check, n."""
    t = stage(cells(spark, d))
    up = t.select("seq", F.col("cell_id").alias("parent_id"), F.col("end_frame").alias("up_end"), F.lit(True).alias("there"))
    k = t.where("parent_id is not null").join(up, ["seq", "parent_id"], "left")
    parts = (("ends_before_birth", t.where("end_frame < start_frame")), ("parent_missing", k.where("there is null")), ("parent_ends_late", k.where("up_end >= start_frame")), ("own_parent", t.where("parent_id = cell_id")))
    out = None
    for name, rows in parts:
        n = rows.groupBy("seq").agg(F.count(F.lit(1)).alias("n")).select("seq", F.lit(name).alias("check"), "n")
        out = n if out is None else out.unionByName(n)
    return out


# labels along lineages


def _classes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Existing cells, and those of class 1 (any row)."""
    t = stage(cells(spark, d))
    rare = observations(spark, d).where("label = 1").select("seq", "cell_id").distinct()
    return t, stage(rare.join(t.select("seq", "cell_id"), ["seq", "cell_id"], "left_semi"))


def backward_trace(spark: SparkSession, d: str) -> DataFrame:
    """Cells of class 1 and all their ancestors."""
    return c.ancestors_of(*_classes(spark, d))


def forward_trace(spark: SparkSession, d: str) -> DataFrame:
    """Cells of class 1 and all their descendants."""
    return c.descendants_of(*_classes(spark, d))


def label_setops(spark: SparkSession, d: str) -> DataFrame:
    """Every cell that either trace reaches, with the traces that reach it."""
    t, rare = _classes(spark, d)
    back, on = stage(c.ancestors_of(t, rare)), stage(c.descendants_of(t, rare))
    both = back.intersect(on).withColumn("traces", F.lit("both"))
    return both.unionByName(back.subtract(on).withColumn("traces", F.lit("backward"))).unionByName(on.subtract(back).withColumn("traces", F.lit("forward")))


def failed_progenitors(spark: SparkSession, d: str) -> DataFrame:
    """Cells of class 1 at their first labelled row of which no row in the last frames (350 on) nor any descendant's is of class 1, and that end before frame 250."""
    t = stage(cells(spark, d))
    o = observations(spark, d)
    first = o.where("label is not null").groupBy("seq", "cell_id").agg(F.min_by("label", "frame").alias("label")).where("label = 1").select("seq", "cell_id")
    kept = c.ancestors_of(t, o.where("label = 1 and frame >= 350").select("seq", "cell_id").distinct())
    return t.where("end_frame < 250").select("seq", "cell_id").join(first, ["seq", "cell_id"], "left_semi").join(kept, ["seq", "cell_id"], "left_anti")


def _kin(spark: SparkSession, d: str) -> DataFrame:
    t, rare = _classes(spark, d)
    return c.ancestors_of(t, rare).union(c.descendants_of(t, rare)).distinct().withColumn("retro", F.lit(1))


def retrospective_labels(spark: SparkSession, d: str) -> DataFrame:
    """Rows per seq and label once every cell related to one of class 1 (ancestor, itself, descendant) is given class 1."""
    o = observations(spark, d).join(_kin(spark, d), ["seq", "cell_id"], "left").withColumn("retro", F.coalesce("retro", F.lit(0)))
    return o.groupBy("seq", "retro").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("cell_id").alias("n_cells"))


def phase_labels(spark: SparkSession, d: str) -> DataFrame:
    """Cells per phase by label: class 1 if the cell or a relative is of class 1 and the row lies in that phase."""
    o = observations(spark, d).withColumn("phase", c.phase(F.col("frame"))).join(_kin(spark, d), ["seq", "cell_id"], "left")
    return o.groupBy("phase", F.coalesce("retro", F.lit(0)).alias("retro")).agg(F.countDistinct("seq", "cell_id").alias("n_cells"))


def ground_truth_cells(spark: SparkSession, d: str) -> DataFrame:
    return c.ground_truth(observations(spark, d))


def _final(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    return c.final_labels(stage(cells(spark, d)), o, o.where("label = 1 and frame >= 350"))


def cell_labels(spark: SparkSession, d: str) -> DataFrame:
    """The final label of every cell with a track or a row, and why; detected are the cells with a row of class 1 from frame 350 on."""
    return _final(spark, d)


def labelled_rows(spark: SparkSession, d: str) -> DataFrame:
    """The arranged rows with their cell's final label."""
    return arranged(spark, d).drop("label").join(_final(spark, d).select("seq", "cell_id", "label"), ["seq", "cell_id"])


def validated_cells(spark: SparkSession, d: str) -> DataFrame:
    t = stage(cells(spark, d))
    return c.validated(t, stage(c.continuity(t, observations(spark, d))))


def missing_cells(spark: SparkSession, d: str) -> DataFrame:
    """Per seq and frame the cells that should be there and are not, as a list of numbers."""
    m = c.missing_frames(cells(spark, d), observations(spark, d))
    return m.groupBy("seq", "frame").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("cell_id")), ",").alias("cells"))


def steady_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Cells with rows in at least 5 frames: rows, median position and mean area."""
    o = observations(spark, d).where("x is not null and y is not null")
    g = o.groupBy("seq", "cell_id").agg(F.count(F.lit(1)).alias("n"), F.median("x").alias("x"), F.median("y").alias("y"), F.avg("area").alias("area"))
    return rounded(g.where("n >= 5"))


def all_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells with a track, with rows, or both."""
    t, o = (x.select("seq", "cell_id").distinct() for x in (cells(spark, d), observations(spark, d)))
    side = F.when(F.col("o").isNull(), "track").when(F.col("t").isNull(), "rows").otherwise("both")
    return t.withColumn("t", F.lit(1)).join(o.withColumn("o", F.lit(1)), ["seq", "cell_id"], "full").select("seq", "cell_id", side.alias("known"))


def generation_lists(spark: SparkSession, d: str) -> DataFrame:
    """Every cell's descendants, generation by generation: seq, cell_id, generations, such as Gen+1: 4, 5 | Gen+2: 9."""
    below = hierarchy.descendants(hierarchy.paths(cells(spark, d), "seq", "cell_id", "parent_id"), "seq", "cell_id")
    g = below.groupBy("seq", "cell_id", "distance").agg(F.array_join(F.sort_array(F.collect_list("descendant")), ", ").alias("members"))
    lists = F.sort_array(F.collect_list(F.struct(F.col("distance").cast("int").alias("k"), "members")))
    text = F.array_join(F.transform(lists, lambda x: F.concat(F.lit("Gen+"), x["k"].cast("string"), F.lit(": "), x["members"])), " | ")
    return g.groupBy("seq", "cell_id").agg(text.alias("generations"))


def kept_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Existing cells less those of a single frame that have neither a parent nor children."""
    t = stage(cells(spark, d))
    own = t.select("seq", F.col("cell_id").alias("parent_id"), F.lit(True).alias("up"))
    kids = t.where("parent_id is not null").select("seq", F.col("parent_id").alias("cell_id")).distinct().withColumn("down", F.lit(True))
    k = t.join(own, ["seq", "parent_id"], "left").join(kids, ["seq", "cell_id"], "left")
    return k.where("not (start_frame <=> end_frame) or up is not null or down is not null").select("seq", "cell_id", "start_frame", "end_frame")


def class_by_frame(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each class by frame, with the frame's phase."""
    o = observations(spark, d).withColumn("phase", c.phase(F.col("frame")))
    n = lambda cond: F.count(F.when(cond, 1))
    return o.groupBy("frame", "phase").agg(n(F.col("label") == 1).alias("rare"), n(F.col("label") == 0).alias("common"), n(F.col("label").isNull()).alias("unknown"))


def lineage_tracks(spark: SparkSession, d: str) -> DataFrame:
    """The lineage report's second form: length, frame of division (the last one, of cells with children) and whether the cell has rows."""
    r = c.lineage(stage(cells(spark, d)))
    seen = observations(spark, d).select("seq", "cell_id").distinct().withColumn("seen", F.lit(True))
    return r.join(seen, ["seq", "cell_id"], "left").select("seq", "cell_id", F.col("lifespan").alias("track_length"), F.when(F.col("children").isNotNull(), F.col("end_frame")).alias("division_frame"), F.coalesce("seen", F.lit(False)).alias("detected"), "generation", "position")


QUERIES = {f.__name__: f for f in (
    arranged, interpolate_positions, speed, label_carry_forward, missing_frames, gap_runs, continuity, nearest_frame_fill, spatial_neighbours, frame_counts, overall_counts, lineage_report, families, reported_levels,
    phase_counts, track_quality, moving_tracks, daughter_candidates, daughter_pairs, feature_stats, track_integrity, backward_trace, forward_trace, label_setops, failed_progenitors, retrospective_labels, phase_labels, ground_truth_cells, cell_labels, labelled_rows, validated_cells, missing_cells, steady_tracks, all_cells, generation_lists, kept_tracks, class_by_frame, lineage_tracks)}

_NUM = "CASE WHEN isnan({0}) THEN NULL ELSE {0} END"
_OBS = f"""obs AS (SELECT seq, "Cell ID" AS cell_id, Frame AS frame, {_NUM.format("X")} AS x, {_NUM.format("Y")} AS y, {_NUM.format("Area")} AS area, {_NUM.format("Volume")} AS volume, Label AS label, fov FROM
  (SELECT *, row_number() OVER (PARTITION BY seq, "Cell ID", Frame ORDER BY loaded_at DESC NULLS LAST) AS rn FROM features WHERE seq IS NOT NULL AND "Cell ID" IS NOT NULL AND Frame BETWEEN 0 AND 400) WHERE rn = 1)"""
_CELLS = _EXISTING + """, tk AS (SELECT l.seq, l.cell_id, l.start_frame, l.end_frame, nullif(l.parent_id, 0) AS parent_id, l.fov FROM last l JOIN cells c ON c.seq = l.seq AND c.cell_id = l.cell_id)"""
_O = f"WITH {_OBS}"
_C = f"WITH RECURSIVE {_CELLS}, {_OBS}"
_MISSING = """, miss AS (SELECT t.seq, t.cell_id, cast(g.f AS INTEGER) AS frame FROM tk t JOIN range(0, 2000) g(f) ON g.f BETWEEN t.start_frame AND t.end_frame WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.seq = t.seq AND o.cell_id = t.cell_id AND o.frame = g.f)),
runs AS (SELECT seq, cell_id, g, count(*) AS n FROM (SELECT *, frame - row_number() OVER (PARTITION BY seq, cell_id ORDER BY frame) AS g FROM miss) GROUP BY ALL),
gaps AS (SELECT seq, cell_id, count(*) AS n_gaps, max(n) AS longest, cast(sum(n) AS BIGINT) AS n_missing FROM runs GROUP BY ALL)"""
_PHASE = "CASE " + " ".join(f"WHEN frame BETWEEN {a} AND {b} THEN {p}" for p, a, b in c.PHASES) + " END"
_CLASS = """, rare AS (SELECT DISTINCT o.seq, o.cell_id FROM obs o JOIN cells k ON k.seq = o.seq AND k.cell_id = o.cell_id WHERE o.label = 1),
anc AS (SELECT seq, cell_id, cell_id AS ancestor FROM tree UNION ALL SELECT a.seq, a.cell_id, l.parent_id FROM anc a JOIN links l ON l.seq = a.seq AND l.cell_id = a.ancestor),
back AS (SELECT DISTINCT a.seq, a.ancestor AS cell_id FROM anc a JOIN rare r ON r.seq = a.seq AND r.cell_id = a.cell_id),
fwd AS (SELECT DISTINCT a.seq, a.cell_id FROM anc a JOIN rare r ON r.seq = a.seq AND r.cell_id = a.ancestor),
kin AS (SELECT * FROM back UNION SELECT * FROM fwd)"""
_ENDS = """, e0 AS (SELECT seq, cell_id, min(frame) AS first, max(frame) AS last, min_by(x, frame) AS x0, min_by(y, frame) AS y0, min_by(area, frame) AS a0, max_by(x, frame) AS x1, max_by(y, frame) AS y1, max_by(area, frame) AS a1 FROM obs WHERE x IS NOT NULL AND y IS NOT NULL AND area IS NOT NULL GROUP BY ALL),
cand AS (SELECT * FROM (SELECT p.seq, p.cell_id AS parent, k.cell_id AS daughter, sqrt((k.x0 - p.x1) ** 2 + (k.y0 - p.y1) ** 2) AS distance, k.a0 / nullif(p.a1, 0) AS ratio, k.x0, k.y0 FROM e0 p JOIN e0 k ON k.seq = p.seq AND k.first = p.last + 1 AND k.cell_id <> p.cell_id) WHERE distance < 400 AND ratio > 0.2 AND ratio < 0.9)"""
_REPORT = """, below AS (SELECT seq, ancestor AS cell_id, count(*) - 1 AS n FROM anc GROUP BY ALL), kids AS (SELECT seq, parent_id AS cell_id, string_agg(cell_id, ',' ORDER BY cell_id) AS children FROM links GROUP BY ALL),
report AS (SELECT t.seq, t.cell_id, t.start_frame, t.end_frame, t.end_frame - t.start_frame + 1 AS lifespan, CASE WHEN tree.depth > 0 THEN l.parent_id END AS parent, kids.children, tree.root_id, cast(tree.depth AS BIGINT) AS generation, cast(tree.depth AS BIGINT) AS n_ancestors, coalesce(below.n, 0) AS n_descendants,
  CASE WHEN tree.cell_id IS NULL THEN 'Ring' WHEN tree.depth = 0 AND kids.children IS NULL THEN 'Single' WHEN tree.depth = 0 THEN 'Root' WHEN kids.children IS NULL THEN 'Terminal' ELSE 'Intermediate' END AS position, replace(tree.path, '/', ' → ') AS chain
  FROM tk t LEFT JOIN tree ON tree.seq = t.seq AND tree.cell_id = t.cell_id LEFT JOIN links l ON l.seq = t.seq AND l.cell_id = t.cell_id LEFT JOIN kids ON kids.seq = t.seq AND kids.cell_id = t.cell_id LEFT JOIN below ON below.seq = t.seq AND below.cell_id = t.cell_id)"""

ORACLE = {
    "arranged": f"{_O} SELECT seq, cell_id, label, area, volume, x, y, frame FROM obs WHERE x IS NOT NULL AND y IS NOT NULL",
    "interpolate_positions": f"""{_O}, k AS (SELECT seq, cell_id, frame, x, y, x IS NULL OR y IS NULL AS filled, max(CASE WHEN x IS NOT NULL THEN frame END) OVER p AS fxp, min(CASE WHEN x IS NOT NULL THEN frame END) OVER n AS fxn, max(CASE WHEN y IS NOT NULL THEN frame END) OVER p AS fyp, min(CASE WHEN y IS NOT NULL THEN frame END) OVER n AS fyn FROM obs
      WINDOW p AS (PARTITION BY seq, cell_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY seq, cell_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
      SELECT k.seq, k.cell_id, k.frame, round(coalesce(k.x, xp.x + (xn.x - xp.x) * (k.frame - fxp) / (fxn - fxp), xp.x, xn.x), 6) AS x, round(coalesce(k.y, yp.y + (yn.y - yp.y) * (k.frame - fyp) / (fyn - fyp), yp.y, yn.y), 6) AS y, filled FROM k
      LEFT JOIN obs xp ON xp.seq = k.seq AND xp.cell_id = k.cell_id AND xp.frame = fxp LEFT JOIN obs xn ON xn.seq = k.seq AND xn.cell_id = k.cell_id AND xn.frame = fxn LEFT JOIN obs yp ON yp.seq = k.seq AND yp.cell_id = k.cell_id AND yp.frame = fyp LEFT JOIN obs yn ON yn.seq = k.seq AND yn.cell_id = k.cell_id AND yn.frame = fyn""",
    "speed": f"{_O}, k AS (SELECT *, max(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN frame END) OVER (PARTITION BY seq, cell_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fp FROM obs) SELECT k.seq, k.cell_id, k.frame, round(sqrt((k.x - p.x) ** 2 + (k.y - p.y) ** 2), 6) AS speed, round(sqrt(k.x ** 2 + k.y ** 2), 6) AS displacement FROM k LEFT JOIN obs p ON p.seq = k.seq AND p.cell_id = k.cell_id AND p.frame = k.fp",
    "label_carry_forward": f"{_O} SELECT seq, cell_id, frame, last_value(CASE WHEN label IN (0, 1) THEN label END IGNORE NULLS) OVER (PARTITION BY seq, cell_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM obs",
    "missing_frames": f"{_C}{_MISSING} SELECT * FROM miss",
    "gap_runs": f"{_C}{_MISSING} SELECT * FROM gaps",
    "continuity": f"{_C}{_MISSING}, x AS (SELECT t.seq, t.cell_id, t.start_frame, t.end_frame - t.start_frame + 1 AS n, coalesce(n_gaps, 0) AS g, coalesce(longest, 0) AS longest, coalesce(n_missing, 0) AS ms FROM tk t LEFT JOIN gaps ON gaps.seq = t.seq AND gaps.cell_id = t.cell_id WHERE t.end_frame >= t.start_frame), y AS (SELECT seq, cell_id, longest, least(CASE WHEN start_frame <= 150 THEN 1 WHEN start_frame <= 303 THEN 2 ELSE 3 END, CASE WHEN g + 1 >= 20 THEN 1 WHEN g + 1 >= 10 THEN 2 ELSE 3 END, CASE WHEN (n - ms) / n >= 0.9 THEN 3 WHEN (n - ms) / n >= 0.7 THEN 2 ELSE 1 END) AS allowed FROM x) SELECT *, longest <= allowed AS continuous FROM y",
    "nearest_frame_fill": f"{_O}, h AS (SELECT DISTINCT seq, frame FROM obs), a AS (SELECT s.seq, cast(g.f AS INTEGER) AS frame FROM (SELECT DISTINCT seq FROM obs) s CROSS JOIN range(0, 401) g(f)) SELECT a.seq, a.frame, arg_min(h.frame, abs(h.frame - a.frame) * 1000 + h.frame) AS source FROM a JOIN h ON h.seq = a.seq GROUP BY ALL",
    "spatial_neighbours": f"{_O} SELECT a.seq, a.frame, a.cell_id AS a, b.cell_id AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM obs a JOIN obs b ON b.seq = a.seq AND b.frame = a.frame AND a.cell_id < b.cell_id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 50",
    "frame_counts": f"{_C}, rr AS (SELECT DISTINCT seq, cell_id FROM obs WHERE label = 1), pp AS (SELECT DISTINCT seq, parent_id AS cell_id FROM tk WHERE parent_id IS NOT NULL AND end_frame >= start_frame), x AS (SELECT t.seq, cast(g.f AS INTEGER) AS frame, rr.cell_id IS NOT NULL AS r, pp.cell_id IS NOT NULL AND g.f = t.end_frame AS s, o.cell_id IS NOT NULL AS v FROM tk t JOIN range(0, 2000) g(f) ON g.f BETWEEN t.start_frame AND t.end_frame LEFT JOIN rr ON rr.seq = t.seq AND rr.cell_id = t.cell_id LEFT JOIN pp ON pp.seq = t.seq AND pp.cell_id = t.cell_id LEFT JOIN obs o ON o.seq = t.seq AND o.cell_id = t.cell_id AND o.frame = g.f) SELECT seq, frame, count(*) FILTER (r AND v) AS ips, count(*) FILTER (NOT r AND v) AS normal, count(*) FILTER (r AND v AND s) AS divided_ips, count(*) FILTER (NOT r AND v AND s) AS divided_normal, count(*) FILTER (r AND NOT v) AS missing_ips, count(*) FILTER (NOT r AND NOT v) AS missing_normal, count(*) AS total FROM x GROUP BY ALL",
    "overall_counts": f"{_O}, k AS (SELECT seq, cell_id, max(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS rare, min(fov) AS fov, count(*) AS n FROM obs GROUP BY ALL) SELECT fov, rare, count(*) AS n_cells, cast(sum(n) AS BIGINT) AS n_rows FROM k GROUP BY ROLLUP (fov, rare)",
    "lineage_report": f"{_C}{_CLASS}{_REPORT} SELECT * FROM report",
    "families": f"{_C}{_CLASS}{_REPORT} SELECT seq, root_id, count(*) AS members, max(generation) AS generations, round(avg(lifespan), 6) AS mean_lifespan, min(start_frame) AS first_frame, max(end_frame) AS last_frame FROM report WHERE root_id IS NOT NULL GROUP BY ALL",
    "reported_levels": f"{_C} SELECT cast(r.reported - tree.depth AS BIGINT) AS off, count(*) AS n FROM (SELECT DISTINCT seq, Cell_ID AS cell_id, Generation_Level AS reported FROM detailed_lineage) r LEFT JOIN tree ON tree.seq = r.seq AND tree.cell_id = r.cell_id GROUP BY ALL",
    "phase_counts": f"{_O}, x AS (SELECT *, {_PHASE} AS phase FROM obs) SELECT phase, count(*) AS n_rows, count(DISTINCT (seq, cell_id)) AS n_cells, round(avg(CASE WHEN label = 1 THEN 1 ELSE 0 END), 6) AS share, printf('%dh%02dmin', min(frame) * 10 // 60, min(frame) * 10 % 60) AS begins, printf('%dh%02dmin', max(frame) * 10 // 60, max(frame) * 10 % 60) AS ends FROM x GROUP BY phase",
    "track_quality": f"{_O}, x AS (SELECT *, frame - lag(frame) OVER w AS gap, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS jump FROM obs WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY seq, cell_id ORDER BY frame)) SELECT seq, cell_id, count(*) AS n, round(count(*) / (max(frame) - min(frame) + 1), 6) AS completeness, max(gap) AS largest_gap, round(max(jump), 6) AS largest_jump, round(sqrt((arg_max(x, frame) - arg_min(x, frame)) ** 2 + (arg_max(y, frame) - arg_min(y, frame)) ** 2), 6) AS way, round(stddev_pop(area) / nullif(avg(area), 0), 6) AS area_variation FROM x GROUP BY ALL",
    "moving_tracks": f"{_O}, x AS (SELECT seq, cell_id, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM obs WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY seq, cell_id ORDER BY frame)), t AS (SELECT seq, cell_id, count(*) AS n, (sqrt(sum(dx * dx)) + sqrt(sum(dy * dy))) / 2 AS movement FROM x GROUP BY ALL), md AS (SELECT seq, median(n) AS md FROM t GROUP BY seq) SELECT t.seq, cell_id, n, round(movement, 6) AS movement FROM t JOIN md ON md.seq = t.seq WHERE n >= greatest(3, 0.3 * md) AND coalesce(movement, 0) < 204.8",
    "daughter_candidates": f"{_O}{_ENDS} SELECT seq, parent, daughter, round(distance, 6) AS distance, round(ratio, 6) AS ratio FROM cand",
    "daughter_pairs": f"{_O}{_ENDS}, pr AS (SELECT a.seq, a.parent, a.daughter AS a, b.daughter AS b, sqrt((a.x0 - b.x0) ** 2 + (a.y0 - b.y0) ** 2) AS sibling, abs(a.ratio + b.ratio - 1) AS error FROM cand a JOIN cand b ON b.seq = a.seq AND b.parent = a.parent AND a.daughter < b.daughter) SELECT seq, parent, a, b, round(sibling, 6) AS sibling, round(error, 6) AS error FROM (SELECT *, row_number() OVER (PARTITION BY seq, parent ORDER BY error, sibling, a, b) AS rn FROM pr WHERE sibling BETWEEN 10 AND 300 AND error <= 0.5) WHERE rn = 1",
    "feature_stats": f"{_O} SELECT seq, cell_id, " + ", ".join(f"count({v}) AS {v}_n, round(avg({v}), 6) AS {v}_mean, round(stddev_pop({v}), 6) AS {v}_std, round(min({v}), 6) AS {v}_min, round(max({v}), 6) AS {v}_max" for v in ("area", "volume")) + " FROM obs GROUP BY ALL",
    "track_integrity": f"""{_C}, v AS (SELECT seq, 'ends_before_birth' AS "check" FROM tk WHERE end_frame < start_frame UNION ALL SELECT k.seq, 'parent_missing' FROM tk k WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tk p WHERE p.seq = k.seq AND p.cell_id = k.parent_id) UNION ALL SELECT k.seq, 'parent_ends_late' FROM tk k JOIN tk p ON p.seq = k.seq AND p.cell_id = k.parent_id WHERE p.end_frame >= k.start_frame UNION ALL SELECT seq, 'own_parent' FROM tk WHERE parent_id = cell_id) SELECT seq, "check", count(*) AS n FROM v GROUP BY ALL""",
    "backward_trace": f"{_C}{_CLASS} SELECT * FROM back",
    "forward_trace": f"{_C}{_CLASS} SELECT * FROM fwd",
    "label_setops": f"{_C}{_CLASS} SELECT seq, cell_id, CASE WHEN count(*) = 2 THEN 'both' ELSE any_value(t) END AS traces FROM (SELECT *, 'backward' AS t FROM back UNION ALL SELECT *, 'forward' FROM fwd) GROUP BY seq, cell_id",
    "failed_progenitors": f"{_C}{_CLASS}, f AS (SELECT seq, cell_id FROM (SELECT seq, cell_id, label, row_number() OVER (PARTITION BY seq, cell_id ORDER BY frame) AS rn FROM obs WHERE label IS NOT NULL) WHERE rn = 1 AND label = 1), kept AS (SELECT DISTINCT a.seq, a.ancestor AS cell_id FROM anc a JOIN obs o ON o.seq = a.seq AND o.cell_id = a.cell_id WHERE o.label = 1 AND o.frame >= 350) SELECT t.seq, t.cell_id FROM tk t JOIN f ON f.seq = t.seq AND f.cell_id = t.cell_id WHERE t.end_frame < 250 AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.seq = t.seq AND k.cell_id = t.cell_id)",
    "retrospective_labels": f"{_C}{_CLASS} SELECT o.seq, CASE WHEN k.cell_id IS NULL THEN 0 ELSE 1 END AS retro, count(*) AS n_rows, count(DISTINCT o.cell_id) AS n_cells FROM obs o LEFT JOIN kin k ON k.seq = o.seq AND k.cell_id = o.cell_id GROUP BY ALL",
    "phase_labels": f"{_C}{_CLASS} SELECT {_PHASE} AS phase, CASE WHEN k.cell_id IS NULL THEN 0 ELSE 1 END AS retro, count(DISTINCT (o.seq, o.cell_id)) AS n_cells FROM obs o LEFT JOIN kin k ON k.seq = o.seq AND k.cell_id = o.cell_id GROUP BY ALL",
}

_CONT = ORACLE["continuity"].removesuffix(" SELECT *, longest <= allowed AS continuous FROM y") + ", cont AS (SELECT *, longest <= allowed AS continuous FROM y)"
_FINAL = f"""{_CONT}{_CLASS}, lab AS (SELECT DISTINCT seq, cell_id FROM obs WHERE label = 1), lab0 AS (SELECT DISTINCT l.* FROM lab l JOIN obs o ON o.seq = l.seq AND o.cell_id = l.cell_id AND o.frame = 0),
gt AS (SELECT * FROM lab0 UNION SELECT * FROM lab WHERE seq NOT IN (SELECT seq FROM lab0)), det AS (SELECT DISTINCT seq, cell_id FROM obs WHERE label = 1 AND frame >= 350), lk AS (SELECT DISTINCT seq FROM links),
seeds AS (SELECT * FROM det WHERE seq NOT IN (SELECT seq FROM lk) UNION SELECT * FROM gt WHERE seq NOT IN (SELECT seq FROM lk)),
chosen AS (SELECT a.seq, a.ancestor AS cell_id FROM anc a JOIN det d ON d.seq = a.seq AND d.cell_id = a.cell_id UNION SELECT * FROM det UNION SELECT * FROM gt
  UNION SELECT a.seq, a.cell_id FROM anc a JOIN gt g ON g.seq = a.seq AND g.cell_id = a.ancestor JOIN cont c ON c.seq = a.seq AND c.cell_id = a.cell_id AND c.continuous WHERE a.seq IN (SELECT seq FROM lk)
  UNION SELECT b.seq, b.cell_id FROM obs a JOIN seeds s ON s.seq = a.seq AND s.cell_id = a.cell_id JOIN obs b ON b.seq = a.seq AND b.frame = a.frame AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 50),
every AS (SELECT coalesce(t.seq, o.seq) AS seq, coalesce(t.cell_id, o.cell_id) AS cell_id, t.start_frame FROM tk t FULL JOIN (SELECT DISTINCT seq, cell_id FROM obs) o ON o.seq = t.seq AND o.cell_id = t.cell_id),
final AS (SELECT *, CASE WHEN reason IN ('none', 'gap') THEN 0 ELSE 1 END AS label FROM (SELECT e.seq, e.cell_id, CASE WHEN g.cell_id IS NOT NULL THEN 'ground truth' WHEN k.cell_id IS NULL OR e.start_frame = 0 THEN 'none' WHEN e.start_frame IS NULL THEN 'rows only' WHEN c.continuous THEN 'continuous' ELSE 'gap' END AS reason
  FROM every e LEFT JOIN gt g ON g.seq = e.seq AND g.cell_id = e.cell_id LEFT JOIN chosen k ON k.seq = e.seq AND k.cell_id = e.cell_id LEFT JOIN cont c ON c.seq = e.seq AND c.cell_id = e.cell_id))"""
ORACLE |= {
    "ground_truth_cells": f"{_O}, lab AS (SELECT DISTINCT seq, cell_id FROM obs WHERE label = 1), lab0 AS (SELECT DISTINCT l.* FROM lab l JOIN obs o ON o.seq = l.seq AND o.cell_id = l.cell_id AND o.frame = 0) SELECT * FROM lab0 UNION SELECT * FROM lab WHERE seq NOT IN (SELECT seq FROM lab0)",
    "cell_labels": f"{_FINAL} SELECT seq, cell_id, label, reason FROM final",
    "labelled_rows": f"{_FINAL} SELECT o.seq, o.cell_id, o.area, o.volume, o.x, o.y, o.frame, f.label FROM obs o JOIN final f ON f.seq = o.seq AND f.cell_id = o.cell_id WHERE x IS NOT NULL AND y IS NOT NULL",
    "validated_cells": f"{_CONT}, ok AS (SELECT seq, cell_id FROM cont WHERE continuous UNION SELECT k.seq, k.cell_id FROM ok JOIN links k ON k.seq = ok.seq AND k.parent_id = ok.cell_id JOIN cont c ON c.seq = k.seq AND c.cell_id = k.cell_id WHERE c.longest = c.allowed + 1) SELECT c.seq, c.cell_id, ok.cell_id IS NOT NULL AS stands, c.continuous AS own FROM cont c LEFT JOIN ok ON ok.seq = c.seq AND ok.cell_id = c.cell_id",
    "missing_cells": f"{_C}{_MISSING} SELECT seq, frame, count(*) AS n, string_agg(cell_id, ',' ORDER BY cell_id) AS cells FROM miss GROUP BY ALL",
    "steady_tracks": f"{_O} SELECT seq, cell_id, count(*) AS n, round(median(x), 6) AS x, round(median(y), 6) AS y, round(avg(area), 6) AS area FROM obs WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL HAVING count(*) >= 5",
    "all_cells": f"{_C} SELECT coalesce(t.seq, o.seq) AS seq, coalesce(t.cell_id, o.cell_id) AS cell_id, CASE WHEN o.cell_id IS NULL THEN 'track' WHEN t.cell_id IS NULL THEN 'rows' ELSE 'both' END AS known FROM (SELECT DISTINCT seq, cell_id FROM tk) t FULL JOIN (SELECT DISTINCT seq, cell_id FROM obs) o ON o.seq = t.seq AND o.cell_id = t.cell_id",
    "generation_lists": f"{_C}, below AS (SELECT l.seq, l.parent_id AS cell_id, l.cell_id AS kid, 1 AS k FROM links l JOIN tree t ON t.seq = l.seq AND t.cell_id = l.cell_id UNION ALL SELECT b.seq, b.cell_id, l.cell_id, b.k + 1 FROM below b JOIN links l ON l.seq = b.seq AND l.parent_id = b.kid), g AS (SELECT seq, cell_id, k, string_agg(kid, ', ' ORDER BY kid) AS members FROM below GROUP BY ALL) SELECT seq, cell_id, string_agg('Gen+' || k || ': ' || members, ' | ' ORDER BY k) AS generations FROM g GROUP BY ALL",
    "kept_tracks": f"{_C} SELECT t.seq, t.cell_id, t.start_frame, t.end_frame FROM tk t WHERE t.start_frame IS DISTINCT FROM t.end_frame OR EXISTS (SELECT 1 FROM tk p WHERE p.seq = t.seq AND p.cell_id = t.parent_id) OR EXISTS (SELECT 1 FROM tk k WHERE k.seq = t.seq AND k.parent_id = t.cell_id)",
    "class_by_frame": f"{_O} SELECT frame, {_PHASE} AS phase, count(*) FILTER (label = 1) AS rare, count(*) FILTER (label = 0) AS common, count(*) FILTER (label IS NULL) AS unknown FROM obs GROUP BY frame",
    "lineage_tracks": f"{_C}{_CLASS}{_REPORT} SELECT r.seq, r.cell_id, lifespan AS track_length, CASE WHEN children IS NOT NULL THEN end_frame END AS division_frame, EXISTS (SELECT 1 FROM obs o WHERE o.seq = r.seq AND o.cell_id = r.cell_id) AS detected, generation, position FROM report r",
}
