"""Queries that track: by overlap of components, by cheapest links between positions, by repeated extension of consensus paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import consensus as k
from ..operators import images as im
from ..operators import tracking as tr
from ..session import stage
from .cells import _O, observations
from .more import _I, _K, _T, image_pixels, tracker_rows
from .scores import rounded


def _objects(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of the bright components with a number per frame (of the first pixel): seq, frame, y, x, label."""
    c = im.components(im.binarized(stage(image_pixels(spark, d))).where("v > 0"))
    return stage(c.select("seq", "frame", "y", "x", (F.col("ty") * 64 + F.col("tx")).alias("label")))


def overlap_links(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tr.overlap_links(_objects(spark, d)))


def overlap_tracks(spark: SparkSession, d: str) -> DataFrame:
    px = _objects(spark, d)
    return tr.tracks_of(px.select("seq", "frame", "label").distinct(), tr.overlap_links(px))


def _positions(spark: SparkSession, d: str) -> DataFrame:
    """Observed positions with an anonymous number per frame, by place: seq, frame, label, x, y, cell_id."""
    o = observations(spark, d).where("x is not null and y is not null").select("seq", "frame", "x", "y", "cell_id")
    return stage(o.withColumn("label", F.row_number().over(Window.partitionBy("seq", "frame").orderBy("x", "y", "cell_id"))))


def link_candidates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tr.near_candidates(_positions(spark, d), 20.0))


def far_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates up to three frames on, for objects that are missed in between."""
    return rounded(tr.near_candidates(_positions(spark, d), 20.0, 3))


def tracked_positions(spark: SparkSession, d: str) -> DataFrame:
    p = _positions(spark, d)
    return tr.tracks_of(p.select("seq", "frame", "label"), tr.cheapest_links(p))


def tracking_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How the tracker's links agree with the cells' own numbers, per seq: links, links within one cell, steps that a cell really makes."""
    p = _positions(spark, d)
    now = p.select("seq", "frame", "label", F.col("cell_id").alias("now"))
    then = p.select("seq", (F.col("frame") + 1).alias("frame"), F.col("label").alias("before"), F.col("cell_id").alias("then"))
    links = tr.cheapest_links(p).join(now, ["seq", "frame", "label"]).join(then, ["seq", "frame", "before"])
    n = links.groupBy("seq").agg(F.count(F.lit(1)).alias("links"), F.count(F.when(F.col("now") == F.col("then"), 1)).alias("right"))
    steps = now.join(then.withColumnRenamed("then", "now"), ["seq", "frame", "now"]).groupBy("seq").agg(F.count(F.lit(1)).alias("steps"))
    return steps.join(n, "seq", "left").na.fill(0)


def extended_paths(spark: SparkSession, d: str) -> DataFrame:
    """Consensus paths extended round by round until none moves: fov, start, gx, gy, rounds, last frame reached."""
    seg = stage(k.segments(tracker_rows(spark, d)))
    path = stage(k.representatives(seg).select("fov", "start", "gx", "gy", "algorithm", "cell_id", "end", "x1", "y1", "area1", F.lit(0).alias("rounds")))
    i = 0
    while True:
        i += 1
        e = k.extensions(path.where(F.col("rounds") == i - 1), seg)
        end = seg.select("fov", F.col("algorithm").alias("via"), F.col("cell_id").alias("next"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("x1").alias("nx"), F.col("y1").alias("ny"), F.col("area1").alias("na"))
        step = path.join(e.select("fov", "start", "gx", "gy", "via", "next"), ["fov", "start", "gx", "gy"], "left").withColumn("s", F.col("end") + 1).join(end, ["fov", "via", "next", "s"], "left")
        on = F.col("e").isNotNull()
        new = stage(step.select("fov", "start", "gx", "gy", "algorithm", "cell_id", F.when(on, F.col("e")).otherwise(F.col("end")).alias("end"), F.when(on, F.col("nx")).otherwise(F.col("x1")).alias("x1"), F.when(on, F.col("ny")).otherwise(F.col("y1")).alias("y1"), F.when(on, F.col("na")).otherwise(F.col("area1")).alias("area1"), F.when(on, F.lit(i)).otherwise(F.col("rounds")).alias("rounds")))
        path = new
        if not path.where(F.col("rounds") == i).limit(1).count():
            break
    return path.select("fov", "start", "gx", "gy", "rounds", F.col("end").alias("reached"))


def division_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The daughters of consensus paths: fov, start, gx, gy, via_a, cell_a, via_b, cell_b, same (tracker), sibling, error."""
    seg = stage(k.segments(tracker_rows(spark, d)))
    return rounded(k.divisions(k.representatives(seg), seg))


QUERIES = {f.__name__: f for f in (overlap_links, overlap_tracks, link_candidates, far_candidates, tracked_positions, tracking_agreement, extended_paths, division_pairs)}

_OV = """, pxl AS (SELECT seq, frame, y, x, cast(ty * 64 + tx AS INTEGER) AS label FROM cc),
gr AS (SELECT DISTINCT p.seq, p.frame, p.label, p.y + i.i AS y, p.x + j.j AS x FROM pxl p CROSS JOIN (VALUES (-1), (0), (1)) i(i) CROSS JOIN (VALUES (-1), (0), (1)) j(j)),
sz AS (SELECT seq, frame, label, count(*) AS size FROM gr GROUP BY ALL),
nn AS (SELECT g.seq, g.frame, g.label, p.label AS before, count(*) AS n FROM gr g JOIN pxl p ON p.seq = g.seq AND p.frame = g.frame - 1 AND p.y = g.y AND p.x = g.x GROUP BY ALL),
lk AS (SELECT seq, frame, label, before, score FROM (SELECT nn.*, n / size AS score, row_number() OVER (PARTITION BY nn.seq, nn.frame, nn.label ORDER BY n / size DESC, before) AS rn FROM nn JOIN sz ON sz.seq = nn.seq AND sz.frame = nn.frame AND sz.label = nn.label WHERE n / size >= 0.1) WHERE rn = 1)"""
_TR = """, ob AS (SELECT DISTINCT seq, frame, label FROM pxl), nd AS (SELECT o.seq, o.frame, o.label, o.frame * 65536 + o.label AS node, (o.frame - 1) * 65536 + l.before AS up FROM ob o LEFT JOIN lk l ON l.seq = o.seq AND l.frame = o.frame AND l.label = o.label),
n2 AS (SELECT *, CASE WHEN up IS NOT NULL AND count(*) OVER (PARTITION BY seq, up) = 1 THEN up END AS only_up FROM nd),
go AS (SELECT seq, frame, label, node, node AS track FROM n2 WHERE only_up IS NULL UNION ALL SELECT n.seq, n.frame, n.label, n.node, g.track FROM go g JOIN n2 n ON n.seq = g.seq AND n.only_up = g.node),
pa AS (SELECT h.seq, h.node AS track, g.track AS parent FROM n2 h JOIN go g ON g.seq = h.seq AND g.node = h.up WHERE h.only_up IS NULL)"""
_PS = """, ps AS (SELECT seq, frame, x, y, cell_id, cast(row_number() OVER (PARTITION BY seq, frame ORDER BY x, y, cell_id) AS INTEGER) AS label FROM obs WHERE x IS NOT NULL AND y IS NOT NULL)"""

ORACLE = {
    "overlap_links": f"{_I}{_K}{_OV} SELECT seq, frame, label, before, round(score, 6) AS score FROM lk",
    "overlap_tracks": f"{_I}{_K}{_OV}{_TR} SELECT g.seq, g.frame, g.label, cast(g.track AS INTEGER) AS track, cast(coalesce(pa.parent, 0) AS INTEGER) AS parent FROM go g LEFT JOIN pa ON pa.seq = g.seq AND pa.track = g.track",
    "link_candidates": f"{_O}{_PS} SELECT b.seq, b.frame, a.label AS a, b.label AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance FROM ps a JOIN ps b ON b.seq = a.seq AND b.frame = a.frame + 1 WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 20",
}
ORACLE |= {
    "division_pairs": f"""{_T}, ca AS (SELECT r.fov, r.start, r.gx, r.gy, s.algorithm AS via, s.cell_id AS cell, s.x0, s.y0, s.area0 / r.area1 AS ratio FROM rep r JOIN seg s ON s.fov = r.fov AND s.start = r."end" + 1 WHERE r.area1 > 0 AND sqrt((s.x0 - r.x1) ** 2 + (s.y0 - r.y1) ** 2) < 400 AND s.area0 / r.area1 > 0.2 AND s.area0 / r.area1 < 0.9),
      dp AS (SELECT a.fov, a.start, a.gx, a.gy, a.via AS via_a, a.cell AS cell_a, b.via AS via_b, b.cell AS cell_b, a.via = b.via AS same, sqrt((a.x0 - b.x0) ** 2 + (a.y0 - b.y0) ** 2) AS sibling, abs(a.ratio + b.ratio - 1) AS error FROM ca a JOIN ca b ON b.fov = a.fov AND b.start = a.start AND b.gx = a.gx AND b.gy = a.gy AND (a.via, a.cell) < (b.via, b.cell))
      SELECT fov, start, gx, gy, via_a, cell_a, via_b, cell_b, same, round(sibling, 6) AS sibling, round(error, 6) AS error FROM (SELECT *, row_number() OVER (PARTITION BY fov, start, gx, gy ORDER BY NOT same, CASE WHEN same THEN via_a ELSE '' END, round(error, 9), round(sibling, 9), via_a, cell_a, via_b, cell_b) AS rn FROM dp WHERE same AND sibling BETWEEN 10 AND 300 AND error <= 0.5 OR NOT same AND sibling BETWEEN 15 AND 350 AND error <= 0.6) WHERE rn = 1""",
    "extended_paths": f"""{_T.replace("WITH rw", "WITH RECURSIVE rw", 1)}, go AS (SELECT fov, start, gx, gy, "end", x1, y1, area1, 0 AS rounds FROM rep UNION ALL SELECT fov, start, gx, gy, e2, nx, ny, na, rounds + 1 FROM
      (SELECT g.*, s."end" AS e2, s.x1 AS nx, s.y1 AS ny, s.area1 AS na, row_number() OVER (PARTITION BY g.fov, g.start, g.gx, g.gy ORDER BY s.n DESC, sqrt((s.x0 - g.x1) ** 2 + (s.y0 - g.y1) ** 2), s.algorithm, s.cell_id) AS rn FROM go g JOIN seg s ON s.fov = g.fov AND s.start = g."end" + 1
        WHERE least(s.area0, g.area1) >= 0.6 * greatest(s.area0, g.area1) AND sqrt((s.x0 - g.x1) ** 2 + (s.y0 - g.y1) ** 2) <= 50) WHERE rn = 1)
      SELECT fov, start, gx, gy, cast(max(rounds) AS INTEGER) AS rounds, max("end") AS reached FROM go GROUP BY ALL""",
    "far_candidates": f"{_O}{_PS} SELECT b.seq, b.frame, a.label AS a, b.label AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS distance, b.frame - a.frame AS step FROM ps a JOIN ps b ON b.seq = a.seq AND b.frame BETWEEN a.frame + 1 AND a.frame + 3 WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 20",
}
