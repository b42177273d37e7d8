"""The queries of the general problems: hierarchies, regular grid, orphans, packed fields, implausible readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import grid, hierarchy, orphans, packed, spikes
from ..session import in_force, stage, table

LAST_FRAME, LAST_PIXEL = 400, 1023
_TIE = 1e-9  # positions have few decimals, so that cubics often lie on a tie of the rounding
MEASURES = [
    spikes.Measure("Area", low=0, low_open=True, log=True, floor=0.02),
    spikes.Measure("Volume", low=0, low_open=True, log=True, floor=0.02),
    spikes.Measure("X", low=0, high=LAST_PIXEL, floor=0.7),
    spikes.Measure("Y", low=0, high=LAST_PIXEL, floor=0.7),
]


def tracks_in_force(spark: SparkSession, d: str) -> DataFrame:
    """seq, cell_id, parent_id, status, loaded_at, first (the earliest loaded_at), live (not deleted; a NULL status is live)."""
    t = table(spark, d, "res_track").where("seq is not null and cell_id is not null")
    last = F.max(F.struct("loaded_at", "parent_id", "status", "start_frame", "end_frame", "fov")).alias("last")
    t = t.groupBy("seq", "cell_id").agg(last, F.min("loaded_at").alias("first"))
    return t.select("seq", "cell_id", "last.*", "first", F.coalesce(F.lower(F.trim("last.status")) != "deleted", F.lit(True)).alias("live"))


def existing_cells(spark: SparkSession, d: str) -> DataFrame:
    t = tracks_in_force(spark, d).where("live")
    return t.select("seq", "cell_id", F.when(F.col("parent_id") != 0, F.col("parent_id")).alias("parent_id"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    f = hierarchy.forest(existing_cells(spark, d), "seq", "cell_id", "parent_id")
    return f.where("ring is not null").select("seq", "cell_id", F.col("ring").alias("cycle_id"))


def p1_forest(spark: SparkSession, d: str) -> DataFrame:
    f = hierarchy.forest(existing_cells(spark, d), "seq", "cell_id", "parent_id")
    return f.select("seq", "cell_id", F.col("root").alias("root_id"), "depth", F.col("ring").alias("cycle_id"))


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    p = hierarchy.paths(existing_cells(spark, d), "seq", "cell_id", "parent_id")
    return p.select("seq", "cell_id", F.col("root").alias("root_id"), "depth", F.array_join("path", "/").alias("path"), F.col("ring").alias("cycle_id"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    p = hierarchy.paths(existing_cells(spark, d), "seq", "cell_id", "parent_id")
    return hierarchy.descendants(p, "seq", "cell_id").select("seq", "cell_id", F.col("descendant").alias("descendant_id"), F.col("distance").cast("long").alias("distance"))


def readings(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    """Rows in force of features by (seq, Cell ID, Frame), frames 0..400, NULL keys left out."""
    t = table(spark, d, "features").where(F.col("seq").isNotNull() & F.col("Cell ID").isNotNull() & F.col("Frame").between(0, LAST_FRAME))
    return in_force(t, ["seq", "Cell ID", "Frame"], columns).withColumnsRenamed({"Cell ID": "cell_id", "Frame": "frame"})


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    g = grid.regular_grid(readings(spark, d, ["X", "Y"]), ["seq", "cell_id"], "frame", ["X", "Y"])
    return g.select("seq", "cell_id", "frame", F.round(F.col("X") + _TIE, 6).alias("x"), F.round(F.col("Y") + _TIE, 6).alias("y"), "status")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    g = grid.regular_grid(readings(spark, d, ["X", "Y"]), ["seq", "cell_id"], "frame", ["X", "Y"])
    return g.where("status != 'observed'").select("seq", "cell_id", "frame")


def parent_references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = stage(tracks_in_force(spark, d).select("seq", "cell_id", "parent_id", "live", "first", "loaded_at"))
    refs = t.where("live and parent_id != 0").select(F.col("seq").alias("g"), F.col("cell_id").alias("child"), F.col("parent_id").alias("key"), F.col("loaded_at").alias("at"))
    return refs, t.select(F.col("seq").alias("g"), F.col("cell_id").alias("key"), "live", "first")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    refs, keys = parent_references(spark, d)
    return orphans.orphans(refs, keys).select(F.col("g").alias("seq"), F.col("child").alias("cell_id"), F.col("key").alias("parent_id"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    refs, keys = parent_references(spark, d)
    r = orphans.orphan_report(orphans.orphans(refs, keys), refs, "res_track")
    return r.withColumn("period", F.date_format("period", "yyyy-MM"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "detailed_lineage").select(F.col("lineage_id").alias("rec_id"), F.col("Direct_Children").alias("packed"))
    b = table(spark, d, "features").select(F.col("obs_id").alias("rec_id"), F.col("Daughter IDs").alias("packed"))
    both = a.withColumn("tab", F.lit("detailed_lineage")).unionByName(b.withColumn("tab", F.lit("features"))).where("packed is not null")
    rows = packed.split_numbers(both, ["tab", "rec_id"], "packed")
    return rows.distinct()


def p7_flags(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible(readings(spark, d, [m.name for m in MEASURES]), ["seq", "cell_id"], "frame", MEASURES)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_flags(spark, d).select("seq", "cell_id", "frame", "field")


QUERIES = {f.__name__: f for f in (p1_found, p1_forest, p1_paths, p1_descendants, p2_found, p2_grid, p4_found, p4_report, p5_found, p7_found, p7_flags)}

_EXISTING = """
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq, cell_id ORDER BY loaded_at DESC NULLS LAST, parent_id DESC NULLS LAST, status DESC) AS rn,
  min(loaded_at) OVER (PARTITION BY seq, cell_id) AS first_at FROM res_track WHERE seq IS NOT NULL AND cell_id IS NOT NULL) WHERE rn = 1),
cells AS (SELECT seq, cell_id, nullif(parent_id, 0) AS parent_id FROM last WHERE coalesce(lower(trim(status)) <> 'deleted', true)),
links AS (SELECT c.seq, c.cell_id, p.cell_id AS parent_id FROM cells c JOIN cells p ON p.seq = c.seq AND p.cell_id = c.parent_id),
roots AS (SELECT seq, cell_id FROM cells EXCEPT SELECT seq, cell_id FROM links),
tree AS (SELECT seq, cell_id, cell_id AS root_id, 0 AS depth, cast(cell_id AS VARCHAR) AS path FROM roots
  UNION ALL SELECT l.seq, l.cell_id, t.root_id, t.depth + 1, t.path || '/' || l.cell_id FROM tree t JOIN links l ON l.seq = t.seq AND l.parent_id = t.cell_id),
endless AS (SELECT seq, cell_id FROM cells EXCEPT SELECT seq, cell_id FROM tree),
walk AS (SELECT seq, cell_id, cell_id AS at FROM endless
  UNION SELECT w.seq, w.cell_id, l.parent_id FROM walk w JOIN links l ON l.seq = w.seq AND l.cell_id = w.at),
onring AS (SELECT DISTINCT w.seq, w.cell_id FROM walk w JOIN links l ON l.seq = w.seq AND l.cell_id = w.at AND l.parent_id = w.cell_id),
rings AS (SELECT w.seq, w.cell_id, min(w.at) AS cycle_id FROM walk w JOIN onring r ON r.seq = w.seq AND r.cell_id = w.at GROUP BY 1, 2)
"""

_READINGS = """
force AS (SELECT seq, "Cell ID" AS cell_id, Frame AS frame, X, Y, Area, Volume FROM (SELECT *, row_number() OVER (PARTITION BY seq, "Cell ID", Frame ORDER BY loaded_at DESC NULLS LAST) AS rn
  FROM features WHERE seq IS NOT NULL AND "Cell ID" IS NOT NULL AND Frame BETWEEN 0 AND 400) WHERE rn = 1)
"""

_FLAGS = f"""WITH {_READINGS},
long AS (SELECT seq, cell_id, frame, 'Area' AS field, Area AS v FROM force UNION ALL SELECT seq, cell_id, frame, 'Volume', Volume FROM force
  UNION ALL SELECT seq, cell_id, frame, 'X', X FROM force UNION ALL SELECT seq, cell_id, frame, 'Y', Y FROM force),
read AS (SELECT *, lag(v) OVER (PARTITION BY seq, cell_id, field ORDER BY frame) AS pv FROM long WHERE v IS NOT NULL AND NOT isnan(v)),
runs AS (SELECT *, sum(CASE WHEN pv IS NULL OR pv <> v THEN 1 ELSE 0 END) OVER (PARTITION BY seq, cell_id, field ORDER BY frame) AS run FROM read),
sized AS (SELECT *, count(*) OVER (PARTITION BY seq, cell_id, field, run) AS n FROM runs),
first AS (SELECT seq, cell_id, frame, field, v, CASE WHEN field IN ('Area', 'Volume') AND v <= 0 OR field IN ('X', 'Y') AND (v < 0 OR v > 1023) THEN 'impossible' WHEN n >= 6 THEN 'stuck' END AS kind FROM sized),
free AS (SELECT seq, cell_id, frame, field, v, CASE WHEN field IN ('X', 'Y') THEN v ELSE ln(v) END AS x, CASE WHEN field IN ('X', 'Y') THEN 0.7 ELSE 0.02 END AS least FROM first WHERE kind IS NULL),
sides AS (SELECT *, median(x) OVER b AS mb, median(frame) OVER b AS tb, median(x) OVER a AS ma, median(frame) OVER a AS ta FROM free
  WINDOW b AS (PARTITION BY seq, cell_id, field ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY seq, cell_id, field ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
offs AS (SELECT *, x - (mb + (ma - mb) * (frame - tb) / (ta - tb)) AS off FROM sides),
scaled AS (SELECT *, greatest(least, 1.4826 * median(abs(off)) OVER (PARTITION BY seq, cell_id, field)) AS scale FROM offs),
spikes AS (SELECT * FROM scaled WHERE (x - mb) * (x - ma) > 0 AND abs(x - mb) > 6 * scale AND abs(x - ma) > 6 * scale AND abs(off) > 6 * scale),
flags AS (SELECT seq, cell_id, frame, field, kind, v AS value FROM first WHERE kind IS NOT NULL UNION ALL SELECT seq, cell_id, frame, field, 'spike', v FROM spikes)
"""



def _cubic(v: str) -> str:
    """The monotone cubic of p2 in SQL at step ``g.f`` between knots t and tn, out of the columns of ``knots``."""
    d0, d1, d2 = f"(({v} - {v}b) / h0)", f"(({v}n - {v}) / h1)", f"(({v}nn - {v}n) / h2)"

    def end(ha: str, da: str, hb: str, db: str) -> str:
        three = f"(((2 * {ha} + {hb}) * {da} - {ha} * {db}) / ({ha} + {hb}))"
        return f"CASE WHEN {hb} IS NULL THEN {da} WHEN {three} * {da} <= 0 THEN 0 WHEN {da} * {db} <= 0 AND abs({three}) > 3 * abs({da}) THEN 3 * {da} ELSE {three} END"

    def slope(hl: str, dl: str, hr: str, dr: str, other: str, at_end: str) -> str:
        return f"(CASE WHEN {other} IS NULL THEN {at_end} WHEN {dl} * {dr} <= 0 THEN 0 ELSE 3 * ({hl} + {hr}) / ((2 * {hr} + {hl}) / {dl} + ({hr} + 2 * {hl}) / {dr}) END)"

    m1, m2 = slope("h0", d0, "h1", d1, "h0", end("h1", d1, "h2", d2)), slope("h1", d1, "h2", d2, "h2", end("h1", d1, "h0", d0))
    s = "((g.f - t) / h1)"
    return f"CASE WHEN g.f = t THEN {v} WHEN h1 <= 20 THEN {v} * (1 + 2 * {s}) * (1 - {s}) ** 2 + {m1} * h1 * {s} * (1 - {s}) ** 2 + {v}n * {s} ** 2 * (3 - 2 * {s}) + {m2} * h1 * {s} ** 2 * ({s} - 1) END"


_KNOTS = f"""WITH {_READINGS}, pos AS (SELECT seq, cell_id, frame, X AS x, Y AS y FROM force WHERE X IS NOT NULL AND Y IS NOT NULL AND NOT isnan(X) AND NOT isnan(Y)),
near AS (SELECT seq, cell_id, frame AS t, x, y, {", ".join(f"{f}({c}{k}) OVER w AS {'t' if c == 'frame' else c}{n}" for c in ("frame", "x", "y") for f, k, n in (("lag", "", "b"), ("lead", "", "n"), ("lead", ", 2", "nn")))} FROM pos WINDOW w AS (PARTITION BY seq, cell_id ORDER BY frame)),
knots AS (SELECT *, CASE WHEN t - tb <= 20 THEN t - tb END AS h0, coalesce(tn - t, 1) AS h1, CASE WHEN tnn - tn <= 20 THEN tnn - tn END AS h2 FROM near)"""

ORACLE = {
    "p2_grid": f"{_KNOTS} SELECT seq, cell_id, cast(g.f AS INTEGER) AS frame, round({_cubic('x')} + {_TIE}, 6) AS x, round({_cubic('y')} + {_TIE}, 6) AS y, CASE WHEN g.f = t THEN 'observed' WHEN h1 <= 20 THEN 'filled' ELSE 'long_gap' END AS status FROM knots JOIN range(0, 401) g(f) ON g.f >= t AND g.f < t + h1",
    "p1_found": f"WITH RECURSIVE {_EXISTING} SELECT seq, cell_id, cycle_id FROM rings",
    "p1_forest": f"WITH RECURSIVE {_EXISTING} SELECT c.seq, c.cell_id, t.root_id, cast(t.depth AS BIGINT) AS depth, r.cycle_id FROM cells c LEFT JOIN tree t ON t.seq = c.seq AND t.cell_id = c.cell_id LEFT JOIN rings r ON r.seq = c.seq AND r.cell_id = c.cell_id",
    "p1_paths": f"WITH RECURSIVE {_EXISTING} SELECT c.seq, c.cell_id, t.root_id, cast(t.depth AS BIGINT) AS depth, t.path, r.cycle_id FROM cells c LEFT JOIN tree t ON t.seq = c.seq AND t.cell_id = c.cell_id LEFT JOIN rings r ON r.seq = c.seq AND r.cell_id = c.cell_id",
    "p1_descendants": f"WITH RECURSIVE {_EXISTING}, below AS (SELECT l.seq, l.parent_id AS cell_id, l.cell_id AS descendant_id, 1 AS distance FROM links l JOIN tree t ON t.seq = l.seq AND t.cell_id = l.cell_id UNION ALL SELECT b.seq, b.cell_id, l.cell_id, b.distance + 1 FROM below b JOIN links l ON l.seq = b.seq AND l.parent_id = b.descendant_id) SELECT seq, cell_id, descendant_id, cast(distance AS BIGINT) AS distance FROM below",
    "p2_found": f"WITH {_READINGS}, pos AS (SELECT * FROM force WHERE X IS NOT NULL AND Y IS NOT NULL AND NOT isnan(X) AND NOT isnan(Y)), span AS (SELECT seq, cell_id, min(frame) AS a, max(frame) AS b FROM pos GROUP BY 1, 2) SELECT s.seq, s.cell_id, cast(g.f AS INTEGER) AS frame FROM span s JOIN range(0, 401) g(f) ON g.f > s.a AND g.f < s.b WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.seq = s.seq AND p.cell_id = s.cell_id AND p.frame = g.f)",
    "p4_found": f"WITH RECURSIVE {_EXISTING}, r AS (SELECT seq, cell_id, parent_id, loaded_at FROM last WHERE coalesce(lower(trim(status)) <> 'deleted', true) AND parent_id <> 0) SELECT r.seq, r.cell_id, r.parent_id FROM r LEFT JOIN last p ON p.seq = r.seq AND p.cell_id = r.parent_id WHERE p.cell_id IS NULL OR lower(trim(p.status)) = 'deleted' OR p.first_at > r.loaded_at",
    "p4_report": f"WITH RECURSIVE {_EXISTING}, r AS (SELECT seq, cell_id, parent_id, loaded_at FROM last WHERE coalesce(lower(trim(status)) <> 'deleted', true) AND parent_id <> 0), s AS (SELECT strftime(r.loaded_at, '%Y-%m') AS period, CASE WHEN p.cell_id IS NULL THEN 'absent' WHEN lower(trim(p.status)) = 'deleted' THEN 'deleted' WHEN p.first_at > r.loaded_at THEN 'late' END AS state FROM r LEFT JOIN last p ON p.seq = r.seq AND p.cell_id = r.parent_id) SELECT 'res_track' AS tab, period, count(*) AS n_refs, count(*) FILTER (state = 'absent') AS n_absent, count(*) FILTER (state = 'deleted') AS n_deleted, count(*) FILTER (state = 'late') AS n_late FROM s GROUP BY period",
    "p5_found": r"""WITH p AS (SELECT 'detailed_lineage' AS tab, lineage_id AS rec_id, Direct_Children AS s FROM detailed_lineage UNION SELECT 'features', obs_id, "Daughter IDs" FROM features),
      c AS (SELECT tab, rec_id, regexp_extract_all(regexp_replace(regexp_replace(s, '"(\d{1,3}),(\d{3})"', '"\1\2"', 'g'), '(\d)\.0+', '\1', 'g'), '\d+') AS l FROM p WHERE s IS NOT NULL),
      e AS (SELECT tab, rec_id, unnest(l) AS x, generate_subscripts(l, 1) AS pos FROM c) SELECT DISTINCT tab, rec_id, cast(pos AS INTEGER) AS pos, cast(x AS INTEGER) AS child_id FROM e""",
    "p7_found": f"{_FLAGS} SELECT seq, cell_id, frame, field FROM flags",
    "p7_flags": f"{_FLAGS} SELECT seq, cell_id, frame, field, kind, value FROM flags",
}
