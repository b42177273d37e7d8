"""Projections of the given tables into the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import Comparison, contingency, observed_tracks
from ..session import stage, table


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as pixels: seq, frame, ref, comp and a brightness v. Labels follow the keys; the computed side differs in known places."""
    t = table(spark, d, "lineitem").where(F.col("l_shipdate") < F.lit("2001-09-01").cast("timestamp_ntz"))
    frame = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int")
    t = t.select(
        F.concat(F.lit("L"), (F.col("l_linenumber") % 2).cast("string")).alias("seq"), frame.alias("frame"), (F.col("l_orderkey") % 7).cast("int").alias("idx"),
        (F.col("l_suppkey") % 7).cast("int").alias("alt"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 10).cast("int").alias("h"), F.least(F.col("l_quantity") * 5, F.lit(255.0)).alias("v"))
    seg = F.floor(F.col("frame") / 8).cast("int")
    other = F.when(F.col("alt") == 0, 0).otherwise(seg * 6 + F.col("alt"))
    swapped = F.when((F.col("frame") % 8 >= 5) & F.col("idx").isin(1, 2), 3 - F.col("idx")).otherwise(F.col("idx"))
    comp = F.when((F.col("idx") == 0) & (F.col("h") < 8), 0).when((F.col("idx") > 0) & (F.col("h") < 4 + (F.col("idx") + F.col("frame")) % 5), seg * 6 + swapped).otherwise(other)
    return t.select("seq", "frame", F.when(F.col("idx") == 0, 0).otherwise(seg * 6 + F.col("idx")).alias("ref"), comp.cast("int").alias("comp"), "v")


def _parent() -> F.Column:
    s, p = F.floor((F.col("label") - 1) / 6).cast("int"), ((F.col("label") - 1) % 6).cast("int")
    return F.when(s == 0, 0).when(s % 2 == 1, (s - 1) * 6 + F.floor(p / 2).cast("int") + 1).when(p % 3 == 0, 0).otherwise(F.col("label") - 6).cast("int")


def comparison(spark: SparkSession, d: str) -> Comparison:
    c = contingency(pixels(spark, d))
    return Comparison(c, observed_tracks(c, "ref", _parent()), observed_tracks(c, "comp", _parent()))


def lineage_comparison(spark: SparkSession, d: str) -> Comparison:
    """The existing cells of res_track as reference, and a tracker that errs in known ways as the other side; an object is one pixel.

    The tracker sees the cells of a division late, by the parent's number modulo 4 frames, and until then takes them for the parent; it takes an only child whose number
    is a multiple of 5 for its parent, and misses a cell where number and frame add up to a multiple of 23.
    """
    t = table(spark, d, "res_track").where("seq is not null and cell_id is not null")
    t = t.groupBy("seq", "cell_id").agg(F.max(F.struct("loaded_at", "parent_id", "status", "start_frame", "end_frame")).alias("last")).select("seq", "cell_id", "last.*")
    t = t.where(F.coalesce(F.lower(F.trim("status")) != "deleted", F.lit(True))).where("start_frame >= 0 and end_frame >= start_frame")
    t = stage(t.select("seq", F.col("cell_id").alias("label"), F.col("start_frame").alias("birth"), F.col("end_frame").alias("end"), F.coalesce("parent_id", F.lit(0)).alias("named")))
    there = t.select("seq", F.col("label").alias("named"), F.lit(True).alias("there"))
    kids = t.groupBy("seq", "named").agg(F.count(F.lit(1)).alias("kids"))
    t = t.join(there, ["seq", "named"], "left").join(kids, ["seq", "named"]).withColumn("parent", F.when(F.col("there") & (F.col("named") != F.col("label")), F.col("named")).otherwise(0))
    t = stage(t.select("seq", "label", "birth", "end", "parent", "kids", ((F.col("parent") > 0) & (F.col("kids") == 1) & (F.col("label") % 5 == 0)).alias("taken")))
    x = t.select("*", F.explode(F.sequence("birth", "end")).alias("frame"))
    late = (F.col("parent") > 0) & (F.col("kids") > 1) & (F.col("frame") < F.col("birth") + F.col("parent") % 4)
    comp = F.when((F.col("label") + F.col("frame")) % 23 == 0, 0).when(late | F.col("taken"), F.col("parent")).otherwise(F.col("label"))
    c = contingency(x.select("seq", "frame", F.col("label").alias("ref"), comp.cast("int").alias("comp")))
    # a cell taken for its parent hands its children on
    to = t.select("seq", F.col("label").alias("parent"), F.when(F.col("taken"), F.col("parent")).otherwise(F.col("label")).alias("up"))
    up = t.join(to, ["seq", "parent"], "left").select("seq", "label", F.coalesce("up", F.lit(0)).alias("parent"))
    seen = observed_tracks(c, "comp", F.lit(0)).drop("parent").join(up, ["seq", "label"])
    return Comparison(c, t.select("seq", "label", "birth", "end", "parent"), stage(seen.select("seq", "label", "birth", "end", "parent")))


#: The same projections in SQL: px, cont, m (matches), vr, vc (objects), tr, tc (tracks).
SQL = """
p0 AS (SELECT 'L' || cast(l_linenumber % 2 AS VARCHAR) AS seq, cast((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER) AS frame, cast(l_orderkey % 7 AS INTEGER) AS idx,
  cast(l_suppkey % 7 AS INTEGER) AS alt, cast((l_partkey * 7 + l_suppkey) % 10 AS INTEGER) AS h, least(l_quantity * 5, 255) AS v FROM lineitem WHERE l_shipdate < TIMESTAMP '2001-09-01'),
p1 AS (SELECT *, frame // 8 AS seg FROM p0),
px AS (SELECT seq, frame, CASE WHEN idx = 0 THEN 0 ELSE seg * 6 + idx END AS ref, CASE WHEN idx = 0 AND h < 8 THEN 0
  WHEN idx > 0 AND h < 4 + (idx + frame) % 5 THEN seg * 6 + CASE WHEN frame % 8 >= 5 AND idx IN (1, 2) THEN 3 - idx ELSE idx END WHEN alt = 0 THEN 0 ELSE seg * 6 + alt END AS comp, v FROM p1),
cont AS (SELECT seq, frame, ref, comp, count(*) AS n FROM px GROUP BY ALL),
m AS (SELECT seq, frame, ref, comp, n AS inter, ra AS ref_area, ca AS comp_area, n / (ra + ca - n) AS iou FROM (SELECT *, cast(sum(n) OVER (PARTITION BY seq, frame, ref) AS BIGINT) AS ra, cast(sum(n) OVER (PARTITION BY seq, frame, comp) AS BIGINT) AS ca FROM cont) WHERE ref <> 0 AND comp <> 0 AND 2 * n > ra),
vr AS (SELECT DISTINCT seq, frame, ref AS label FROM px WHERE ref <> 0), vc AS (SELECT DISTINCT seq, frame, comp AS label FROM px WHERE comp <> 0),
tr0 AS (SELECT seq, label, min(frame) AS birth, max(frame) AS "end", (label - 1) // 6 AS s, (label - 1) % 6 AS p FROM vr GROUP BY seq, label),
tc0 AS (SELECT seq, label, min(frame) AS birth, max(frame) AS "end", (label - 1) // 6 AS s, (label - 1) % 6 AS p FROM vc GROUP BY seq, label),
tr AS (SELECT seq, label, birth, "end", CASE WHEN s = 0 THEN 0 WHEN s % 2 = 1 THEN (s - 1) * 6 + p // 2 + 1 WHEN p % 3 = 0 THEN 0 ELSE label - 6 END AS parent FROM tr0),
tc AS (SELECT seq, label, birth, "end", CASE WHEN s = 0 THEN 0 WHEN s % 2 = 1 THEN (s - 1) * 6 + p // 2 + 1 WHEN p % 3 = 0 THEN 0 ELSE label - 6 END AS parent FROM tc0),
deg AS (SELECT seq, frame, comp, count(*) AS degree FROM m GROUP BY ALL),
seqs AS (SELECT DISTINCT seq FROM px)
"""

_SAME = SQL[SQL.index("cont AS") : SQL.index("tr0 AS")], SQL[SQL.index("deg AS") :]
LINEAGE_SQL = f"""
l0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seq, cell_id ORDER BY loaded_at DESC NULLS LAST, parent_id DESC NULLS LAST, status DESC) AS rn FROM res_track WHERE seq IS NOT NULL AND cell_id IS NOT NULL) WHERE rn = 1),
l1 AS (SELECT seq, cell_id AS label, start_frame AS birth, end_frame AS "end", coalesce(parent_id, 0) AS named FROM l0 WHERE coalesce(lower(trim(status)) <> 'deleted', true) AND start_frame >= 0 AND end_frame >= start_frame),
l2 AS (SELECT a.seq, a.label, a.birth, a."end", CASE WHEN p.label IS NOT NULL AND a.named <> a.label THEN a.named ELSE 0 END AS parent, count(*) OVER (PARTITION BY a.seq, a.named) AS kids FROM l1 a LEFT JOIN l1 p ON p.seq = a.seq AND p.label = a.named),
l3 AS (SELECT *, parent > 0 AND kids = 1 AND label % 5 = 0 AS taken FROM l2),
px AS (SELECT seq, cast(g.f AS INTEGER) AS frame, label AS ref, CASE WHEN (label + g.f) % 23 = 0 THEN 0 WHEN taken OR parent > 0 AND kids > 1 AND g.f < birth + parent % 4 THEN parent ELSE label END AS comp FROM l3 JOIN range(0, 2000) g(f) ON g.f BETWEEN birth AND "end"),
{_SAME[0]}
tr AS (SELECT seq, label, birth, "end", parent FROM l3),
tc AS (SELECT v.seq, v.label, v.birth, v."end", CASE WHEN p.taken THEN p.parent ELSE coalesce(p.label, 0) END AS parent FROM (SELECT seq, label, min(frame) AS birth, max(frame) AS "end" FROM vc GROUP BY ALL) v JOIN l3 k ON k.seq = v.seq AND k.label = v.label LEFT JOIN l3 p ON p.seq = k.seq AND p.label = k.parent),
{_SAME[1]}"""
