"""Queries that score computed against reference tracks."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring as s
from .fixtures import LINEAGE_SQL, SQL, comparison, lineage_comparison

Source = Callable[[SparkSession, str], s.Comparison]


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def match_frames(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    return rounded(of(spark, d).matches)


def vertex_degree(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    return s.degrees(of(spark, d))


def aogm_counts(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    c = of(spark, d)
    return s.node_counts(c).drop("one", "hit").join(s.edge_counts(c), "seq")


def edge_diff(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    return s.edge_diff(of(spark, d))


def technical_scores(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    return rounded(s.technical(of(spark, d)))


def track_confusion(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    return s.confusion(of(spark, d))


def hota(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    return rounded(s.hota(s.confusion(of(spark, d))))


def chota(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    c = of(spark, d)
    return rounded(s.chota(c, s.confusion(c)))


def id_switches(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    return s.id_switches(of(spark, d))


def mota(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    return rounded(s.mota(of(spark, d)))


def mtml(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    return rounded(s.mostly_tracked(s.confusion(of(spark, d))))


def faf(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    return rounded(s.false_alarms(of(spark, d)))


def identity_scores(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    return rounded(s.identity(s.confusion(of(spark, d))))


def complete_tracks(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    return s.complete_tracks(of(spark, d))


def track_fractions(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    return rounded(s.track_fractions(of(spark, d)))


def ct_tf(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    c = of(spark, d)
    return rounded(s.ct(c).join(s.tf(c), "seq"))


def branching_events(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    return s.split_matches(of(spark, d))


def branching_correctness(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    return rounded(s.bc(of(spark, d)))


def cell_cycle_cdf(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    return rounded(s.cycle_cdf(of(spark, d)))


def cca(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    return rounded(s.cca(of(spark, d)))


def biological_scores(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    return rounded(s.biological(of(spark, d)))


def op_clb(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    """Mean of the linking score and the biological mean of each tolerance."""
    c = of(spark, d)
    x = s.technical(c).select("seq", "lnk").join(s.biological(c), "seq")
    return rounded(x.select("seq", *(((F.col("lnk") + F.col(f"bio_{i}")) / 2).alias(f"op_clb_{i}") for i in range(4))))


def merge_tracks(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    return s.merge_tracks(of(spark, d).ref_tracks)


def valid_checks(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    c = of(spark, d)
    return s.validity(c.contingency, c.comp_tracks, c.comp)


def average_precision(spark: SparkSession, d: str, of: Source = comparison) -> DataFrame:
    """TP / (TP + FP + FN) per seq and threshold on the overlap; above one half an object has at most one partner."""
    c = of(spark, d)
    at = F.explode(F.array(*(F.lit(v / 100) for v in range(50, 100, 5)))).alias("threshold")
    v = s.node_counts(c).select("seq", "v", "c", at)
    tp = v.join(c.matches.select("seq", "iou"), "seq").where(F.col("iou") > F.col("threshold")).groupBy("seq", "threshold").agg(F.count(F.lit(1)).alias("tp"))
    x = v.join(tp, ["seq", "threshold"], "left").na.fill(0, ["tp"])
    return rounded(x.select("seq", "threshold", "tp", (F.col("tp") / (F.col("v") + F.col("c") - F.col("tp") + 1e-6)).alias("ap")))


QUERIES = {f.__name__: f for f in (
    match_frames, vertex_degree, aogm_counts, edge_diff, technical_scores, track_confusion, hota, chota, id_switches, mota, mtml, faf, identity_scores, complete_tracks, track_fractions, ct_tf,
    branching_events, branching_correctness, cell_cycle_cdf, cca, biological_scores, op_clb, merge_tracks, valid_checks, average_precision)}
#: the same scores over the lines of res_track, at the tables' own size
ON_LINEAGES = (vertex_degree, aogm_counts, technical_scores, track_confusion, hota, id_switches, mota, mtml, complete_tracks, track_fractions, ct_tf, branching_events, branching_correctness, cell_cycle_cdf, cca, biological_scores, op_clb, valid_checks)
QUERIES |= {f"lineage_{f.__name__}": functools.partial(f, of=lineage_comparison) for f in ON_LINEAGES}

_W = f"WITH RECURSIVE {SQL}"
_NODES = """, nc AS (SELECT q.seq, (SELECT count(*) FROM vr WHERE vr.seq = q.seq) AS v, (SELECT count(*) FROM vc WHERE vc.seq = q.seq) AS c, (SELECT count(*) FROM m WHERE m.seq = q.seq) AS tp,
  (SELECT count(*) FROM deg WHERE deg.seq = q.seq) AS hit, (SELECT count(*) FROM deg WHERE deg.seq = q.seq AND degree = 1) AS one, (SELECT count(*) FROM deg WHERE deg.seq = q.seq AND degree > 1) AS vs FROM seqs q)"""
_EDGES = """, er AS (SELECT a.seq, a.frame AS t1, a.label AS id1, b.frame AS t2, b.label AS id2, 0 AS semantic FROM vr a JOIN vr b ON b.seq = a.seq AND b.label = a.label AND b.frame = a.frame + 1
  UNION ALL SELECT k.seq, p."end", p.label, k.birth, k.label, 1 FROM tr k JOIN tr p ON p.seq = k.seq AND p.label = k.parent WHERE k.parent > 0),
ec0 AS (SELECT a.seq, a.frame AS t1, a.label AS id1, b.frame AS t2, b.label AS id2, 0 AS semantic FROM vc a JOIN vc b ON b.seq = a.seq AND b.label = a.label AND b.frame = a.frame + 1
  UNION ALL SELECT k.seq, p."end", p.label, k.birth, k.label, 1 FROM tc k JOIN tc p ON p.seq = k.seq AND p.label = k.parent WHERE k.parent > 0),
one AS (SELECT m.seq, m.frame, m.comp, m.ref FROM m JOIN deg USING (seq, frame, comp) WHERE degree = 1),
em AS (SELECT e.seq, e.t1, a.ref AS id1, e.t2, b.ref AS id2, e.semantic FROM ec0 e JOIN one a ON a.seq = e.seq AND a.frame = e.t1 AND a.comp = e.id1 JOIN one b ON b.seq = e.seq AND b.frame = e.t2 AND b.comp = e.id2),
ed AS (SELECT coalesce(r.seq, k.seq) AS seq, coalesce(r.t1, k.t1) AS t1, coalesce(r.id1, k.id1) AS id1, coalesce(r.t2, k.t2) AS t2, coalesce(r.id2, k.id2) AS id2, r.semantic AS ref_semantic, k.semantic AS comp_semantic
  FROM er r FULL JOIN em k ON r.seq = k.seq AND r.t1 = k.t1 AND r.id1 = k.id1 AND r.t2 = k.t2 AND r.id2 = k.id2),
ecount AS (SELECT seq, count(ref_semantic) AS e, count(*) FILTER (ref_semantic IS NULL) AS ed, count(*) FILTER (comp_semantic IS NULL) AS ea, count(*) FILTER (ref_semantic <> comp_semantic) AS ec FROM ed GROUP BY seq)"""
_TECH = _NODES + _EDGES + """, tech AS (SELECT seq, 1 - least(5.0 * ns + 10 * fn + fp, 10.0 * v) / (10 * v) AS det, iou / v AS seg, 1 - least(5.0 * ns + 10 * fn + fp + ed + 1.5 * ea + ec, 10 * v + 1.5 * e) / (10 * v + 1.5 * e) AS tra,
  1 - least(ed + 1.5 * ea + ec, 1.5 * e) / (1.5 * e) AS lnk, cast(5.0 * ns + 10 * fn + fp + ed + 1.5 * ea + ec AS DOUBLE) AS aogm, cast(10 * v + 1.5 * e AS DOUBLE) AS aogm_0 FROM (SELECT *, tp - one - vs AS ns, v - tp AS fn, c - hit AS fp, (SELECT sum(iou) FROM m WHERE m.seq = nc.seq) AS iou FROM nc JOIN ecount USING (seq)))"""
_CONF = """, conf AS (SELECT seq, ref, comp, count(*) AS n FROM (SELECT seq, ref, comp FROM m UNION ALL SELECT vr.seq, vr.label, 0 FROM vr WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.seq = vr.seq AND m.frame = vr.frame AND m.ref = vr.label)
  UNION ALL SELECT vc.seq, 0, vc.label FROM vc WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.seq = vc.seq AND m.frame = vc.frame AND m.comp = vc.label)) GROUP BY ALL)"""
_ASG = """, asg AS (SELECT vr.seq, vr.label AS ref, vr.frame, CASE WHEN deg.degree = 1 THEN m.comp ELSE 0 END AS assigned FROM vr LEFT JOIN m ON m.seq = vr.seq AND m.frame = vr.frame AND m.ref = vr.label LEFT JOIN deg ON deg.seq = m.seq AND deg.frame = m.frame AND deg.comp = m.comp),
complete AS (SELECT a.seq, a.ref, a.comp FROM (SELECT seq, ref, min(assigned) AS comp FROM asg GROUP BY seq, ref HAVING count(DISTINCT assigned) = 1) a JOIN tr ON tr.seq = a.seq AND tr.label = a.ref JOIN tc ON tc.seq = a.seq AND tc.label = a.comp WHERE a.comp <> 0 AND tr.birth = tc.birth AND tr."end" = tc."end"),
isl AS (SELECT *, frame - row_number() OVER (PARTITION BY seq, ref, assigned ORDER BY frame) AS g FROM asg WHERE assigned > 0),
fr0 AS (SELECT seq, ref, comp, max(n) AS n FROM (SELECT seq, ref, assigned AS comp, g, count(*) AS n FROM isl GROUP BY ALL) GROUP BY ALL),
fr1 AS (SELECT f.seq, f.ref, f.comp, f.n / (tr."end" - tr.birth + 1) AS fraction FROM fr0 f JOIN tr ON tr.seq = f.seq AND tr.label = f.ref),
fr AS (SELECT * FROM fr1 a WHERE NOT EXISTS (SELECT 1 FROM fr1 b WHERE b.seq = a.seq AND b.comp = a.comp AND b.fraction = 1 AND b.ref < a.ref)),
tfs AS (SELECT seq, avg(f) AS tf FROM (SELECT seq, ref, max(fraction) AS f FROM fr GROUP BY ALL) GROUP BY seq),
cts AS (SELECT q.seq, 2 * (SELECT count(*) FROM complete c WHERE c.seq = q.seq) / ((SELECT count(*) FROM tr WHERE tr.seq = q.seq) + (SELECT count(*) FROM tc WHERE tc.seq = q.seq)) AS ct FROM seqs q)"""
_SPLIT = """, sr AS (SELECT k.seq, k.parent AS label, list(k.label ORDER BY k.label) AS children, any_value(p."end") AS te FROM tr k JOIN tr p ON p.seq = k.seq AND p.label = k.parent WHERE k.parent > 0 GROUP BY ALL HAVING count(*) > 1),
sc AS (SELECT k.seq, k.parent AS label, list(k.label ORDER BY k.label) AS children, any_value(p."end") AS te FROM tc k JOIN tc p ON p.seq = k.seq AND p.label = k.parent WHERE k.parent > 0 GROUP BY ALL HAVING count(*) > 1),
ev AS (SELECT r.seq, r.label AS ref, k.label AS comp, abs(r.te - k.te) AS apart FROM sr r JOIN sc k ON k.seq = r.seq AND abs(r.te - k.te) <= 3 AND len(r.children) = len(k.children)
  WHERE EXISTS (SELECT 1 FROM m WHERE m.seq = r.seq AND m.frame = least(r.te, k.te) AND m.ref = r.label AND m.comp = k.label)
  AND (SELECT count(DISTINCT m.comp) FROM m WHERE m.seq = r.seq AND m.frame = greatest(r.te, k.te) + 1 AND list_contains(k.children, m.comp)) = len(k.children)
  AND NOT EXISTS (SELECT 1 FROM m WHERE m.seq = r.seq AND m.frame = greatest(r.te, k.te) + 1 AND list_contains(k.children, m.comp) AND NOT list_contains(r.children, m.ref))),
bcs AS (SELECT seq, i, CASE WHEN r > 0 THEN 2 * (tp / greatest(k, 1)) * (tp / greatest(r, 1)) / greatest(tp / greatest(k, 1) + tp / greatest(r, 1), 1e-4) END AS bc FROM (SELECT q.seq, cast(g.i AS INTEGER) AS i, (SELECT count(*) FROM ev WHERE ev.seq = q.seq AND ev.apart <= g.i) AS tp,
  (SELECT count(*) FROM sr WHERE sr.seq = q.seq) AS r, (SELECT count(*) FROM sc WHERE sc.seq = q.seq) AS k FROM seqs q CROSS JOIN range(0, 4) g(i))),
lr AS (SELECT tr.seq, "end" - birth AS l FROM tr JOIN sr a ON a.seq = tr.seq AND a.label = tr.label JOIN sr b ON b.seq = tr.seq AND b.label = tr.parent),
lc AS (SELECT tc.seq, "end" - birth AS l FROM tc JOIN sc a ON a.seq = tc.seq AND a.label = tc.label JOIN sc b ON b.seq = tc.seq AND b.label = tc.parent),
cdf AS (SELECT x.seq, x.l AS length, (SELECT count(*) FROM lr WHERE lr.seq = x.seq AND lr.l <= x.l) / nullif((SELECT count(*) FROM lr WHERE lr.seq = x.seq), 0) AS ref_cdf,
  (SELECT count(*) FROM lc WHERE lc.seq = x.seq AND lc.l <= x.l) / nullif((SELECT count(*) FROM lc WHERE lc.seq = x.seq), 0) AS comp_cdf FROM (SELECT seq, l FROM lr UNION SELECT seq, l FROM lc) x),
ccas AS (SELECT q.seq, CASE WHEN NOT EXISTS (SELECT 1 FROM lr WHERE lr.seq = q.seq) THEN NULL WHEN NOT EXISTS (SELECT 1 FROM lc WHERE lc.seq = q.seq) THEN 0.0 ELSE 1 - (SELECT max(abs(ref_cdf - comp_cdf)) FROM cdf WHERE cdf.seq = q.seq) END AS cca FROM seqs q)"""
_BIO = _ASG + _SPLIT + """, bio0 AS (SELECT q.seq, ct, coalesce(tf, 0.0) AS tf, cca, b0.bc AS bc_0, b1.bc AS bc_1, b2.bc AS bc_2, b3.bc AS bc_3 FROM seqs q JOIN cts USING (seq) LEFT JOIN tfs USING (seq) JOIN ccas USING (seq)
  JOIN bcs b0 ON b0.seq = q.seq AND b0.i = 0 JOIN bcs b1 ON b1.seq = q.seq AND b1.i = 1 JOIN bcs b2 ON b2.seq = q.seq AND b2.i = 2 JOIN bcs b3 ON b3.seq = q.seq AND b3.i = 3),
bio AS (SELECT *, list_avg([ct, tf, cca, bc_0]) AS bio_0, list_avg([ct, tf, cca, bc_1]) AS bio_1, list_avg([ct, tf, cca, bc_2]) AS bio_2, list_avg([ct, tf, cca, bc_3]) AS bio_3 FROM bio0)"""


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_CLIQUE = """, ar AS (SELECT seq, label, label AS member FROM tr UNION SELECT a.seq, a.label, tr.parent FROM ar a JOIN tr ON tr.seq = a.seq AND tr.label = a.member JOIN tr up ON up.seq = tr.seq AND up.label = tr.parent WHERE tr.parent > 0),
ac AS (SELECT seq, label, label AS member FROM tc UNION SELECT a.seq, a.label, tc.parent FROM ac a JOIN tc ON tc.seq = a.seq AND tc.label = a.member JOIN tc up ON up.seq = tc.seq AND up.label = tc.parent WHERE tc.parent > 0),
kr AS (SELECT seq, label, member FROM ar UNION SELECT seq, member, label FROM ar), kc AS (SELECT seq, label, member FROM ac UNION SELECT seq, member, label FROM ac),
rs AS (SELECT k.seq, k.label, sum(n) AS s FROM kr k JOIN conf c ON c.seq = k.seq AND c.ref = k.member GROUP BY ALL), cs AS (SELECT k.seq, k.label, sum(n) AS s FROM kc k JOIN conf c ON c.seq = k.seq AND c.comp = k.member GROUP BY ALL),
tpa AS (SELECT x.seq, x.ref, x.comp, any_value(x.n) AS n, sum(c.n) AS t FROM conf x JOIN kr ON kr.seq = x.seq AND kr.label = x.ref JOIN kc ON kc.seq = x.seq AND kc.label = x.comp JOIN conf c ON c.seq = x.seq AND c.ref = kr.member AND c.comp = kc.member WHERE x.ref > 0 AND x.comp > 0 GROUP BY ALL)"""
_MERGE = """, chain AS (SELECT k.seq, k.label, CASE WHEN k.parent > 0 AND k.n = 1 AND p.label IS NOT NULL THEN k.parent END AS up FROM (SELECT *, count(*) OVER (PARTITION BY seq, parent) AS n FROM tr) k LEFT JOIN tr p ON p.seq = k.seq AND p.label = k.parent),
climb AS (SELECT seq, label, label AS root, up FROM chain UNION ALL SELECT c.seq, c.label, k.label, k.up FROM climb c JOIN chain k ON k.seq = c.seq AND k.label = c.up),
top AS (SELECT seq, label, root FROM climb WHERE up IS NULL),
mg AS (SELECT t.seq, t.root, min(tr.birth) AS birth, max(tr."end") AS "end", count(*) AS n, max(tr.parent) FILTER (tr.label = t.root) AS parent, cast(dense_rank() OVER (PARTITION BY t.seq ORDER BY t.root) AS INTEGER) AS label FROM top t JOIN tr ON tr.seq = t.seq AND tr.label = t.label GROUP BY t.seq, t.root)"""
_CHECK = """, viol AS (SELECT seq, 'label_not_unique' AS "check" FROM tc GROUP BY seq, label HAVING count(*) > 1 UNION ALL SELECT seq, 'parent_negative' FROM tc WHERE parent < 0
  UNION ALL SELECT k.seq, 'parent_missing' FROM tc k WHERE k.parent <> 0 AND NOT EXISTS (SELECT 1 FROM tc p WHERE p.seq = k.seq AND p.label = k.parent)
  UNION ALL SELECT k.seq, 'parent_ends_late' FROM tc k JOIN tc p ON p.seq = k.seq AND p.label = k.parent WHERE k.parent <> 0 AND p."end" >= k.birth
  UNION ALL SELECT seq, 'ends_before_birth' FROM tc WHERE "end" < birth
  UNION ALL SELECT v.seq, 'object_outside_track' FROM vc v WHERE NOT EXISTS (SELECT 1 FROM tc t WHERE t.seq = v.seq AND t.label = v.label AND v.frame BETWEEN t.birth AND t."end")
  UNION ALL SELECT t.seq, 'track_without_object' FROM tc t JOIN range(0, 2000) g(f) ON g.f BETWEEN t.birth AND t."end" WHERE NOT EXISTS (SELECT 1 FROM vc v WHERE v.seq = t.seq AND v.label = t.label AND v.frame = g.f)),
names AS (SELECT unnest(['label_not_unique', 'parent_negative', 'parent_missing', 'parent_ends_late', 'ends_before_birth', 'object_outside_track', 'track_without_object']) AS "check")"""

ORACLE = {
    "match_frames": f"{_W} SELECT seq, frame, ref, comp, inter, ref_area, comp_area, round(iou, 6) AS iou FROM m",
    "vertex_degree": f"{_W} SELECT seq, frame, comp, degree FROM deg",
    "aogm_counts": f"{_W}{_NODES}{_EDGES} SELECT seq, v, c, tp, v - tp AS fn, c - hit AS fp, vs, tp - one - vs AS ns, e, ed, ea, ec FROM nc JOIN ecount USING (seq)",
    "edge_diff": f"{_W}{_EDGES} SELECT * FROM ed",
    "technical_scores": f"{_W}{_TECH} SELECT seq, {_r('det', 'seg', 'tra', 'lnk', 'aogm', 'aogm_0')}, round((seg + det) / 2, 6) AS op_csb, round((seg + tra) / 2, 6) AS op_ctb FROM tech",
    "track_confusion": f"{_W}{_CONF} SELECT * FROM conf",
    "hota": f"{_W}{_CONF} SELECT seq, round(sqrt(sum(CASE WHEN ref > 0 AND comp > 0 THEN n * n / (r + k - n) ELSE 0 END) / sum(n)), 6) AS hota FROM (SELECT *, sum(n) OVER (PARTITION BY seq, ref) AS r, sum(n) OVER (PARTITION BY seq, comp) AS k FROM conf) GROUP BY seq",
    "chota": f"{_W}{_CONF}{_CLIQUE} SELECT t.seq, round(sqrt(sum(t.n * t.t / (rs.s + cs.s - t.t)) / (SELECT sum(n) FROM conf WHERE conf.seq = t.seq)), 6) AS chota FROM tpa t JOIN rs ON rs.seq = t.seq AND rs.label = t.ref JOIN cs ON cs.seq = t.seq AND cs.label = t.comp GROUP BY t.seq",
    "id_switches": f"{_W} SELECT seq, frame, ref, comp, before FROM (SELECT *, lag(comp) OVER (PARTITION BY seq, ref ORDER BY frame) AS before FROM m) WHERE before <> comp",
    "mota": f"{_W}{_NODES}, sw AS (SELECT seq, count(*) AS idsw FROM (SELECT *, lag(comp) OVER (PARTITION BY seq, ref ORDER BY frame) AS before FROM m) WHERE before <> comp GROUP BY seq), x AS (SELECT seq, v, tp, c - tp + tp - hit AS fp, v - tp AS fn, coalesce(idsw, 0) AS idsw, tp - hit AS multi FROM nc LEFT JOIN sw USING (seq)) SELECT seq, round(1 - (fn + fp + idsw + multi) / v, 6) AS mota, tp, fp, fn, idsw, multi, round(tp / (tp + fp), 6) AS precision, round(tp / v, 6) AS recall FROM x",
    "mtml": f"{_W}{_CONF} SELECT seq, round(avg(cast(ratio >= 0.8 AS INTEGER)), 6) AS mt, round(avg(cast(ratio < 0.2 AS INTEGER)), 6) AS ml FROM (SELECT seq, ref, max(n) / sum(n) AS ratio FROM conf WHERE ref > 0 GROUP BY ALL) GROUP BY seq",
    "faf": f"{_W}{_NODES} SELECT seq, round((c - one) / frames, 6) AS faf, frames FROM nc JOIN (SELECT seq, count(DISTINCT frame) AS frames FROM px GROUP BY seq) USING (seq)",
    "complete_tracks": f"{_W}{_ASG} SELECT * FROM complete",
    "track_fractions": f"{_W}{_ASG} SELECT seq, ref, comp, round(fraction, 6) AS fraction FROM fr",
    "ct_tf": f"{_W}{_ASG} SELECT seq, round(ct, 6) AS ct, round(coalesce(tf, 0), 6) AS tf FROM cts LEFT JOIN tfs USING (seq)",
    "branching_events": f"{_W}{_SPLIT} SELECT * FROM ev",
    "branching_correctness": f"{_W}{_SPLIT} SELECT seq, i, round(bc, 6) AS bc FROM bcs",
    "cell_cycle_cdf": f"{_W}{_SPLIT} SELECT seq, length, {_r('ref_cdf', 'comp_cdf')} FROM cdf",
    "cca": f"{_W}{_SPLIT} SELECT seq, round(cca, 6) AS cca FROM ccas",
    "biological_scores": f"{_W}{_BIO} SELECT seq, {_r('ct', 'tf', 'cca', *(f'{a}_{i}' for a in ('bc', 'bio') for i in range(4)))} FROM bio",
    "op_clb": f"{_W}{_TECH}{_BIO} SELECT seq, {', '.join(f'round((lnk + bio_{i}) / 2, 6) AS op_clb_{i}' for i in range(4))} FROM tech JOIN bio USING (seq)",
    "merge_tracks": f"{_W}{_MERGE} SELECT g.seq, g.label, g.birth, g.\"end\", coalesce(u.label, 0) AS parent, g.n FROM mg g LEFT JOIN top t ON t.seq = g.seq AND t.label = g.parent LEFT JOIN mg u ON u.seq = t.seq AND u.root = t.root",
    "valid_checks": f"{_W}{_CHECK} SELECT q.seq, n.\"check\", (SELECT count(*) FROM viol v WHERE v.seq = q.seq AND v.\"check\" = n.\"check\") AS violations FROM seqs q CROSS JOIN names n",
    "average_precision": f"{_W}{_NODES} SELECT x.seq, threshold, tp, round(tp / (v + c - tp + 1e-6), 6) AS ap FROM (SELECT nc.seq, nc.v, nc.c, g.i / 100.0::DOUBLE AS threshold, (SELECT count(*) FROM m WHERE m.seq = nc.seq AND m.iou > g.i / 100.0::DOUBLE) AS tp FROM nc CROSS JOIN range(50, 100, 5) g(i)) x",
}
ORACLE |= {f"lineage_{f.__name__}": ORACLE[f.__name__].replace(SQL, LINEAGE_SQL) for f in ON_LINEAGES}
