from pyspark.sql import functions as F

from trackloom.api import comparison
from trackloom.operators import scoring as s

TRACKS = "seq string, label int, birth int, end int, parent int"


def compared(spark, ref, comp, seen=None):
    """A comparison of tracks (label, birth, end, parent); ``seen`` maps (frame, reference label) to the computed label where that is not the same one."""
    px, at = [], {(f, label) for label, b, e, _ in comp for f in range(b, e + 1)}
    for label, b, e, _ in ref:
        for f in range(b, e + 1):
            c = (seen or {}).get((f, label), label if (f, label) in at else 0)
            at.discard((f, c))
            px += [("s", f, label, c)] * 4
    px += [("s", f, 0, label) for f, label in at] + [("s", 0, 0, 0)]
    sides = [spark.createDataFrame([("s", *t) for t in x], TRACKS) for x in (ref, comp)]
    return comparison(spark.createDataFrame(px, "seq string, frame int, ref int, comp int"), *sides)


#: 1 splits into 2 and 3 after frame 4, 2 into 4 and 5 after frame 9, 3 into 6 and 7 after frame 12
LINE = [(1, 0, 4, 0), (2, 5, 9, 1), (3, 5, 12, 1), (4, 10, 15, 2), (5, 10, 15, 2), (6, 13, 15, 3), (7, 13, 15, 3)]


def test_a_copy_scores_one(spark):
    c = compared(spark, LINE, LINE)
    t, b = s.technical(c).first(), s.biological(c).first()
    assert [t[k] for k in ("det", "seg", "tra", "lnk", "aogm")] == [1, 1, 1, 1, 0]
    assert [b[k] for k in ("ct", "tf", "cca", "bc_0", "bc_3", "bio_0")] == [1] * 6
    assert all(r["violations"] == 0 for r in s.validity(c.contingency, c.comp_tracks, c.comp).collect())


def test_splits_seen_late_count_by_tolerance(spark):
    # the first split is seen on time, the second 1 frame late, the third 2: until then the parent's number covers both daughters
    comp = [(1, 0, 4, 0), (2, 5, 10, 1), (3, 5, 14, 1), (4, 11, 15, 2), (5, 11, 15, 2), (6, 15, 15, 3), (7, 15, 15, 3)]
    seen = {(10, 4): 2, (10, 5): 2, **{(f, k): 3 for f in (13, 14) for k in (6, 7)}}
    c = compared(spark, LINE, comp, seen)
    assert {r["ref"]: r["apart"] for r in s.split_matches(c).collect()} == {1: 0, 2: 1, 3: 2}
    assert {r["i"]: round(r["bc"], 6) for r in s.bc(c).collect()} == {0: round(1 / 3, 6), 1: round(2 / 3, 6), 2: 1.0, 3: 1.0}
    n = s.node_counts(c).first()
    assert (n["vs"], n["ns"], n["fn"], n["fp"]) == (3, 3, 0, 0)
    # cycles of 4 and 7 frames became 5 and 9
    assert sorted((r["length"], r["ref_cdf"], r["comp_cdf"]) for r in s.cycle_cdf(c).collect()) == [(4, 0.5, 0.0), (5, 0.5, 0.5), (7, 1.0, 0.5), (9, 1.0, 1.0)]
    assert s.cca(c).first()["cca"] == 0.5


def test_edges_change_their_kind(spark):
    # 3 is an only child that the other side goes on calling 1
    ref, comp = [(1, 0, 3, 0), (3, 4, 8, 1)], [(1, 0, 8, 0)]
    c = compared(spark, ref, comp, {(f, 3): 1 for f in range(4, 9)})
    e = s.edge_counts(c).first()
    assert (e["e"], e["ed"], e["ea"], e["ec"]) == (8, 0, 0, 1)
    m = s.merge_tracks(c.ref_tracks).collect()
    assert [tuple(r) for r in m] == [("s", 1, 0, 8, 0, 2)] or [(r["label"], r["birth"], r["end"], r["parent"], r["n"]) for r in m] == [(1, 0, 8, 0, 2)]


def test_each_violation_is_counted(spark):
    comp = [(1, 0, 5, 0), (2, 3, 8, 1), (3, 9, 7, 0), (4, 6, 9, 77), (5, 6, 9, -2), (6, 0, 2, 0), (6, 4, 5, 0)]
    tracks = spark.createDataFrame([("s", *t) for t in comp], TRACKS)
    seen = [("s", f, label) for label, b, e, _ in comp if label != 4 for f in range(b, e + 1)] + [("s", 20, 1), ("s", 3, 99)]
    vertices = spark.createDataFrame(seen, "seq string, frame int, label int")
    got = {r["check"]: r["violations"] for r in s.validity(vertices.withColumn("n", F.lit(1)), tracks, vertices).collect()}
    assert got == {"label_not_unique": 1, "parent_negative": 1, "parent_missing": 2, "parent_ends_late": 1, "ends_before_birth": 1, "object_outside_track": 2, "track_without_object": 4}


def test_no_splits_and_no_cycles(spark):
    c = compared(spark, [(1, 0, 5, 0)], [(1, 0, 5, 0)])
    assert s.cca(c).first()["cca"] is None and {r["bc"] for r in s.bc(c).collect()} == {None}
    d = compared(spark, LINE, [(k, b, e, 0) for k, b, e, _ in LINE])
    assert s.cca(d).first()["cca"] == 0 and {r["bc"] for r in s.bc(d).collect()} == {0}
