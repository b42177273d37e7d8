import random

from trackloom.operators import tracking as tr


def test_overlap_tracks_follow_and_split(spark):
    box = lambda f, label, y, x, h, w: [("s", f, y + i, x + j, label) for i in range(h) for j in range(w)]
    px = box(0, 1, 0, 0, 6, 6) + box(0, 2, 0, 30, 4, 4) + box(1, 5, 1, 1, 6, 6) + box(1, 6, 0, 31, 4, 4) + box(2, 1, 1, 1, 3, 6) + box(2, 2, 5, 1, 3, 6) + box(2, 3, 1, 32, 4, 4) + box(4, 1, 1, 32, 4, 4)
    px = spark.createDataFrame(px, "seq string, frame int, y int, x int, label int")
    t = {(r["frame"], r["label"]): (r["track"], r["parent"]) for r in tr.tracks_of(px.select("seq", "frame", "label").distinct(), tr.overlap_links(px)).collect()}
    assert t[(0, 1)] == t[(1, 5)] and t[(0, 2)] == t[(1, 6)] == t[(2, 3)] and t[(0, 1)][1] == 0
    assert t[(2, 1)][1] == t[(2, 2)][1] == t[(0, 1)][0] and t[(2, 1)][0] != t[(2, 2)][0]
    assert t[(4, 1)] == (4 * 65536 + 1, 0)  # a missing frame ends a track


def test_cheapest_links(spark):
    rnd = random.Random(3)
    rows = []
    for c in range(30):
        x, y = rnd.uniform(0, 300), rnd.uniform(0, 300)
        for f in range(10):
            rows.append(("s", f, c, x + f, y + rnd.uniform(-0.5, 0.5)))
    rows += [("s", 3, 90, 900.0, 900.0), ("s", 4, 91, 899.0, 898.0), ("s", 4, 92, 901.0, 902.0), ("s", 5, 93, None, 1.0)]
    rows += [("s", 3, 94, 600.0, 600.0), ("s", 4, 95, 599.0, 598.0), ("s", 4, 96, 601.0, 603.0)]
    df = spark.createDataFrame(rows, "seq string, frame int, label int, x double, y double")
    got = {(r["frame"], r["label"]): r["before"] for r in tr.cheapest_links(df, 6.0, 3.0).collect()}
    assert got[(4, 91)] == got[(4, 92)] == 90  # both cost less than appearing
    assert got[(4, 95)] == 94 and (4, 96) not in got  # 3.16 and 3 for a second successor cost more than appearing
    own = [(f, c) for f in range(1, 10) for c in range(30)]
    assert sum(got.get(k) == k[1] for k in own) >= 0.95 * len(own)
    assert tr.cheapest_links(df.where("false")).collect() == []
