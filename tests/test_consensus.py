import math
import random
import threading

from trackloom.operators import consensus as k

SEG = "fov int, start int, algorithm string, cell_id int, x0 double, y0 double, area0 double"
REP = "fov int, start int, gx int, gy int, end int, x1 double, y1 double, area1 double"


def brute(reps, seg):
    """The best pair of every representative by looking at all pairs."""
    out = {}
    for fov, start, gx, gy, end, x, y, area in reps:
        c = [] if None in (fov, x, y, area) or not area > 0 else [
            (via, cell, a, b, z / area) for f, s, via, cell, a, b, z in seg
            if f == fov and s == end + 1 and None not in (via, a, b, z) and math.hypot(a - x, b - y) < 400 and 0.2 < z / area < 0.9]
        best = None
        for i, (va, ca, xa, ya, ra) in enumerate(c):
            for vb, cb, xb, yb, rb in c[:i]:
                same, sibling, error = va == vb, math.hypot(xa - xb, ya - yb), abs(ra + rb - 1)
                if (10 <= sibling <= 300 and error <= 0.5) if same else (15 <= sibling <= 350 and error <= 0.6):
                    a, b = sorted([(va, ca), (vb, cb)])
                    this = (not same, va if same else "", math.floor(error * 1e9 + 0.5), math.floor(sibling * 1e9 + 0.5), *a, *b, same, round(sibling, 6), round(error, 6))
                    best = this if best is None or this < best else best
        if best:
            out[(fov, start, gx, gy)] = best[4:]
    return out


def found(spark, reps, seg):
    d = k.divisions(spark.createDataFrame(reps, REP), spark.createDataFrame(seg, SEG))
    assert d.columns == ["fov", "start", "gx", "gy", "via_a", "cell_a", "via_b", "cell_b", "same", "sibling", "error"]
    rows = [tuple(r) for r in d.collect()]
    got = {r[:4]: (*r[4:9], round(r[9], 6), round(r[10], 6)) for r in rows}
    assert len(got) == len(rows)
    return got


def test_divisions_as_by_all_pairs(spark):
    rnd = random.Random(5)
    reps, seg = [], []
    for fov in range(3):
        for frame in range(6):
            step, side, crowd = [(0.01, 500, 40), (5, 60, 40), (25, 30, 40), (0.01, 700, 4), (50, 700, 3), (5, 14, 30)][frame]  # few sizes and places give ties, few segments pairs of two trackers
            value = lambda low, high, step=step: float(round(rnd.uniform(low, high) / step) * step)
            seg += [(fov, frame, rnd.choice(["a", "B", "é", "c"]), i, float(rnd.randint(0, side)), float(rnd.randint(0, side)), value(1, 100)) for i in range(crowd)]
            reps += [(fov, frame - rnd.randint(1, 3), i, frame, frame - 1, float(rnd.randint(0, side)), float(rnd.randint(0, side)), value(20, 120)) for i in range(12)]
    reps += [(0, 0, 1000, 0, 1, None, 1.0, 50.0), (0, 0, 1001, 0, 1, 1.0, 1.0, None), (0, 0, 1002, 0, 1, 1.0, 1.0, 0.0), (None, 0, 1003, 0, 1, 1.0, 1.0, 50.0), (1, 0, 1004, 0, 77, 1.0, 1.0, 50.0)]
    seg += [(0, 2, "a", 900, None, 1.0, 25.0), (0, 2, "a", 901, 20.0, 1.0, None), (0, 2, None, 902, 30.0, 1.0, 25.0), (None, 2, "a", 903, 30.0, 1.0, 25.0)]
    want = brute(reps, seg)
    assert found(spark, reps, seg) == want
    assert {v[4] for v in want.values()} == {True, False}
    assert found(spark, reps[:0], seg) == found(spark, reps, seg[:0]) == {}


def test_divisions_in_a_crowded_frame(spark):
    """400 paths that end before 2,800 segments begin: 1.6 billion pairs, of which few need to be looked at."""
    rnd = random.Random(7)
    seg = [(0, 5, "abcd"[i % 4], i, float(rnd.randint(0, 400)), float(rnd.randint(0, 400)), rnd.randint(1000, 9000) / 100) for i in range(2800)]
    reps = [(0, i % 4, i, 0, 4, float(rnd.randint(100, 300)), float(rnd.randint(100, 300)), rnd.randint(5000, 12000) / 100) for i in range(400)]
    late = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = found(spark, reps, seg)
    finally:
        late.cancel()
    assert len(got) == 400 and all(v[4] and v[0] == "a" for v in got.values())
    some = reps[::80]
    assert {r[:4]: got[r[:4]] for r in some} == brute(some, [s for s in seg if s[2] == "a"])
