import random

import numpy as np

from trackloom.operators.grid import regular_grid


def slopes(t, v):
    """Shape-preserving slopes of one segment."""
    h, d = np.diff(t).astype(float), np.diff(v) / np.diff(t)
    if len(t) == 2:
        return np.array([d[0], d[0]])
    m = np.zeros(len(t))
    for i in range(1, len(t) - 1):
        if d[i - 1] * d[i] > 0:
            a, b = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
            m[i] = (a + b) / (a / d[i - 1] + b / d[i])
    for i, (h0, h1, d0, d1) in ((0, (h[0], h[1], d[0], d[1])), (-1, (h[-1], h[-2], d[-1], d[-2]))):
        e = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        m[i] = 0 if e * d0 <= 0 else 3 * d0 if d0 * d1 <= 0 and abs(e) > 3 * abs(d0) else e
    return m


def brute(points, max_gap):
    points = sorted(points)
    out, segment = {}, [points[0]]

    def flush():
        t, v = np.array([p[0] for p in segment]), np.array([p[1] for p in segment])
        m = slopes(t, v) if len(t) > 1 else None
        for i in range(len(t)):
            out[int(t[i])] = (v[i], "observed")
            for x in range(int(t[i]) + 1, int(t[i + 1]) if i + 1 < len(t) else 0):
                h = t[i + 1] - t[i]
                s = (x - t[i]) / h
                out[x] = (v[i] * (1 + 2 * s) * (1 - s) ** 2 + m[i] * h * s * (1 - s) ** 2 + v[i + 1] * s * s * (3 - 2 * s) + m[i + 1] * h * s * s * (s - 1), "filled")

    for a, b in zip(points, points[1:], strict=False):
        if b[0] - a[0] > max_gap:
            flush()
            segment = []
            for x in range(a[0] + 1, b[0]):
                out[x] = (None, "long_gap")
        segment.append(b)
    flush()
    return out


def test_against_brute_force_and_independent_of_shards(spark):
    rnd = random.Random(3)
    data = {c: sorted({rnd.randint(0, 300) for _ in range(n)}) for c, n in ((1, 90), (2, 25), (3, 1), (4, 2))}
    data[5] = [0, 1, 2, 190, 191]
    rows = [("s", c, t, rnd.uniform(-5, 5)) for c, ts in data.items() for t in ts]
    rows += [("s", 6, 1, None), ("s", 6, 2, float("nan")), (None, 6, 3, 1.0), ("s", None, 3, 1.0), ("s", 6, None, 1.0)]
    df = spark.createDataFrame(rows, "seq string, cell int, t int, X double").withColumnRenamed("t", "time step")
    for shard in (16, 1024):
        got = {}
        for r in regular_grid(df, ["seq", "cell"], "time step", ["X"], max_gap=7, shard=shard).collect():
            assert (r["cell"], r["time step"]) not in got
            got[(r["cell"], r["time step"])] = (r["X"], r["status"])
        want = {(c, t): v for c in data for t, v in brute([(t, x) for s, k, t, x in rows if k == c and s], 7).items()}
        assert got.keys() == want.keys()
        for k, (v, status) in want.items():
            assert got[k][1] == status and (v is None and got[k][0] is None or abs(got[k][0] - v) < 1e-9), k
    assert regular_grid(df.where("false"), ["seq", "cell"], "time step", ["X"]).collect() == []
