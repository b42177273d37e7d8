import random

import pytest

from trackloom.operators import images as im


def hull_by_hand(points):
    """Area of the convex hull: the edges are the pairs with no point on their left, the longest of each line."""
    pts = sorted(set(points))
    area = 0.0
    for a in pts:
        for b in pts:
            if a != b:
                side = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for p in pts]
                on = [p for p, v in zip(pts, side) if v == 0]
                if all(v <= 0 for v in side) and {min(on), max(on)} == {a, b}:
                    area += a[0] * b[1] - a[1] * b[0]
    return abs(area) / 2


@pytest.mark.parametrize("seed", range(6))
def test_hull_area(spark, seed):
    rnd = random.Random(seed)
    objects = {(i, 0): {(rnd.randint(0, 12), rnd.randint(0, 12)) for _ in range(rnd.randint(1, 30))} for i in range(8)}
    objects[20, 0] = {(y, 3) for y in range(9)}
    df = spark.createDataFrame([("s", 0, y, x, *k) for k, ps in objects.items() for y, x in ps], "seq string, frame int, y int, x int, ty int, tx int")
    got = {(r["ty"], r["tx"]): r["hull"] for r in im.hulls(df).collect()}
    assert got == {k: hull_by_hand(ps) for k, ps in objects.items()}


def test_perimeters_and_features(spark):
    square = [("s", 0, y, x, 0, 0) for y in range(5) for x in range(5)]
    dot, line = [("s", 0, 20, 20, 20, 20)], [("s", 0, 30, x, 30, 0) for x in range(10)]
    labels = spark.createDataFrame(square + dot + line, "seq string, frame int, y int, x int, ty int, tx int")
    p = {r["ty"]: r["perimeter"] for r in im.perimeters(labels).collect()}
    assert p[0] == pytest.approx(16 + 4 / 2**0.5) and p[20] == pytest.approx(4 / 2**0.5) and p[30] == pytest.approx(18 + 4 / 2**0.5)
    px = labels.selectExpr("seq", "frame", "y", "x", "cast(10 * x as double) as v")
    f = {r["ty"]: r for r in im.features(labels, px).collect()}
    assert f[0]["volume"] == 25 and f[0]["intensity_mean"] == 20 and f[0]["gradient"] == pytest.approx((3 * 10 + 2 * 5) / 5) and f[0]["displacement"] == pytest.approx(8**0.5)
    assert f[20]["gradient"] == 0 and f[30]["intensity_max"] == 90
    assert im.features(labels.where("false"), px).collect() == [] and im.hulls(labels.where("false")).collect() == []
