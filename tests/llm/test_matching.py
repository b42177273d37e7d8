import dataclasses
import random

import numpy as np
from pyspark.sql import functions as F

from trackloom.llm import matching as ma

SCHEMA = "seq string, cell int, frame int, X double, Y double, Area double"


def world(seed, shift, lag, factor, room=850, noise=1.0, cells=15):
    """Random walks seen by two sources; the second numbers on its own, breaks some tracks and adds some of its own."""
    rnd = random.Random(seed)
    a, b, truth, number = [], [], {}, 100
    for c in range(1, cells + 1):
        x, y, s, t0 = rnd.uniform(50, 50 + room), rnd.uniform(50, 50 + room), rnd.uniform(150, 400), rnd.randint(0, 60)
        n = rnd.randint(10, 50)
        number += 1
        cut = n // 2 if c % 5 == 0 else None
        for i in range(n):
            x, y = x + rnd.gauss(0, 1), y + rnd.gauss(0, 1)
            if rnd.random() > 0.1:
                a.append(("s", c, t0 + i, x, y, s * (1 + rnd.gauss(0, 0.03))))
            if cut and i == cut:
                number += 1
            if rnd.random() > 0.1 and c % 7:
                b.append(("s", number, t0 + i - lag, x + shift[0] + rnd.gauss(0, noise), y + shift[1] + rnd.gauss(0, noise), s * factor * (1 + rnd.gauss(0, 0.03)) if i % 4 else None))
                truth[number] = c
    for k in (900, 901):
        b += [("s", k, 20 + i, 950.0 + i, 20.0 + 40 * (k - 900), 200.0) for i in range(20)]
    return a, b, truth


def found(spark, a, b):
    ta, tb = (ma.tracks(spark.createDataFrame(r, SCHEMA).withColumn("g", F.lit(1)), "seq", "cell", "frame", "X", "Y", "Area") for r in (a, b))
    return ma.match(ta, tb).collect()


def test_shifted_sources(spark):
    a, b, truth = world(1, (7.0, -5.0), 2, 1.15)
    a += a[:20] + [(None, 1, 1, 1.0, 1.0, 1.0), ("s", None, 1, 1.0, 1.0, 1.0), ("s", 1, None, 1.0, 1.0, 1.0), ("s", 2, 3, None, 1.0, 1.0), ("s", 2, 4, float("nan"), 1.0, 1.0), ("only a", 1, 1, 5.0, 5.0, 5.0)]
    got = found(spark, a, b + b[:30] + [("only b", 1, 1, 5.0, 5.0, 5.0)])
    assert {r["b"]: r["a"] for r in got} == truth
    assert all(0.5 <= r["confidence"] <= 1 for r in got)


def test_empty(spark):
    a, b, _ = world(2, (0.0, 0.0), 0, 1.0)
    assert found(spark, a, []) == [] and found(spark, [], b) == []


def test_close_pairs_finds_all(spark):
    rnd = random.Random(4)
    rows = [(f"{i % 2}", 0, i, rnd.randint(0, 120), rnd.randint(0, 120)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, block int, e int, bx int, by int").select("g", "block", "e", ma._word(F.col("bx")).alias("wx"), ma._word(F.col("by")).alias("wy"))
    got = [(r["e_a"], r["e_b"]) for r in ma.close_pairs(df, df, 4).collect()]
    apart = lambda p, q: min(abs(p - q), 128 - abs(p - q))
    want = {(p[2], q[2]) for p in rows for q in rows if p[0] == q[0] and apart(p[3], q[3]) + apart(p[4], q[4]) <= 4}
    assert len(got) == len(set(got)) and set(got) == want


def test_dice_of_bit_vectors():
    rng = np.random.default_rng(3)
    x = np.append(rng.uniform(-50, 1050, 500), np.nan)
    y = x + rng.uniform(-20, 20, 501)
    a, b = ma.grams(x, 6.0), ma.grams(y, 6.0)
    assert (np.bitwise_count(a).sum(axis=1)[:500] == 64).all() and not a[500].any()
    assert (ma.dice(a, a)[:500] == 1).all()
    # as many bits in common as sets of 64 neighbouring bins have
    bins = np.floor(x[:500] / 6 * 64) - np.floor(y[:500] / 6 * 64)
    assert (ma.dice(a, b)[:500] == np.maximum(0, 64 - np.abs(bins)) / 64).all()


def test_confidences_are_reliable(spark):
    a, b, truth = [], [], {}
    for g in range(40):  # crowded, noisy and partly seen by one source only
        x, y, t = world(100 + g, (3.0, 2.0), 1, 1.1, room=160, noise=2.5, cells=30)
        a += [(str(g), *r[1:]) for r in x if (r[1] + g) % 5]
        b += [(str(g), *r[1:]) for r in y]
        truth |= {(str(g), k): c for k, c in t.items() if (c + g) % 5}
    ta, tb = (ma.tracks(spark.createDataFrame(r, SCHEMA), "seq", "cell", "frame", "X", "Y", "Area") for r in (a, b))
    rows = ma.match(ta, tb, dataclasses.replace(ma.Match(), confidence=0.0)).collect()
    table = []
    for lo, hi in ((0, 0.25), (0.25, 0.5), (0.5, 0.75), (0.75, 0.9), (0.9, 1.01)):
        own = [(r["confidence"], truth.get((r["g"], r["b"])) == r["a"]) for r in rows if lo <= r["confidence"] < hi]
        if own:
            table.append((lo, len(own), sum(c for c, _ in own) / len(own), sum(k for _, k in own) / len(own)))
    print(table)
    assert sum(n for _, n, _, _ in table) > 500 and len(table) >= 3
    assert all(abs(said - true) < 0.15 for _, n, said, true in table if n >= 40), table


def test_calibration_rises():
    c = ma.calibrate([0, 1, 6, 9, 10, 50], [30, 20, 5, 9, 1, 0])
    assert all(x <= y for x, y in zip(c, c[1:])) and c[0] < 0.1 and c[-1] > 0.9


def test_a_group_far_shifted_is_searched_again(spark):
    a, b, truth = world(4, (27.0, -31.0), 7, 1.1)
    near_a, near_b, near_truth = world(1, (7.0, -5.0), 2, 1.15)
    a, b = ([("far", *r[1:]) for r in x] + y for x, y in ((a, near_a), (b, near_b)))
    ta, tb = (ma.tracks(spark.createDataFrame(r, SCHEMA), "seq", "cell", "frame", "X", "Y", "Area") for r in (a, b))
    got = {(r["g"], r["b"]): r["a"] for r in ma.match(ta, tb).collect()}
    for g, want in (("far", truth), ("s", near_truth)):
        assert {k: v for (h, k), v in got.items() if h == g and k in want} == want
