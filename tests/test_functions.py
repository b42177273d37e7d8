import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions.ranks import numbered, quantiles, ranged, running
from trackloom.operators.scoring import assign


def test_exact_quantiles(spark):
    rnd = random.Random(2)
    rows = [(g, rnd.choice([1.0, 2.0, rnd.uniform(0, 1e6)])) for g in "ab" for _ in range(501)] + [("c", 5.0), ("d", None), ("d", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    at = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: (r["n_values"], r["q"]) for r in quantiles(df, ["g"], "v", at, n=16).collect()}
    assert set(got) == {"a", "b", "c"}
    for g in got:
        v = [x for k, x in rows if k == g]
        assert got[g][0] == len(v) and np.allclose(got[g][1], np.quantile(v, at))
    whole = quantiles(df, [], "v", [0.5]).first()["q"][0]
    assert np.isclose(whole, np.median([x for _, x in rows if x is not None and x == x]))


def test_running_sums_from_the_top(spark):
    df = spark.createDataFrame([("a", float(i % 7)) for i in range(50)], "g string, v double")
    got = {r["v"]: r["n_cum"] for r in running(df, ["g"], "v", {"n": F.lit(1)}, descending=True, n=3).collect()}
    assert got == {float(v): sum(1 for i in range(50) if i % 7 >= v) for v in range(7)}


@pytest.mark.parametrize("seed", range(5))
def test_assignment_is_cheapest(seed):
    from itertools import permutations

    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 5), rng.integers(5, 7)
    cost = rng.integers(-9, 9, (n, m)).astype(float)
    got = assign(cost)
    assert len(set(got)) == n
    assert cost[np.arange(n), got].sum() == min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(m), int(n)))


def test_ranges_hold_even_shares_whatever_the_values(spark):
    rnd = random.Random(3)
    rows = [("a", rnd.gauss(0, 1)) for _ in range(20_000)] + [("a", 1e9), ("b", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").distinct()
    got = ranged(df, ["g"], "v", 16).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("lo").collect()
    assert max(r["n"] for r in got) <= 2 * 20_000 / 16
    assert all(a["hi"] < b["lo"] for a, b in zip(got, got[1:]) if b["lo"] != 1.0 and a["lo"] != 1.0)


def test_numbers_as_row_number_gives_them(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("aab"), rnd.choice([None, 1, 2, 3]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(5)
    got = {r["i"]: r["n"] for r in numbered(df, ["g"], [F.col("v").asc_nulls_last(), F.col("i").desc()], "n").collect()}
    for g in "ab":
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, -r[2]))
        assert [got[r[2]] for r in order] == list(range(1, len(order) + 1))
    assert numbered(df.where("false"), ["g"], [F.col("i").asc()], "n").collect() == []
