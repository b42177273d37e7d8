import math
import random

from trackloom.operators.spikes import Measure, Rules, implausible

M = [Measure("v", low=0, low_open=True, floor=0.01), Measure("t", low=0, high=100, floor=0.01)]
SCHEMA = "seq string, cell int, frame int, v double, t double"


def found(df, rules=Rules()):  # noqa: B008
    return sorted((r["cell"], r["frame"], r["field"], r["kind"]) for r in implausible(df, ["seq", "cell"], "frame", M, rules).collect())


def test_spikes_runs_and_bounds(spark):
    rnd = random.Random(5)
    rows = []
    for f in range(80):
        v = 50 + 0.3 * f + rnd.gauss(0, 0.4)  # a trend is no spike
        t = 20 + rnd.gauss(0, 0.3) if f < 40 else 60 + rnd.gauss(0, 0.3)  # nor is a step
        v = {10: 90.0, 30: 20.0, 31: 21.0, 50: -1.0, 51: 0.0}.get(f, v)
        t = 20.5 if 20 <= f < 26 and f != 23 else t
        t = None if f == 23 else {60: 101.0, 61: math.nan}.get(f, t)
        t = 60.5 if 65 <= f < 71 else t
        rows.append(("s", 1, f, v, t))
    rows += [("s", 2, f, 5.0, 5.0) for f in range(5)] + [(None, 3, 1, -1.0, None), ("s", None, 1, -1.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = [(1, 10, "v", "spike"), (1, 30, "v", "spike"), (1, 31, "v", "spike"), (1, 50, "v", "impossible"), (1, 51, "v", "impossible"), (1, 60, "t", "impossible")]
    want += [(1, f, "t", "stuck") for f in range(65, 71)]  # five equal values (one of six is NULL) are no run
    assert found(df) == sorted(want)
    # shards with halos find the same
    assert found(df, Rules(shard=40, halo=20)) == sorted(want)


def test_scale_is_that_of_the_source_whatever_the_shards(spark):
    rnd = random.Random(9)
    rows = [("s", 1, f, 50 + rnd.gauss(0, 0.05 if f < 700 else 1.0), 20 + rnd.gauss(0, 1.0 if f < 1000 else 0.1)) for f in range(2000)]
    for f, v in ((300, 53.0), (500, 90.0), (1500, 20.0)):
        rows[f] = ("s", 1, f, v, rows[f][4])
    rows += [("s", c, f, 5.0 + 0.1 * ((f * 7) % 5), 5.0 + rnd.gauss(0, 1)) for c in (2, 3) for f in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = found(df, Rules(shard=8192))
    assert {(1, 500, "v", "spike"), (1, 1500, "v", "spike")} <= set(want)
    for shard in (40, 400, 1024):
        assert found(df, Rules(shard=shard, halo=64)) == want


def test_run_over_missing_values(spark):
    rows = [("s", 1, f, 5.0 if f % 2 else None, None) for f in range(12)] + [("s", 1, 20, 7.0, None)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == [(1, f, "v", "stuck") for f in range(1, 12, 2)]


def test_empty(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
