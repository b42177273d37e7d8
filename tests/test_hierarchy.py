import random

import pytest

from trackloom.operators import hierarchy


def brute(rows):
    """(seq, node) -> (root, depth, path, ring)."""
    up = {(s, n): p for s, n, p in rows}
    out = {}
    for s, n in up:
        path, at = [n], n
        while True:
            p = up[(s, at)]
            if p is None or (s, p) not in up:
                out[(s, n)] = (path[-1], len(path) - 1, path[::-1], None)
                break
            if p in path:
                out[(s, n)] = (None, None, None, min(path[path.index(p) :]))
                break
            path.append(p)
            at = p
    return out


def check(spark, rows, block):
    df = spark.createDataFrame(rows, "seq string, cell int, parent int").withColumn("root", df_lit("x")).withColumn("g", df_lit(1))
    want = brute(rows)
    got = {(r["seq"], r["cell"]): (r["root"], r["depth"], list(r["path"]) if r["path"] is not None else None, r["ring"]) for r in hierarchy.paths(df, "seq", "cell", "parent", block).collect()}
    assert got == want
    pairs = {(r[0], r[1], r[2], r[3]) for r in hierarchy.descendants(hierarchy.paths(df, "seq", "cell", "parent", block), "seq", "cell").collect()}
    assert pairs == {(s, a, n, len(v[2]) - 1 - i) for (s, n), v in want.items() if v[2] for i, a in enumerate(v[2][:-1])}


def df_lit(v):
    from pyspark.sql import functions as F

    return F.lit(v)


@pytest.mark.parametrize("block", [4, 4096])
def test_random_links_with_rings(spark, block):
    rnd = random.Random(block)
    rows = []
    for s in ("a", "b"):
        for n in range(1, 60):
            rows.append((s, n, rnd.choice([None, 999, *([rnd.randint(1, 59)] * 8)])))
    check(spark, rows, block)


def test_long_chain_ring_and_own_parent_over_blocks(spark):
    chain = [("a", n, n - 1 if n > 1 else None) for n in range(1, 81)]
    ring = [("b", n, n % 40 + 1) for n in range(1, 41)] + [("b", 100, 7), ("b", 101, 100)]
    check(spark, chain + ring + [("c", 5, 5), ("c", 6, 5), ("c", -3, 6)], 4)


def test_nulls_and_empty(spark):
    rows = [(None, 1, None), ("a", None, 1), ("a", 1, None)]
    df = spark.createDataFrame(rows, "seq string, cell int, parent int")
    assert [tuple(r) for r in hierarchy.forest(df, "seq", "cell", "parent").collect()] == [("a", 1, 1, 0, None)]
    assert hierarchy.paths(df.where("false"), "seq", "cell", "parent").collect() == []
