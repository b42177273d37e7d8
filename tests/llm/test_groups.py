import itertools
import random

import pytest

from trackloom.llm import groups


def brute(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for g, a, b in links:
        if g is not None and a is not None and b is not None:
            x, y = sorted((find((g, a)), find((g, b))))
            up[y] = x
    return {k: find(k)[1] for k in list(up)}


@pytest.mark.parametrize("block", [2, 16, 4096])
def test_components(spark, block):
    rnd = random.Random(block)
    links = [("a", rnd.randint(1, 200), rnd.randint(1, 200)) for _ in range(110)] + [("b", n, n + 1) for n in range(1, 60)] + [("c", 5, 5), (None, 1, 2), ("c", None, 2), ("b", 3, 4), ("d", -5, 5)]
    df = spark.createDataFrame(links, "g string, a int, b int")
    got = groups.components(df, block).collect()
    assert len(got) == len({(r["g"], r["node"]) for r in got})
    assert {(r["g"], r["node"]): r["root"] for r in got} == brute(links)
    assert groups.components(df.where("false")).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_closest_counts_is_exact(seed):
    rnd = random.Random(seed)
    sizes = [(s, rnd.randint(1, 3)) for s in rnd.sample(range(1, 30), rnd.randint(1, 4))]
    total = sum(s * m for s, m in sizes)
    target = rnd.randint(0, total)
    taken = groups.closest_counts(sizes, target)
    assert all(taken.get(s, 0) <= m for s, m in sizes)
    best = min(abs(target - sum(k * s for k, (s, _) in zip(ks, sizes))) for ks in itertools.product(*(range(m + 1) for _, m in sizes)))
    assert abs(target - sum(s * k for s, k in taken.items())) == best


def test_closest_counts_in_units():
    sizes = [(1, 50_000), (7, 9_000), (1000, 300), (200_000, 2)]
    target = int(0.8 * sum(s * m for s, m in sizes))
    taken = groups.closest_counts(sizes, target, most=1 << 12)
    assert abs(target - sum(s * k for s, k in taken.items())) <= 1


def test_closest_counts_meets_large_targets():
    sizes = [(3001 + 7 * i, 40 + i % 5) for i in range(60)]  # 8 million rows, no group smaller than 3001
    total = sum(s * m for s, m in sizes)
    for share in (0.1, 0.5, 0.8):
        target = round(share * total)
        # in units of 2 and 12 rows, too, what the rounding leaves is put right
        for most, off in ((1 << 26, 0), (1 << 22, 0), (700_000, 1)):
            taken = groups.closest_counts(sizes, target, most)
            assert all(0 < taken.get(s, 1) <= m for s, m in sizes)
            assert abs(sum(s * k for s, k in taken.items()) - target) <= off


def test_splits_keep_groups_and_shares(spark):
    rnd = random.Random(1)
    rows = [(i, "x" if i % 5 else "y", rnd.choice([1, 1, 1, 2, 3, 40])) for i in range(3000)] + [(9999, "x", 3000), (10000, None, 4), (10001, "x", 0)]
    df = spark.createDataFrame(rows, "id int, stratum string, size long")
    got = {r["id"]: r for r in groups.assign_splits(df, {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()}
    assert set(got) == {r[0] for r in rows if r[2]}
    for s in "xy":
        total = sum(r[2] for r in rows if r[1] == s)
        for name, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
            have = sum(got[r[0]]["size"] for r in rows if r[1] == s and r[0] in got and got[r[0]]["split"] == name)
            assert abs(have - share * total) <= 2
    assert groups.assign_splits(df.where("false"), {"train": 1.0}).collect() == []
