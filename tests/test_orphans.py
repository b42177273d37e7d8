import datetime as dt
import random

from trackloom.operators.orphans import orphan_report, orphans

T = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
REFS, KEYS = "g string, child int, key int, at timestamp_ntz", "g string, key int, live boolean, first timestamp_ntz"


def test_against_brute_force_with_hot_key(spark):
    rnd = random.Random(1)
    keys = [(g, k, rnd.choice([True, True, False, None]), rnd.choice([T(rnd.randint(0, 60)), None])) for g in "ab" for k in range(1, 40)]
    refs = [(g, i, 7 if i % 3 == 0 else rnd.randint(1, 60), rnd.choice([T(rnd.randint(0, 60)), None])) for g in "abc" for i in range(300)]
    state = {(g, k): (v, f) for g, k, v, f in keys}

    def judge(g, k, at):
        if (g, k) not in state:
            return "absent"
        live, first = state[(g, k)]
        return "deleted" if not live else "late" if at and first and first > at else None

    want = sorted((g, c, k, judge(g, k, at)) for g, c, k, at in refs if judge(g, k, at))
    r, k = spark.createDataFrame(refs, REFS), spark.createDataFrame(keys, KEYS)
    for hot in (20, 100_000):  # 20: the hot key is split into parts
        assert sorted((x["g"], x["child"], x["key"], x["state"]) for x in orphans(r, k, hot).collect()) == want
    report = orphan_report(orphans(r, k), r, "t").collect()
    assert sum(x["n_absent"] + x["n_deleted"] + x["n_late"] for x in report) == len(want) and sum(x["n_refs"] for x in report) == len(refs)
    assert any(x["period"] is None for x in report)


def test_nulls_repeats_and_empty(spark):
    r = spark.createDataFrame([("a", 1, 5, T(0)), ("a", 1, 5, T(0)), (None, 2, 5, T(0)), ("a", 3, None, None)], REFS)
    k = spark.createDataFrame([], KEYS)
    assert [tuple(x) for x in orphans(r, k).collect()] == [("a", 5, 1, T(0), "absent")] * 2
    assert orphans(r.where("false"), k).collect() == []
