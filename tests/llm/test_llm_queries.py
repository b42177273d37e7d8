import pytest
from compare import SF, same

from trackloom.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        same(df, ORACLE[name])
    else:
        rows = df.collect()
        assert len(rows) == len({tuple(map(str, r)) for r in rows})


def test_relatives_and_matched_cells_share_a_split(spark):
    rows = QUERIES["p6_splits"](spark, SF).collect()
    split = {(r["tab"], r["seq"], r["cell_id"]): r["split"] for r in rows}
    assert len(split) == len(rows) and set(split.values()) == {"train", "validation", "test"}
    groups = {}
    for r in rows:
        groups.setdefault((r["tab"], r["seq"], r["group_id"]), set()).add(r["split"])
    assert all(len(g) == 1 for g in groups.values())
    pairs = QUERIES["p3_found"](spark, SF).collect()
    both = [(split.get(("features", r["seq"], r["cell_id"])), split.get(("consensus_retrospective_labels", r["seq"], r["consensus_cell_id"]))) for r in pairs]
    assert sum(a is not None and b is not None for a, b in both) > 10 and all(a == b for a, b in both if a and b)
    assert all(abs(r["gap"]) <= 3 for r in QUERIES["p6_shares"](spark, SF).collect() if r["n_families"] > 20)
