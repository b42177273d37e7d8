import pytest
from compare import SF, database, same

from trackloom.plans import cells, learning, more, problems, scores, trackers

MODULES = [problems, scores, cells, learning, more, trackers]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_same_as_sql(spark, db, name):
    same(QUERIES[name](spark, SF), ORACLE[name], db)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE and n != "model_scores"])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).columns


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
