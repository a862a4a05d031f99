import pytest

from stratalith.plans import cases, oracle, queries
from tests.conftest import SMALL

QUERIES, ORACLE = queries.QUERIES | cases.QUERIES, oracle.ORACLE | cases.ORACLE


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, same):
    df = QUERIES[name](spark, SMALL)
    if name in ORACLE:
        same(df, ORACLE[name])
    else:
        df.collect()


def test_every_sql_has_a_query():
    assert not set(ORACLE) - set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["qid", "rank", "id", "score"]
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
