import pytest
from comparing import same

from proseledger.plans.oracle import ORACLE_SQL
from proseledger.plans.queries import QUERIES


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, sf, name):
    same(spark, sf, QUERIES[name], ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["source_id", "n_analyzed", "n_ai", "ai_share"]
    assert out.count() > 0
